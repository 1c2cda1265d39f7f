"""Retrieval evaluation: anchors, judged hits, metrics, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import K_VALUES, MIN_ANSWERABLE, MIN_UNANSWERABLE
from ..functions.text import basename
from . import contain


def matches(anchor: Column, text: Column, heading: Column, source: Column) -> Column:
    """All of an anchor's non-empty fields match; file names are compared by their last part."""
    empty = lambda c: c.isNull() | (c == "")
    return (
        (empty(anchor["source"]) | (basename(anchor["source"]) == basename(source)))
        & (empty(anchor["heading_contains"]) | F.contains(F.coalesce(heading, F.lit("")), anchor["heading_contains"]))
        & (empty(anchor["text_contains"]) | F.contains(F.coalesce(text, F.lit("")), anchor["text_contains"]))
    )


def snippet(text: Column, needle: Column) -> Column:
    """Some text around a needle, on one line."""
    at = F.greatest(F.instr(text, needle) - 13, F.lit(0))
    cut = F.when(F.length(needle) > 0, F.substr(text, at + 1, F.length(needle) + 60)).otherwise(F.left(text, F.lit(60)))
    return F.translate(cut, "\n", " ")


def judge(hits: DataFrame, parents: DataFrame, golden: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Hits with ``matched``, the places of the anchors that they match, and a snippet."""
    p = parents.select("parent_id", "parent_text", "heading", F.col("source").alias("_psource"))
    rows = hits.join(p, "parent_id", "left").join(golden.select("qid", "anchors"), "qid")
    text, source = F.coalesce("parent_text", "child_text"), F.coalesce("_psource", "source")
    found = F.filter(F.transform("anchors", lambda a, i: F.when(matches(a, text, F.col("heading"), source), i)), lambda x: x.isNotNull())
    first = F.element_at(F.transform(found, lambda i: F.get(F.col("anchors"), i)["text_contains"]), F.when(F.size(found) > 0, 1).otherwise(None))
    return rows.select(*by, "rank", "parent_id", found.alias("matched"), snippet(text, F.coalesce(first, F.lit(""))).alias("snippet"), source.alias("source"), "heading", "score")


def item_metrics(judged: DataFrame, golden: DataFrame, runs: DataFrame | None = None, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Per item (and run) and k: coverage, hit, reciprocal rank, nDCG, first_rank."""
    by = ["run", "qid"] if runs is not None else ["qid"]
    items = golden.select("qid", "answerable", "reviewed", F.size("anchors").alias("_n"), *(["error"] if "error" in golden.columns else []))
    items = items.join(F.broadcast(runs)) if runs is not None else items  # a run is a row of a small configuration
    items = items.withColumn("k", F.explode(F.array(*[F.lit(k) for k in k_values])))
    seen = judged.groupBy(*by).agg(F.collect_list(F.struct("rank", "matched")).alias("_h"))
    rows = items.join(seen, by, "left").withColumn("_h", F.coalesce("_h", F.array().cast(seen.schema["_h"].dataType)))
    top = F.filter("_h", lambda x: x["rank"] <= F.col("k"))
    good = F.filter(top, lambda x: F.size(x["matched"]) > 0)
    first = F.array_min(F.transform(F.filter("_h", lambda x: F.size(x["matched"]) > 0), lambda x: x["rank"]))
    gain = F.aggregate(good, F.lit(0.0), lambda acc, x: acc + 1 / F.log2(x["rank"] + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(good), F.lit(1))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    return rows.select(
        *by, "k", "answerable", "reviewed", *(["error"] if "error" in rows.columns else []), first.alias("first_rank"),
        F.when(F.col("_n") > 0, F.size(F.array_distinct(F.flatten(F.transform(top, lambda x: x["matched"])))) / F.col("_n")).otherwise(0.0).alias("recall"),
        F.when(F.coalesce(first <= F.col("k"), F.lit(False)), 1.0).otherwise(0.0).alias("hit"), F.when(F.coalesce(first <= F.col("k"), F.lit(False)), 1 / first).otherwise(0.0).alias("rr"),
        F.when(F.size(good) > 0, gain / ideal).otherwise(0.0).alias("ndcg"),
    )


def pair(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Golden items with their results (``qid, answerable``, and ``error, used_ratio, dropped`` where known).

    Every item has exactly one result, and it agrees whether the item is answerable; anything else raises ValueError.
    """
    n = results.groupBy("qid").agg(F.count("*").alias("_n"), F.first("answerable").alias("_said"))
    both = golden.select("qid", "answerable").join(n, "qid", "full")
    wrong = both.filter((F.coalesce("_n", F.lit(0)) != 1) | F.col("answerable").isNull() | (F.col("answerable") != F.col("_said"))).limit(5).collect()
    if wrong:
        raise ValueError(f"items and results do not match: {[(r.qid, r._n, r.answerable, r._said) for r in wrong]}")
    given = dict(results.dtypes)
    columns = [F.col(c).cast(kind).alias(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in (("error", "string"), ("used_ratio", "double"), ("dropped", "int"))]
    return golden.join(results.select("qid", *columns), "qid")


def _counts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_expected``: reviewed, answerable and, if errors are known, retrieved without one."""
    failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    return rows.withColumn("_expected", F.col("answerable") & F.col("reviewed") & ~failed)


def metrics(items: DataFrame, with_run: bool = False) -> DataFrame:
    """Means over the reviewed, answerable items that were retrieved without error; zeros where there are none."""
    by = ["run", "k"] if with_run else ["k"]
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("_expected"), F.col(c))), F.lit(0.0)), 6)
    return _counts(items).groupBy(*by).agg(F.count_if("_expected").alias("n"), *[mean(c).alias(name) for c, name in (("recall", "recall"), ("hit", "hit_rate"), ("rr", "mrr"), ("ndcg", "ndcg"))])


def counts(paired: DataFrame) -> DataFrame:
    """One row over paired items: how many there are of each kind, and how full the contexts of the expected ones were."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("_expected"), F.col(c))), F.lit(0.0)), 6)
    return _counts(paired).agg(
        F.count("*").alias("n_items"), F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_unanswerable"),
        F.count_if("_expected").alias("n_expected"), mean("used_ratio").alias("avg_used_ratio"), mean("dropped").alias("avg_dropped"),
    )


def warnings(golden: DataFrame, pseudo_vectors: bool = False) -> DataFrame:
    """One row with the reasons to distrust the metrics.  Paired items may have an ``error``."""
    failed = F.col("error").isNotNull() if "error" in golden.columns else F.lit(False)
    n = _counts(golden).agg(F.count_if(~F.col("reviewed")).alias("u"), F.count_if("_expected").alias("a"), F.count_if(~F.col("answerable")).alias("x"), F.count_if(failed).alias("f"))
    said = [F.when(F.col("u") > 0, "unreviewed_items"), F.when(F.col("a") < MIN_ANSWERABLE, "few_answerable"), F.when(F.col("x") < MIN_UNANSWERABLE, "few_unanswerable"), F.when(F.col("f") > 0, "failed_items"), F.when(F.lit(pseudo_vectors), "pseudo_vectors")]
    return n.select(F.array_compact(F.array(*said)).alias("warnings"))


def check_anchors(golden: DataFrame, parents: DataFrame) -> DataFrame:
    """Anchors that no parent matches: ``qid, anchor, near``, with up to 3 parents that hold the first half of the needle.

    Parents and anchors meet by a string that the parent must hold: the anchor's text, else its heading, else by
    the file name.  The other fields are then compared for those that met.
    """
    anchors = golden.select("qid", F.posexplode("anchors").alias("anchor", "_a"))
    given = lambda field: F.length(F.coalesce(field, F.lit(""))) > 0
    by_text, by_heading = given(F.col("_a.text_contains")), given(F.col("_a.heading_contains"))
    rows = parents.select("parent_id", "parent_text", "heading", "source")
    texts = anchors.filter(by_text).withColumn("_n", F.col("_a.text_contains"))
    heads = anchors.filter(~by_text & by_heading).withColumn("_n", F.col("_a.heading_contains"))
    names = anchors.filter(~by_text & ~by_heading).withColumn("_n", basename(F.col("_a.source")))
    met = contain.containing(rows.withColumn("_t", F.col("parent_text")), "_t", texts, "_n").join(texts, "_n")
    met = met.unionByName(contain.containing(rows.withColumn("_t", F.coalesce("heading", F.lit(""))), "_t", heads, "_n").join(heads, "_n"))
    met = met.unionByName(rows.withColumn("_n", basename(F.col("source"))).join(names, "_n"))
    found = met.filter(matches(F.col("_a"), F.col("parent_text"), F.col("heading"), F.col("source"))).select("qid", "anchor").distinct()
    missing = anchors.join(found, ["qid", "anchor"], "left_anti").withColumn("_half", F.left("_a.text_contains", F.ceil(F.length("_a.text_contains") / 2).cast("int")))
    near = contain.containing(parents.select("parent_id", "parent_text"), "parent_text", missing, "_half").join(missing, "_half")
    order = Window.partitionBy("qid", "anchor").orderBy("parent_id")
    near = near.withColumn("_n", F.row_number().over(order)).filter("_n <= 3").groupBy("qid", "anchor").agg(F.array_sort(F.collect_list("parent_id")).alias("near"))
    return missing.join(near, ["qid", "anchor"], "left").select("qid", "anchor", F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def failures(items: DataFrame, judged: DataFrame, limit: int = 10) -> DataFrame:
    """Up to ``limit`` answerable items whose first hit is not at rank 1, with their five best judged rows."""
    bad = items.filter("answerable and (first_rank is null or first_rank <> 1)").select("qid", "first_rank").distinct().orderBy("qid").limit(limit)
    return bad.join(judged.filter("rank <= 5"), "qid", "left").select("qid", "first_rank", "rank", "parent_id", "snippet", "score")


def select_items(golden: DataFrame, qids: list[str]) -> DataFrame:
    """Only the items named; a name that is not there is an error."""
    wanted = golden.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(qids)], "qid string")
    missing = [r.qid for r in wanted.join(golden, "qid", "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"no such items: {missing}")
    return golden.join(wanted, "qid", "left_semi")
