"""Refusal gate, offline generator, citations and the answer's state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ECHO_HEADER, ECHO_NONE, REFUSALS, Answering
from ..functions.text import is_blank, strip

#: A group of citation numbers, lists and ranges.  Fixed value.
CITATION = r"\[([0-9][0-9,\- ]*)\]"
_SPAN = 50


def extract_citations(text: Column) -> Column:
    """Cited numbers in order of first appearance.  A reversed or overlong range stands for its left end."""
    number = lambda s: F.when(s.rlike(r"^[0-9]+$"), s.try_cast("bigint"))

    def expand(part: Column) -> Column:
        left, right = F.trim(F.substring_index(part, "-", 1)), F.trim(F.substr(part, F.instr(part, "-") + 1))
        a, b = number(left), number(right)
        ranged = F.when((a <= b) & (b - a <= _SPAN), F.sequence(a, b)).when(a.isNotNull() & b.isNotNull(), F.array(a))
        single = number(F.trim(part))
        return F.when(F.instr(part, "-") > 0, ranged).when(single.isNotNull(), F.array(single))

    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(expand(p), F.array().cast("array<bigint>")))))


def validation(text: Column, refs_there: Column, params: Answering | None = None) -> Column:
    """Struct: refs, valid_refs, invalid_refs, unused_refs, unsupported, coverage, ok."""
    p = params or Answering()
    refs, there = extract_citations(text), refs_there.cast("array<bigint>")
    valid, invalid = F.array_intersect(refs, there), F.array_except(refs, there)
    unsupported = F.size(valid) < p.min_citations
    return F.struct(
        refs.alias("refs"), valid.alias("valid_refs"), invalid.alias("invalid_refs"), F.array_sort(F.array_except(there, refs)).alias("unused_refs"), unsupported.alias("unsupported"),
        F.when(F.size(there) > 0, F.round(F.size(valid) / F.size(there), 6)).otherwise(0.0).alias("coverage"), ((F.size(invalid) == 0) & ~unsupported).alias("ok"),
    )


def citation_details(refs: Column, blocks: Column) -> Column:
    """(ref, source, heading, kind) of each cited block, in citation order."""
    of = lambda r: F.transform(F.filter(blocks, lambda b: b["ref"].cast("bigint") == r), lambda b: F.struct(b["ref"].alias("ref"), b["source"].alias("source"), b["heading"].alias("heading"), b["kind"].alias("kind")))
    return F.flatten(F.transform(refs, of))


def support(vector_hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, support``: the best raw cosine of the vector channel, 0 at least.  Any other kind of score is an error."""
    checked = vector_hits.withColumn("_ok", F.assert_true(F.col("score_kind") == "cosine", F.lit("support needs cosine scores")))
    best = checked.filter(F.col("_ok").isNull()).groupBy("qid").agg(F.max("score").alias("support"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.greatest(F.coalesce("support", F.lit(0.0)), F.lit(0.0)).alias("support"))


def refuse_reason(blocks: Column, vec_score: Column, params: Answering | None = None) -> Column:
    """no_context, weak_support, or null.  A null score (pseudo vectors) skips the support test."""
    p = params or Answering()
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) <= 0, "no_context").when(vec_score < p.min_vec_score, "weak_support")


def echo(blocks: Column, params: Answering | None = None) -> Column:
    """Offline generator: repeats the first blocks with their numbers."""
    p = params or Answering()
    # a heading is read back after the first separator of the source line, whatever the source holds
    label = lambda b: F.concat(F.coalesce(b["source"], F.lit("None")), F.when(F.length(b["heading"]) > 0, F.concat(F.lit(" / "), b["heading"])).otherwise(F.lit("")))
    heading = lambda b: F.when(F.instr(label(b), " / ") > 0, strip(F.substr(label(b), F.instr(label(b), " / ") + 3))).otherwise(F.lit(""))
    line = lambda b: F.concat(F.lit("- "), F.left(strip(b["text"]), F.lit(p.echo_chars)), F.when(F.length(heading(b)) > 0, F.concat(F.lit("（"), heading(b), F.lit("）"))).otherwise(F.lit("")), F.lit(" ["), b["ref"].cast("string"), F.lit("]"))
    said = F.array_join(F.transform(F.slice(blocks, 1, p.echo_blocks), line), "\n")
    return F.when(F.size(blocks) > 0, F.concat(F.lit(ECHO_HEADER + "\n"), said)).otherwise(F.lit(ECHO_NONE))


def generator_call(model: Callable, retry: int, backoff: float) -> Callable:
    """``model`` with retries; None after the last failure."""

    def one(prompt: str):
        for attempt in range(max(1, retry)):
            try:
                return model(prompt)
            except Exception:
                if attempt + 1 < retry:
                    time.sleep(backoff * 2**attempt)
        return None

    return one


def generator(model: Callable[[str], str], retry: int = 2, backoff: float = 0.8):
    """UDF prompt -> text of a remote model; null after the last failure."""
    whole = generator_call(model, retry, backoff)

    @F.pandas_udf("string")
    def udf(prompts: pd.Series) -> pd.Series:
        return prompts.map(whole)

    return udf


def streamed(model: Callable[[str], Iterable[str]], retry: int = 2, backoff: float = 0.8):
    """UDF prompt -> pieces of a model that answers bit by bit, in order, empty ones left out; null after the last failure.

    A stream that breaks is asked for anew from its start, so no piece is given twice.
    """
    whole = generator_call(lambda prompt: [piece for piece in model(prompt) if piece], retry, backoff)

    @F.pandas_udf("array<string>")
    def udf(prompts: pd.Series) -> pd.Series:
        return prompts.map(whole)

    return udf


def answer(packed: DataFrame, text: Column, vec_score: Column | None = None, strict: bool = True, params: Answering | None = None) -> DataFrame:
    """One row per query: text, refused, refusal_reason, validation, citations, answer_tokens, raw_text.

    Refuses before generation (gate), on a failed or blank generation, and, if strict, on
    invented or missing citations.  ``text`` is the generated text (null: it failed).
    """
    score = F.lit(None).cast("double") if vec_score is None else vec_score
    rows = packed.withColumn("_raw", text).withColumn("_gate", refuse_reason(F.col("blocks"), score, params))
    rows = rows.withColumn("_v", validation(F.col("_raw"), F.transform("blocks", lambda b: b["ref"]), params))
    reason = F.col("_gate")
    late = F.when(F.col("_raw").isNull(), "generator_error").when(is_blank(F.col("_raw")), "empty_answer")
    if strict:
        late = late.when(F.size("_v.invalid_refs") > 0, "invalid_citation").when(F.col("_v.unsupported"), "not_supported")
    rows = rows.withColumn("refusal_reason", F.coalesce(reason, late))
    refused = F.col("refusal_reason").isNotNull()
    message = F.element_at(F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair]), F.col("refusal_reason"))
    shown = F.when(refused, message).otherwise(F.col("_raw"))
    return rows.select(
        "qid", shown.alias("text"), refused.alias("refused"), "refusal_reason", F.col("_v").alias("validation"),
        F.when(refused, F.array().cast("array<struct<ref:int,source:string,heading:string,kind:string>>")).otherwise(citation_details(F.col("_v.valid_refs"), F.col("blocks"))).alias("citations"),
        F.greatest(F.lit(1), (F.length(shown) / 1.5).cast("int")).alias("answer_tokens"), F.when(refused & F.col("_gate").isNull(), F.col("_raw")).alias("raw_text"),
    )


def policy_rates(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Rates over all answers: hallucination, unsupported, refusal accuracy, miss and mean coverage."""
    got = answers.join(golden.select("qid", "answerable"), "qid")
    told = ~F.col("refused")
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    return got.agg(
        F.count("*").alias("n"), rate(F.size("validation.invalid_refs") > 0).alias("hallucination_rate"), rate(F.when(told, F.col("validation.unsupported"))).alias("unsupported_rate"),
        rate(F.when(~F.col("answerable"), F.col("refused"))).alias("refusal_accuracy"), rate(F.when(F.col("answerable"), F.col("refused"))).alias("miss_rate"), rate(F.when(told, F.col("validation.coverage"))).alias("avg_coverage"),
    )
