"""Golden sets as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "qid string, question string, anchors array<struct<source: string, heading_contains: string, text_contains: string>>, answerable boolean, points array<string>, note string, reviewed boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Items of a file; blank lines and lines starting with # are skipped.  Anything wrong raises ValueError."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    rows = lines.select(F.from_json("value", SCHEMA).alias("r"), "value").select("value", "r.*")
    broken = [r.value for r in rows.filter(~F.startswith("value", F.lit("{")) | F.col("qid").isNull() | F.col("question").isNull()).select("value").limit(3).collect()]
    if broken:
        raise ValueError(f"not a golden item: {broken}")
    items = rows.drop("value").withColumns({"answerable": F.coalesce("answerable", F.lit(True)), "reviewed": F.coalesce("reviewed", F.lit(False)), "anchors": F.coalesce("anchors", F.from_json(F.lit("[]"), rows.schema["anchors"].dataType))})
    check(items)
    return items


def _repeated(items: DataFrame, *by) -> list:
    return [r[0] for r in items.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").limit(3).collect()]


def check(items: DataFrame) -> None:
    """Ids and questions are unique; an answerable item has an anchor, an anchor a field; an (anchor, rule) occurs once."""
    for column in ("qid", "question"):
        if found := _repeated(items, column):
            raise ValueError(f"repeated {column}: {found}")
    full = lambda a: F.exists(F.array(a["source"], a["heading_contains"], a["text_contains"]), lambda x: F.length(x) > 0)
    bad = items.filter((F.col("answerable") & (F.size("anchors") == 0)) | F.exists("anchors", lambda a: ~F.coalesce(full(a), F.lit(False))))
    if found := [r.qid for r in bad.select("qid").limit(3).collect()]:
        raise ValueError(f"items without usable anchors: {found}")
    rule = F.substring_index(F.coalesce("note", F.lit("")), "；", 1)
    anchors = items.select(F.explode("anchors").alias("a"), rule.alias("rule")).select(F.concat_ws("|", "a.source", "a.heading_contains", "a.text_contains").alias("label"), "rule")
    if found := _repeated(anchors, "label", "rule"):
        raise ValueError(f"repeated anchors: {found}")


def write(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)
