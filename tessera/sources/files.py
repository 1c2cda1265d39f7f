"""File trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KINDS
from ..functions.text import fingerprint, stem
from ..operators.convert import convert, strip_tags

SUPPORTED = tuple(s for s in KINDS)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of every supported file below a folder, or of one file.

    A missing path, and a single file of another kind, are errors.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        raise FileNotFoundError(path)
    if not files.getFileStatus(target).isDirectory():
        if path.rsplit(".", 1)[-1].lower() not in KINDS:
            raise ValueError(f"not a supported kind of file: {path}")
        found = spark.read.format("binaryFile").load(path)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*KINDS)).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "content")


def load(spark: SparkSession, path: str, structured_html: bool = True) -> DataFrame:
    """Converted documents: source, markdown, content_hash, label (file stem), kind, available, reason, warnings."""
    files = scan(spark, path).withColumn("content_hash", fingerprint(F.col("content")))
    return convert(files, structured_html).select(F.col("path").alias("source"), "markdown", "content_hash", stem(F.col("path")).alias("label"), "kind", "available", "reason", "encoding", "warnings")


def load_plain(spark: SparkSession, path: str) -> DataFrame:
    """Text files as UTF-8 with replacements, HTML stripped of tags; ``warning`` if blank."""
    rows = scan(spark, path)
    text = F.decode("content", "UTF-8")
    html = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("html", "htm")
    rows = rows.withColumn("text", F.when(html, strip_tags(text)).otherwise(text)).withColumn("content_hash", fingerprint(F.col("content")))
    return rows.select(F.col("path").alias("source"), "text", "content_hash", F.when(F.length(F.trim("text")) == 0, "blank").alias("warning"))
