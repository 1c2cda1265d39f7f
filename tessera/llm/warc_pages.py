"""Web pages to WARC archives, with revisit records for repeated payloads.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest id is
the response and the others revisit it.  Digests are SHA-1, computed in the JVM; payloads are equal if
SHA-256 and length are, as SHA-1 is known to collide.  The largest id of each repeated payload is a partial
aggregation; if such are few, they are sent to the scan and no payload is moved, else both sides are shuffled.

Defined cases: a null payload is empty; smaller payloads are all responses; rows that repeat
the largest id are all responses; a null id revisits whichever id is there, and is a response if none is; a null url is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import scratch, small, stored

MIN_BYTES = 1000
_ID = "urn:page:"


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record for each page, in the columns of the data source."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    page = page.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    page = page.withColumn("sha2", F.when(F.col("bytes") >= min_bytes, F.sha2("payload", 256)))
    repeated = page.filter("sha2 is not null").groupBy("sha2", "bytes").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    page = page.join(small(stored(repeated, "repeated"), 200_000), ["sha2", "bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    digest = F.concat(F.lit("sha1:"), _base32(F.col("sha1")))
    return page.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), "target_uri", F.lit(None).cast("string").alias("date"),
        F.when(revisit, urn(F.col("last"))).alias("refers_to"), digest.alias("payload_digest"), F.col("bytes").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(sha1_hex):
    """40 hex digits -> 32 letters of base 32, in the JVM: eight groups of 5 digits, each 4 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        number = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, compression: str = "gzip", **columns) -> None:
    warc.register(pages.sparkSession)
    to_records(pages, **columns).write.format("warc").mode("append").option("compression", compression).save(path)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    warc.register(spark)
    reader = spark.read.format("warc")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


def round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the pages' archive, reads it back and returns one row per page from the archive alone.

    Payloads are checked against their digests while reading.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archive(pages, path, **columns)
    got = read_archive(spark, path, verify="true").filter(F.col("type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    size = F.when(F.col("type") == "response", F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long")
    return got.select(number(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
