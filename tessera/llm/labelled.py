"""A bounded, deterministic sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that are learnt from, for each label.
MOST_BYTES = 24 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``_h, label, text`` of at most ``most[y]`` documents, and ``most_bytes`` of text, for each label ``y``.

    The rows with the least hash of the id are taken, so the sample doesn't depend
    on partitioning.  Ids alone are sorted; sizes and then texts join a side of at most
    ``sum(most.values())`` rows, a bound that makes its broadcast safe.  Null ids,
    labels and texts take no part; of an id's several labels the least counts; of
    its several texts, the one with the least hash; a text that would exceed the bytes is passed over with all after it.
    """
    if may_learn is not None:
        labels = labels.filter(may_learn)
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    named = named.filter(F.col("_id").isNotNull() & F.col("label").isNotNull()).groupBy("_id").agg(F.min("label").alias("label"))
    named = named.withColumn("_h", F.xxhash64("_id", F.lit(7)))
    chosen = None
    for value, bound in most.items():
        part = named.filter(F.col("label") == value).orderBy("_h", "_id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).withColumn("_t", F.xxhash64("text"))
    sizes = texts.join(F.broadcast(chosen), "_id").select("_id", "label", "_h", "_t", F.octet_length("text").cast("long").alias("_size"))
    sizes = sizes.groupBy("_id", "label", "_h").agg(F.min(F.struct("_t", "_size")).alias("_s"))
    so_far = F.sum("_s._size").over(Window.partitionBy("label").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sizes.withColumn("_sum", so_far).filter(F.col("_sum") <= most_bytes).select("_id", "label", "_h", "_s._t")
    return texts.join(F.broadcast(taken), ["_id", "_t"]).dropDuplicates(["_id"]).select("_h", "label", "text")
