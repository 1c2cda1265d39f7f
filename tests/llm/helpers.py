"""Small documents tables with the awkward cases, and readers of the given tables."""

import pyarrow.parquet as pq
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, lang="en", ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)], DOCS)


def given(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def prose(seed, n, words="alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper larch maple oak pine rowan spruce teak willow yew".split()):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
