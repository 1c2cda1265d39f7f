"""Quality classifier: logistic regression over hashed word n-grams.

Features: a text is cut into words and runs of punctuation.  Counted are the
lower-cased word uni- and bigrams, and uni-, bi- and trigrams of word forms (a form
says capital, all capitals, digits, mixed, the punctuation itself, or that the word
repeats the one before it), each hashed to one of 2**BITS places.  A value is
log(1 + count), the vector has length 1.

Training: follow-the-regularised-leader, one pass per epoch over a bounded sample
of labelled rows (``MOST`` rows and ``labelled.MOST_BYTES`` bytes of text a label), on the driver.  Scoring: sparse dot
products in an Arrow UDF; the weights are 2**BITS floats whatever the corpus size.

Defined cases: a null or empty text has no features and gets the score of the bias;
without labelled rows (or with one label only) the bias is the smoothed log odds of
what there is; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memo, trim
from .labelled import labelled_sample

BITS = 18
#: At most so many labelled rows of each label are learnt from.
MOST = {0: 4000, 1: 4000}
THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - BITS)
_MEMO = 300_000


def _form(token: str) -> str:
    if not token[0].isalnum():
        return token[:4]
    if token.isdigit():
        return "9"
    if token.isupper():
        return "AA" if len(token) > 1 else "A"
    return "a" if token.islower() else "Aa" if token[0].isupper() and token[1:].islower() else "aA"


def _hash(text: str) -> int:
    data = text.encode("utf-8", "replace")
    return (zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (sorted) and values of a text."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    known = memo("n-grams", _MEMO)
    for t in set(tokens):
        if t not in known:
            known[t] = np.array((_hash(t.lower()), _hash("form:" + _form(t))), np.uint64).tobytes()
    pairs = np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.uint64).reshape(-1, 2)
    word, form = pairs[:, 0], pairs[:, 1].copy()
    form[1:][word[1:] == word[:-1]] = np.uint64(0xA5A5A5A5DEADBEEF)
    parts = [word * _K[0], form * _K[1]]
    for seq, salt in ((word, 0), (form, 1)):
        if len(seq) > 1:
            parts.append((seq[:-1] * _K[1] ^ seq[1:] * _K[2]) * _K[salt])
    if len(form) > 2:
        parts.append((form[:-2] * _K[0] ^ form[1:-1] * _K[1] ^ form[2:] * _K[2]) * _K[2])
    place, count = np.unique((np.concatenate(parts) >> _SHIFT).astype(np.int32), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    return place, value / np.float32(np.sqrt((value * value).sum()))


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 4
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Weights, the bias last.  ``rows`` are learnt from in the order given."""
        bias = np.array([1 << BITS])
        for _ in range(self.epochs):
            for place, value, y in rows:
                at, v = np.concatenate([place, bias]), np.concatenate([value, [1.0]])
                w = self.weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
                sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
                self.z[at] += g - sigma * w
                self.n[at] += g * g
        return self.weights().astype(np.float32)


def _featurised(batches):
    for batch in batches:
        out = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_h"), batch.column("label"), pa.array([p for p, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float32()))],
            ["_h", "label", "place", "value"],
        )


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label_col: str = "quality", most: dict[int, int] | None = None) -> np.ndarray:
    """Weights (bias last) learnt from a bounded sample of the labelled rows."""
    sample = labelled_sample(docs, labels, label_col, most or MOST, may_learn)
    got = sample.mapInArrow(_featurised, "_h long, label int, place array<int>, value array<float>").toArrow()
    order = np.lexsort((got.column("label").to_numpy(), got.column("_h").to_numpy()))
    label = got.column("label").to_numpy()
    rows = [(np.asarray(got.column("place")[int(i)].values), np.asarray(got.column("value")[int(i)].values), int(label[i])) for i in order]
    del got
    seen = {int(y) for y in label}
    if len(seen) < 2:
        weights = np.zeros((1 << BITS) + 1, np.float32)
        weights[-1] = np.log((1 + (label == 1).sum()) / (1 + (label == 0).sum())) if len(label) else 0.0
        return weights
    weights = Ftrl().fit(rows)
    del rows
    trim()  # the driver goes on with other stages
    return weights


def score_udf(spark, weights: np.ndarray):
    """Arrow UDF text -> score in 0 to 1."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def udf(texts: pa.Array) -> pa.Array:
        w = sent.value
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            place, value = features(t.as_py())
            out[i] = float(value.astype(np.float64) @ w[place]) + float(w[-1])
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return udf


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``score`` and ``predicted``."""
    udf = score_udf(docs.sparkSession, weights)
    got = docs.select(F.col(id_col), udf(F.col(text_col)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    udf = score_udf(docs.sparkSession, weights)
    return docs.select(F.struct("*").alias("_row"), udf(F.col(text_col)).alias("_score")).filter(F.col("_score") >= threshold).select("_row.*")
