"""Toxicity: subword-bag embeddings, averaged, into a linear softmax.

A word's embedding is the mean of the embeddings of its character n-grams (3 and 4,
with word boundaries) and of the whole word, each hashed to one of 2**BITS rows.
The bag of WINDOW consecutive words is averaged and goes through a linear softmax of
two classes; a text's probability is that of its most toxic window, so that a few
words count in a text of any length.  Embeddings and softmax are trained jointly in
numpy with the gradient of the cross entropy; while training, windows are weighted by
a softmax over their own logits that sharpens from the mean to the maximum.  A
misspelling shares most n-grams, and so most of its vector, with the word it hides.

Training takes a bounded sample of labelled rows (``MOST`` rows and ``labelled.MOST_BYTES`` bytes of text
a label) on the driver.  Scoring is an Arrow UDF over whole texts; the model is of fixed size.

Defined cases: a null or wordless text is scored as a bag with the zero vector; a text
of fewer than WINDOW words is one bag; without rows of both labels the score is the
smoothed share of label 1; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import memo
from .labelled import labelled_sample

BITS = 17
DIM = 8
WINDOW = 2
MOST = {0: 2000, 1: 1500}
THRESHOLD = 0.7
ROUNDS = 110
SEED = 20240229
_WORD = re.compile(r"\w+")
_MEMO = 300_000


_PRIME = np.uint32(0x9E3779B1)
_POWERS = _PRIME ** np.arange(1, 4097, dtype=np.uint32)
_SHIFT = np.uint32(32 - BITS)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words, whole word and character 3- and 4-grams, and the index of the word each belongs to."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words), dtype=np.int32), length)
    place = np.arange(len(points)) - start[owner]
    rows = [(np.add.reduceat(points * _POWERS[place & 4095], start, dtype=np.uint32) ^ np.uint32(0x5BD1E995)) * _PRIME >> _SHIFT]
    whose = [np.arange(len(words), dtype=np.int32)]
    mixed = points * _PRIME
    for n in (2, 3, 4):
        if len(points) < n:
            break
        mixed = (mixed[:-1] ^ points[n - 1 :]) * _PRIME
        mixed ^= mixed >> np.uint32(15)
        if n > 2:
            inside = owner[: len(mixed)] == owner[n - 1 :]
            rows.append((mixed[inside] * _PRIME) >> _SHIFT)
            whose.append(owner[: len(mixed)][inside])
    return np.concatenate(rows), np.concatenate(whose)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    """Embeddings (2**BITS x DIM), softmax weights (DIM x 2) and biases (2)."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    projected: np.ndarray | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """What each word adds to (logit of class 1 - logit of class 0), before averaging.

        The mean embedding times the softmax weights; as both are linear, the rows are projected first.
        """
        rows, whose = subwords(words)
        if self.projected is None:
            self.projected = self.table.astype(np.float64) @ (self.weights[:, 1] - self.weights[:, 0])
        return np.bincount(whose, self.projected[rows], len(words)) / np.bincount(whose, minlength=len(words))

    def score(self, word_margins: np.ndarray) -> float:
        """Probability of class 1 for the most toxic window."""
        bias = float(self.bias[1] - self.bias[0])
        n = len(word_margins)
        if n:
            k = min(WINDOW, n)
            sums = np.cumsum(np.concatenate([[0.0], word_margins]))
            bias += float((sums[k:] - sums[:-k]).max()) / k
        return float(1 / (1 + np.exp(-np.clip(bias, -35, 35))))


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Joint training of embeddings and softmax on whole texts."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (1 << BITS, DIM))
    weights = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    ok = [i for i, d in enumerate(docs) if len(d)]
    y = np.asarray(labels, float)
    if len(set(y.tolist())) < 2 or not ok:
        bias[1] = np.log((1 + (y == 1).sum()) / (1 + (y == 0).sum()))
        return Model(np.zeros_like(table), weights, bias)
    docs, y = [docs[i] for i in ok], y[ok]
    flat, word_of_sub = subwords(list(vocabulary))
    n_words = len(vocabulary)
    n_sub = np.bincount(word_of_sub, minlength=n_words)
    # windows: start and end in the concatenated words, and whose they are
    stream = np.concatenate(docs)
    begin = np.cumsum([0] + [len(d) for d in docs])
    starts, ends, owner = [], [], []
    for i, d in enumerate(docs):
        k = min(WINDOW, len(d))
        s = np.arange(len(d) - k + 1) + begin[i]
        starts.append(s)
        ends.append(s + k)
        owner.append(np.full(len(s), i))
    starts, ends, owner = map(np.concatenate, (starts, ends, owner))
    size = (ends - starts).astype(float)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    acc_t, acc_w, acc_b = np.full(1 << BITS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for turn in range(rounds):
        u = weights[:, 1] - weights[:, 0]
        per_row = table @ u
        margin = np.bincount(word_of_sub, per_row[flat], n_words) / n_sub
        sums = np.concatenate([[0.0], np.cumsum(margin[stream])])
        logit = (sums[ends] - sums[starts]) / size + (bias[1] - bias[0])
        sharp = min(12.0, 0.3 * turn)
        top = np.maximum.reduceat(logit, first)
        share = np.exp(sharp * (logit - top[owner]))
        share /= np.add.reduceat(share, first)[owner]
        pooled = np.add.reduceat(share * logit, first)
        error = (1 / (1 + np.exp(-np.clip(pooled, -35, 35))) - y) * cost / len(y)
        by_window = share * error[owner]
        edge = np.bincount(starts, by_window / size, len(stream) + 1) - np.bincount(ends, by_window / size, len(stream) + 1)
        by_word = np.bincount(stream, np.cumsum(edge)[:-1], n_words)
        by_row = np.bincount(flat, (by_word / n_sub)[word_of_sub], 1 << BITS)
        g_u = table.T @ by_row
        g_w, g_b = np.stack([-g_u, g_u], 1), np.array([-1.0, 1.0]) * error.sum()
        g_t = by_row[:, None] * u[None, :] + 1e-6 * table
        acc_t += (g_t * g_t).mean(1)
        acc_w += g_w * g_w
        acc_b += g_b * g_b
        table -= 0.3 * g_t / np.sqrt(acc_t)[:, None]
        weights -= 0.1 * g_w / np.sqrt(acc_w)
        bias -= 0.1 * g_b / np.sqrt(acc_b)
    return Model(table.astype(np.float32), weights, bias)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label_col: str = "toxic", most: dict[int, int] | None = None) -> Model:
    sample = labelled_sample(docs, labels, label_col, most or MOST, may_learn).toArrow()
    label, key = sample.column("label").to_numpy(), sample.column("_h").to_numpy()
    order = np.lexsort((label, key))
    return fit([sample.column("text")[int(i)].as_py() for i in order], label[order])


def score_udf(spark, model: Model):
    """Arrow UDF text -> probability that the text is toxic."""
    sent = spark.sparkContext.broadcast(model)
    owner = f"toxicity {uuid.uuid4()}"

    @F.arrow_udf(T.DoubleType())
    def udf(texts: pa.Array) -> pa.Array:
        m = sent.value
        out = []
        for t in texts:
            words = words_of(t.as_py())
            known = memo(owner, _MEMO)
            new = [w for w in set(words) if w not in known]
            if new:
                known.update(zip(new, m.margins(new).tolist(), strict=True))
            out.append(m.score(np.array([known[w] for w in words])))
        return pa.array(out, pa.float64())

    return udf


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``score`` and ``predicted``."""
    udf = score_udf(docs.sparkSession, model)
    got = docs.select(F.col(id_col), udf(F.col(text_col)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
