"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: the text is lower-cased, all but letters become blanks, blanks are folded; 1- to 4-grams of
what is left are hashed to 2**BITS places.  A value is log(1 + count) * idf, the vector has length 1.
Long texts are counted in parts of PART letters, so a task holds one part at a time; the counts are of the whole text.

1. One pass over all rows that may be learnt from counts, for each place, the texts that hold it, and for each
   language its texts: a vector of counts a task, added up on the way.  So the idf is that of all rows.
2. Weights are learnt from a sample, the rows of each language with the least hash of id and text: at most MOST rows and MOST_BYTES bytes of text a
   language (with many languages fewer: TOTAL rows in all, at least LEAST each), of which their sparse vectors go to the driver.
   Follow-the-regularised-leader, with an elastic net: l1 sets rare places to exactly 0, l2 holds the others.
3. A fifth of the sample is not learnt from: a temperature is chosen that makes its log loss least.
4. Scoring: sparse products with the weights, the probability after division by the temperature.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from all texts are ``und``; with one
language all others get it, with score 1; rows with a null id are documents like others and may be learnt from, as whoever calls decides; repeated rows give repeated results; ties go
to the language that sorts first; texts of any length count whole; columns besides id, text and language are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget

BITS = 16
GRAMS = 4
#: Bounds of the sample: rows and bytes of a language, rows in all and rows of a language that are taken at least.
MOST, MOST_BYTES, TOTAL, LEAST = 600, 3 << 20, 6000, 20
#: More languages than this aren't a column of languages.
LANGUAGES = 512
#: Letters of a text that are counted at a time.
PART = 1 << 18
UND = "und"
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Letters as code points, each run of anything else, and both ends, as one blank (0); empty without a letter."""
    letter = _letters()
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    here = letter[code]
    if not here.any():
        return np.zeros(0, np.uint32)
    code = np.concatenate([[0], np.where(here, code, 0), [0]])
    return code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]


def counts(text: str | None) -> np.ndarray | None:
    """How often each place is hit by the text's n-grams; None without a letter."""
    code = _codes(text) if text else np.zeros(0, np.uint32)
    if not len(code):
        return None
    found = np.zeros(1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    for at in range(0, len(code), PART):
        part = code[at : at + PART + GRAMS - 1].astype(np.uint64) + np.uint64(1)
        own = min(PART, len(code) - at)
        h = np.zeros(len(part), np.uint64)
        for k in range(GRAMS):
            n = min(own, len(part) - k)
            if n <= 0:
                break
            h = h[: len(part) - k] + part[k:] * _K[k]
            mixed = (h[:n] ^ h[:n] >> np.uint64(31)) * _K[(k + 1) % 4]
            found += np.bincount((mixed >> shift).astype(np.int64), minlength=1 << BITS)
    return found


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and values of a text."""
    found = counts(text)
    if found is None:
        return None
    place = np.flatnonzero(found)
    value = np.log1p(found[place]) * idf[place]
    return place, value / max(1e-300, float(np.sqrt(value @ value)))


@dataclass(frozen=True)
class Model:
    """``weights`` has a row for each place, and one for the bias; a column for each language."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[place] + self.weights[-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for the softmax loss, with l1 and l2 penalties."""

    classes: int
    places: int = 1 << BITS
    alpha: float = 0.6
    beta: float = 0.1
    l1: float = 2e-4
    l2: float = 1e-3
    epochs: int = 4

    def __post_init__(self):
        self.z, self.n = np.zeros((self.places + 1, self.classes)), np.zeros((self.places + 1, self.classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, y: int) -> None:
        """One row: the gradient at the weights of now, then z and n."""
        at, v = np.append(place, self.places), np.append(value, 1.0)
        w = self.weights(at)
        g = _softmax(v @ w)
        g[y] -= 1
        g = v[:, None] * g[None, :]
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        for _ in range(self.epochs):
            for row in rows:
                self.learn(*row)
        return self.weights()


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Where the mean log loss of ``logits / t`` is least, by golden sections over log t in [-5, 5]; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = -5.0, 5.0, (5**0.5 - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    lc, ld = loss(c), loss(d)
    for _ in range(40):
        if lc <= ld:
            b, d, ld = d, c, lc
            c = b - r * (b - a)
            lc = loss(c)
        else:
            a, c, lc = c, d, ld
            d = a + r * (b - a)
            ld = loss(d)
    return float(np.exp((a + b) / 2))


def _learnable(docs: DataFrame, may_learn: Column | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs if may_learn is None else docs.filter(may_learn)
    rows = rows.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    return rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))


def _counted(batches):
    """A task's texts -> one row: how many hold each place and, last, how many have a letter."""
    forget()
    df = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for t in batch.column("text"):
            found = counts(t.as_py())
            if found is not None:
                df[:-1] += found > 0
                df[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), pa.array(df))], ["df"])


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of those that hold each place: of all rows, added up on executors."""
    each = rows.select("text").mapInArrow(_counted, "df array<long>")
    found = each.select(F.posexplode("df").alias("place", "df")).filter("df > 0").groupBy("place").agg(F.sum("df").alias("df")).toArrow()  # 2**BITS + 1 rows at most
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[found.column("place").to_numpy()] = found.column("df").to_numpy()
    return int(df[-1]), df[:-1]


def sample(rows: DataFrame, languages: int, most: int = MOST, most_bytes: int = MOST_BYTES, total: int = TOTAL, least: int = LEAST) -> DataFrame:
    """``lang, h, text`` of a bounded sample: for each language the rows with the least hash, as many as the bounds allow; equal texts of one id count once."""
    bound = max(least, min(most, total // max(1, languages)))
    keys = rows.select("lang", "h", F.octet_length("text").cast("long").alias("size"))
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= 2 * bound)
    first = first.groupBy("lang", "h").agg(F.min("size").alias("size"))
    order = Window.partitionBy("lang").orderBy("h")
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = first.withColumn("r", F.row_number().over(order)).withColumn("so_far", so_far).filter((F.col("r") <= bound) & (F.col("so_far") <= most_bytes))
    chosen = F.broadcast(taken.select("lang", "h"))  # at most LANGUAGES * LEAST, or TOTAL, rows
    return rows.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])


def _vectors(idf: np.ndarray):
    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            got = [vector(t.as_py(), idf) or (np.zeros(0, np.int64), np.zeros(0)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array([p.astype(np.int32) for p, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))], ["lang", "h", "place", "value"]
            )

    return run


def train(docs: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages that stand in ``lang_col`` of the rows that may be learnt from."""
    rows = _learnable(docs, may_learn, id_col, text_col, lang_col)
    found = sorted(r.lang for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(found) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    got = sample(rows, len(found)).mapInArrow(_vectors(idf), "lang string, h long, place array<int>, value array<float>").toArrow().combine_chunks()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    number = {lang: i for i, lang in enumerate(found)}
    take = lambda name, i: got.column(name)[int(i)].values.to_numpy(zero_copy_only=False)
    every = [(take("place", i).astype(np.int64), take("value", i).astype(float), number[got.column("lang")[int(i)].as_py()]) for i in order]
    every = [row for row in every if len(row[0])]
    held, fitted = every[::5], [row for i, row in enumerate(every) if i % 5]
    weights = Ftrl(len(found)).fit(fitted)
    model = Model(tuple(found), idf, weights, 1.0)
    logits = np.array([model.logits(p, v) for p, v, _ in held]).reshape(len(held), len(found))
    return Model(tuple(found), idf, weights.astype(np.float32), temperature(logits, np.array([y for *_, y in held], np.int64)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_row`` (its own columns), ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language
    kind = pa.struct([pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def udf(texts: pa.Array) -> pa.Array:
        forget()
        model = sent.value
        out = []
        for t in texts:
            found = vector(t.as_py(), model.idf) if model.languages else None
            if found is None:
                out.append((UND, 0.0))
                continue
            p = _softmax(model.logits(*found).astype(float) / model.temperature)
            best = int(p.argmax())
            out.append((model.languages[best], float(p[best])))
        return pa.array([{"lang_pred": a, "score": b} for a, b in out], kind)

    return docs.select(F.struct("*").alias("_row"), udf(F.col(text_col)).alias("_l")).select("_row", "_l.*")
