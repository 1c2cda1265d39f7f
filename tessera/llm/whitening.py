"""Embedding whitening by merged moments.

A component c of a vector becomes the integer x = floor(1024 * c) + 100000.  Each partition
computes the count, the mean and the centred scatter of its vectors, batch by batch; two such partials
are merged pairwise by Chan's formula

    M = M1 + M2 + (m2 - m1)(m2 - m1)' * n1 * n2 / (n1 + n2),

first within a partition, then across partitions in a ``treeReduce``.  So nothing is squared before it is centred, and
the driver gets one partial of d + d**2 numbers, whatever the number of vectors.  Sums of integers are carried
beside the means, exactly.  The driver takes the eigenvectors of M / n; a second pass over the
vectors merges the moments of the whitened values in the same way and compares their covariance with the identity.

Defined cases: a vector that is null, or holds a null or a non-finite entry, takes no part and has no row in the result; a vector
shorter than the longest counts as if it ended in zeros; repeated rows count as often as they stand there; rows with a null id stay;
an empty table, or one without any such vector, gives no rows.  A direction without variance has no whitened value (null) and
does not enter the check.  An entry beyond 2**40, whose integers would not be exact, is an error, and so is a deviation beyond a long.
Columns besides id and vector stay in ``_row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: An eigenvalue up to so small a share of all variance stands for none.
NO_VARIANCE = 1e-12
#: Entries of a batch that are centred at a time.
ENTRIES = 1 << 20
_MOST = float(1 << 40)


@dataclass
class Moments:
    """Count, integer sums (or None), mean and centred scatter of some rows."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Of a matrix, a row for each vector; of integers, with their sums."""
        whole = rows.dtype.kind == "i"
        if not len(rows):
            d = rows.shape[1]
            return Moments(0, np.zeros(d, np.int64) if whole else None, np.zeros(d), np.zeros((d, d)))
        sums = rows.sum(0) if whole else None
        mean = (sums if whole else rows.sum(0)) / len(rows)
        apart = rows - mean
        return Moments(len(rows), sums, mean, apart.T @ apart)

    def widened(self, d: int, fill: float) -> Moments:
        """With constant dimensions added, up to ``d``."""
        more = d - len(self.mean)
        if more <= 0:
            return self
        value = fill if self.n else 0
        sums = None if self.sums is None else np.concatenate([self.sums, np.full(more, int(value) * self.n, np.int64)])
        return Moments(self.n, sums, np.concatenate([self.mean, np.full(more, float(value))]), np.pad(self.scatter, (0, more)))

    def merged(self, other: Moments, fill: float = OFFSET) -> Moments:
        """Chan's pairwise merge."""
        d = max(len(self.mean), len(other.mean))
        a, b = self.widened(d, fill), other.widened(d, fill)
        n = a.n + b.n
        if not a.n or not b.n:
            return a if a.n else b
        step = b.mean - a.mean
        sums = None if a.sums is None or b.sums is None else a.sums + b.sums
        mean = a.mean + step * (b.n / n) if sums is None else sums / n
        return Moments(n, sums, mean, a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))

    def packed(self) -> tuple:
        return self.n, None if self.sums is None else self.sums.tolist(), self.mean.tobytes(), self.scatter.tobytes()

    @staticmethod
    def unpacked(row) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], None if row["sums"] is None else np.array(row["sums"], np.int64), mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)))


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``components`` has a row for each, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(1, self.n)

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    @property
    def varied(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > NO_VARIANCE * self.trace if self.trace > 0 else np.zeros(len(self.values), bool)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entry = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), entry), F.lit(False))


def integers(vectors: pa.Array) -> np.ndarray:
    """The x of lists of doubles, as a matrix; shorter ones are filled up with those of zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= _MOST:
        raise ValueError("an entry of a vector is too large to be counted in whole steps")
    out = np.full((len(size), int(size.max(initial=0))), OFFSET, np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.floor(SCALE * flat).astype(np.int64) + OFFSET
    return out


def _parts(batches, width: int = 0):
    """Slices of the batches of about ENTRIES entries."""
    for batch in batches:
        column = batch.column("_v")
        widest = max(1, width, column.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
        step = max(1, ENTRIES // int(widest))
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _wide(x: np.ndarray, d: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, d - x.shape[1])), constant_values=OFFSET) if x.shape[1] < d else x


def _moments(vectors: DataFrame, change=None) -> Moments | None:
    """Merged moments of all vectors (``_v``), or of what ``change`` makes of their integers."""

    def run(batches):
        found = None
        for part in _parts(batches):
            x = integers(part.column("_v"))
            own = Moments.of(x if change is None else change(x))
            found = own if found is None else found.merged(own)
        n, sums, mean, scatter = (found or Moments.of(np.zeros((0, 0), np.int64))).packed()
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([sums], pa.list_(pa.int64())), "mean": [mean], "scatter": [scatter]})

    partials = vectors.mapInArrow(run, "n long, sums array<long>, mean binary, scatter binary").rdd  # one row a partition
    if not partials.getNumPartitions():
        return None
    return partials.map(Moments.unpacked).treeReduce(lambda a, b: a.merged(b), 2 if partials.getNumPartitions() < 1000 else 3)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Count, sums and the first components of all usable vectors."""
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("_v")).filter(usable(F.col("_v")))
    found = _moments(rows)
    if found is None or not found.n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    cov = found.scatter / found.n
    values, directions = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = directions.T[order]
    if chosen.size:  # either sign would do; the largest entry is positive
        chosen = chosen * np.where(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(found.n, found.sums, np.maximum(values[order], 0.0), chosen, float(np.trace(cov)))


def _whitened(model: Whitening, only_varied: bool = False):
    scale = np.where(model.varied, np.sqrt(np.where(model.varied, model.values, 1.0)), np.nan)
    chosen = model.varied if only_varied else np.ones(len(model.values), bool)
    directions, scale, mean, d = model.components[chosen], scale[chosen], model.mean, len(model.sums)
    return lambda x: (_wide(x, d) - mean) @ directions.T / scale


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """Second pass: the largest entry of the whitened values' covariance minus the identity, of all components with variance."""
    if not model.varied.any():
        return None
    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("_v")).filter(usable(F.col("_v")))
    found = _moments(rows, _whitened(model, only_varied=True))
    return float(np.abs(found.scatter / found.n - np.eye(len(found.mean))).max())


def deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sums over dimensions of (n * x - S)**2, exactly."""
    most = max(abs(int(n) * int(x.max(initial=0))), abs(int(n) * int(x.min(initial=0))), int(np.abs(sums).max(initial=0)))
    apart = n * x - sums if most < 1 << 61 else n * x.astype(object) - sums
    if len(x) and len(sums) * int(np.abs(apart).max()) ** 2 >= 1 << 63:
        total = (apart.astype(object) ** 2).sum(1)
        if max(total) >= 1 << 63:
            raise OverflowError("a deviation is beyond a long; fit on fewer vectors")
        return total.astype(np.int64)
    return (apart * apart).sum(1).astype(np.int64)


def apply(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> DataFrame:
    """``_row`` (the row's own columns), ``deviation`` and ``whitened``, an array with a value for each component; usable vectors only."""
    d, whiten = len(model.sums), _whitened(model)
    n, sums, k = model.n, model.sums, len(model.values)
    kind = pa.struct([pa.field("deviation", pa.int64()), pa.field("whitened", pa.list_(pa.float64()))])

    @F.arrow_udf("deviation long, whitened array<double>")
    def udf(column: pa.Array) -> pa.Array:
        out = []
        for part in _parts([pa.RecordBatch.from_arrays([column], ["_v"])], d):
            x = _wide(integers(part.column("_v")), d)
            value = whiten(x).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(value, mask=np.isnan(value)))
            out.append(pa.StructArray.from_arrays([pa.array(deviation(x, n, sums)), lists], fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    rows = vectors.select(F.struct("*").alias("_row"), F.col(vector_col).cast("array<double>").alias("_v")).filter(usable(F.col("_v")))
    return rows.select("_row", udf("_v").alias("_d")).select("_row", "_d.*")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    model = fit(vectors, vector_col, components)
    error = identity_error(vectors, model, vector_col)
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained]) if len(model.values) else F.array().cast("array<double>")
    got = apply(vectors, model, vector_col).select(F.col("_row")[id_col].alias(id_col), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return got.select(
        id_col, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
