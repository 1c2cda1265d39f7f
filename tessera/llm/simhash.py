"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the
text's word shingles.  Two fingerprints link if they differ in at most 3 bits.

Search: of two linked fingerprints, at least one 32-bit half differs in at most one
bit.  For the low 31 bits of each half, the anchors are the words of the perfect
Hamming code [31, 26], whose covering radius is 1: each word is within 1 of exactly one
anchor, its home.  A fingerprint goes to every anchor within radius plus threshold
(1 + 1 = 2) of its half: that is its home and up to 15 more.  If x and y link
and differ by at most 1 in a half, y lies within 2 of x's home, so both meet there.
At each anchor, those at home are compared with all, over the full 64 bits.

Only distinct fingerprints are compared; a copy costs nothing.  Anchors with many
fingerprints are cut into blocks and each pair of blocks is compared in its own group.
A group of linked fingerprints yields a forest (each to its least label), never all pairs.
Components come from star contraction over written tables.

Defined cases: a null or wordless text has fingerprint zero, linked like any other;
fewer words than a shingle make one shingle; repeated rows give repeated results; rows
with a null id get a fingerprint and the component of the documents they link to (null
if none has an id).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, shuffle_partitions, stored
from .components import components

BITS_APART = 3
#: Fingerprints at an anchor beyond which it is cut into blocks of about this size.
BLOCK = 4096
#: Stands for "no id" among the nodes; greater than any id.
_NO_ID = (1 << 63) - 1


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of each word shingle of the ASCII-lower-cased text, in order, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), "<u8", n)


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint: the bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of the ASCII-lower-cased text."""
    return of_hashes(shingle_hashes(text, shingle, seed))


def fingerprints(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprints as (signed) longs."""

    @F.arrow_udf(T.LongType())
    def udf(texts: pa.Array) -> pa.Array:
        got = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
        return pa.array(got.view(np.int64))

    return udf(text.cast("binary"))


# -- the covering code ---------------------------------------------------------------------------------


def _code() -> tuple[np.ndarray, np.ndarray]:
    """Check masks of the [31, 26] Hamming code, and for each syndrome the bit pairs that repair it."""
    masks = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)], np.uint64)
    pairs = np.zeros((32, 15), np.uint64)
    for s in range(1, 32):
        pairs[s] = [1 << (i - 1) | 1 << (j - 1) for i, j in combinations(range(1, 32), 2) if i ^ j == s]
    return masks, pairs


_MASKS, _PAIRS = _code()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For uint64 fingerprints: anchor keys, index of the fingerprint, and whether the anchor is its home."""
    keys, index, home = [], [], []
    everyone = np.arange(len(fps))
    for half in range(2):
        word = fps >> np.uint64(32 * half) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(fps), np.int64)
        for k, mask in enumerate(_MASKS):
            syndrome |= (np.bitwise_count(word & mask).astype(np.int64) & 1) << k
        base = np.uint64(half << 31)
        flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        keys.append(word ^ flip | base)
        index.append(everyone)
        home.append(np.ones(len(fps), bool))
        off = np.flatnonzero(syndrome)  # an anchor's other neighbours have none within 2
        keys.append((word[off, None] ^ _PAIRS[syndrome[off]] | base).ravel())
        index.append(np.repeat(off, 15))
        home.append(np.zeros(15 * len(off), bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(index), np.concatenate(home)


def _at_anchors(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 20_000):
            keys, index, home = anchors(fps[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at : at + 20_000][index].view(np.int64)), pa.array(nodes[at : at + 20_000][index]), pa.array(home)], ["key", "fp", "node", "home"])


# -- comparison at the anchors ---------------------------------------------------------------------------


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) -> each linked node with the least node of its component here."""
    label = nodes.copy()
    while True:
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (was == label).all():
            break
    off = np.flatnonzero(label != nodes)
    return label[off], nodes[off]


def _links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key."""
    if not len(key):
        return node, node
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([edge, [len(key)]]))
    size_of = np.repeat(size, size)
    out_a, out_b = [], []
    rows = np.flatnonzero(size_of > 1)
    for d in range(1, 64):  # small groups: each row with the d-th after it
        rows = rows[(rows + d < len(key)) & (size_of[rows] <= 64)]
        rows = rows[key[np.minimum(rows + d, len(key) - 1)] == key[rows]]
        if not len(rows):
            break
        hit = rows[(home[rows] | home[rows + d]) & (np.bitwise_count(fp[rows] ^ fp[rows + d]) <= bits)]
        out_a.append(node[hit])
        out_b.append(node[hit + d])
    for e, n in zip(edge[size > 64], size[size > 64], strict=True):
        f, h, me = fp[e : e + n], np.flatnonzero(home[e : e + n]), node[e : e + n]
        a, b = [], []
        for at in range(0, len(h), 256):
            i, j = np.nonzero(np.bitwise_count(f[h[at : at + 256], None] ^ f[None, :]) <= bits)
            a.append(h[at + i])
            b.append(j)
        if a:
            x, y = _forest(me, np.concatenate(a), np.concatenate(b))
            out_a.append(x)
            out_b.append(y)
    if not out_a:
        return node[:0], node[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(bits: int):
    def run(batches):
        rest: list[np.ndarray] | None = None

        def made(rows):
            a, b = _links(*rows, bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "fp", "node", "home")]
            rows[1] = rows[1].view(np.uint64)
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            done = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if done:
                yield made([x[:done] for x in rows])
            rest = [x[done:] for x in rows]
        if rest is not None and len(rest[0]):
            yield made(rest)

    return run


def link(distinct: DataFrame, bits: int = BITS_APART, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between nodes whose fingerprints differ in at most ``bits`` bits, as forests of the anchors' groups.

    ``distinct`` has long columns ``node`` and ``fp``, one row for each fingerprint.
    """
    if not 0 <= bits <= 3:
        raise ValueError("anchor-point covering is laid out for at most 3 differing bits")
    spark = distinct.sparkSession
    spread = stored(distinct.mapInArrow(_at_anchors, "key long, fp long, node long, home boolean"), "anchors")
    sizes = spread.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    sizes = sizes.withColumn("g", F.ceil(F.col("n") / block).cast("int"))
    met = spread.join(sizes.select("key", "g"), "key")
    # a crowded anchor's rows go to every pair of blocks that holds their own
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    other = F.explode(F.when(F.col("g") > 1, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.lit(0))))
    met = met.withColumn("m", mine).withColumn("o", other)
    met = met.withColumn("key", F.when(F.col("g") > 1, F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o"))).otherwise(F.col("key")))
    dealt = met.select("key", "fp", "node", "home").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(_compare(bits), "a long, b long").distinct(), "links")
    drop(spread)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, bits: int = BITS_APART) -> DataFrame:
    """One row per document: id, ``fp`` (long) and ``component_id``, the least id reachable by links."""
    marked = docs.select(F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_n"), fingerprints(F.col(text_col), shingle, seed).alias("fp"))
    marked = stored(marked, "fingerprints")
    # a fingerprint's node is the place of one of its rows, so fingerprints without any id stay apart
    distinct = stored(marked.groupBy("fp").agg(F.min("_id").alias("id"), F.min("_n").alias("node")), "distinct")
    groups = components(link(distinct.select("node", "fp"), bits))
    named = distinct.join(groups, "node", "left").select("fp", "id", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("id").alias("component_id"))
    whole = named.join(least, "c").select("fp", "component_id")
    return marked.join(whole, "fp", "left").select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, bits: int = BITS_APART) -> DataFrame:
    """One document of each component, the one with the least id, in the documents' own columns.

    A repeated row is a copy like any other: of rows that share the least id, one stays.  Of a component
    whose documents have no id at all, one stays.
    """
    key = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.monotonically_increasing_id().alias("n"))
    numbered = stored(docs.select(F.struct("*").alias("_row"), fingerprints(F.col(text_col), shingle, seed).alias("fp"), key.alias("_key")), "numbered")
    distinct = stored(numbered.groupBy("fp").agg(F.min("_key").alias("key")), "first")
    groups = components(link(distinct.select(F.col("key.n").alias("node"), "fp"), bits))
    whole = distinct.select("fp", F.col("key.id").alias("id"), F.col("key.n").alias("node")).join(groups, "node", "left")
    first = whole.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min(F.struct("id", F.col("node").alias("n"))).alias("_key")).select("_key")
    return numbered.join(first, "_key").select("_row.*")
