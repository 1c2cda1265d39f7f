"""Near-duplicates by SimHash, completed to all pairs whose shingle sets are similar.

A text's set holds the hashes of its word shingles (ASCII-lower-cased, white space
folded).  Two texts link if the Jaccard similarity of their sets is SIMILAR or more.

SimHash fingerprints of the same shingles are searched by anchor-point covering (``simhash.link``).
They find the closest copies; but two sets at a similarity of 0.8 have an angle of 0.48, so
64-bit fingerprints of them differ in 9.7 bits on average, and 3 bits reach one such pair in a hundred.
So the texts are searched by their sets too, exactly:

Of a set of s shingles, ordered alike in all texts, the first s - ceil(4/5 s) + 1
are its prefix.  Two linked sets share at least 4/5 of each, so the first shingle that
they share stands in both prefixes: texts meet at the shingles of their prefixes, and no
linked pair is lost whatever the order is.  Shingles that are common in a bounded sample
come last, so that prefixes are rare shingles; that only saves work.  Where two texts
meet, their sizes and the places of the shingle bound what they can share.

Only distinct sets are compared; a copy costs nothing.  First the pairs that SimHash found, and each text
with its neighbour and with a hub at two of its shingles, are confirmed, and components are formed; then,
at each shingle, the texts outside its largest component with their neighbour, the hub and the hubs of that component;
then, with the components of both, those still outside with all of other components.
A hub is, of texts of about a size, the one whose set has the shingle first: the fewest rare shingles come before, so of
near copies it is the one least changed, which links to most of those that link to any.
So a crowd of near copies is linked without all its pairs.  Of the shingles that two texts meet at, those that
follow the same shingle in both are passed over: they met there.

Every pair is confirmed by the whole sets.  Before, sets are compared by parities: of the hashes of a set at each of
2**k places, whether they are odd in number.  Each place where two differ holds a hash that is in one set only, so
their number never exceeds that of the differing hashes; pairs that differ in too many places can't link, and
only the texts of the others have their sets made again.

Defined cases: all null or wordless texts have the same, empty set; fewer words than a
shingle make one shingle; rows with a null id are kept apart by their place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, forget, small, stored
from .components import components
from .simhash import link, of_hashes, shingle_hashes

#: Similarity from which texts link, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Texts of the sample that common shingles are counted in, and most common shingles that are told apart.
SAMPLE, COMMON = 10_000, 50_000
#: Stands for "no id" among the ids; greater than any id.
_NO_ID = (1 << 63) - 1
_MARKED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType())])


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(text: Column, shingle: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def udf(texts: pa.Array) -> pa.Array:
        forget()
        return _lists([shingle_set(t.as_py(), shingle) for t in texts])

    return udf(text.cast("binary"))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, those not in ``common`` (ascending) first, then by count."""
    part, whole = SIMILAR
    n = len(found) - -(-part * len(found) // whole) + 1 if len(found) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
    return found[:n]


def parities(found: np.ndarray) -> bytes:
    """For each of 2**k places, as many as the set has hashes or up to twice that, whether an odd number of hashes falls there."""
    n = max(64, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """So many hashes at least are in only one of two sets with these parities."""
    (short, a), (long, b) = sorted(((len(o), int.from_bytes(o, "little")) for o in (x, y)), key=lambda o: o[0])
    while long > short:  # places fold by halves
        long //= 2
        b = b >> 8 * long ^ b & (1 << 8 * long) - 1
    return (a ^ b).bit_count()


def _least_apart(x: Column, y: Column) -> Column:
    @F.arrow_udf(T.IntegerType())
    def udf(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([least_apart(x, y) for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.int32())

    return udf(x, y)


def _marked(text: Column, shingle: int, common: np.ndarray, counts: np.ndarray) -> Column:
    """Digest and size of the set, the fingerprint, and the set's prefix and parities."""

    @F.arrow_udf(_MARKED)
    def udf(texts: pa.Array) -> pa.Array:
        forget()
        digests, sizes, marks, firsts, odd = [], [], [], [], []
        for t in texts:
            hashes = shingle_hashes(t.as_py(), shingle)
            found = np.unique(hashes)
            marks.append(of_hashes(hashes))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            firsts.append(prefix(found, common, counts))
            odd.append(parities(found))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(marks, np.uint64).view(np.int64)), _lists(firsts), pa.array(odd, pa.binary())], ["digest", "size", "fp", "prefix", "odd"])

    return udf(text.cast("binary"))


def _common(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several texts of a sample, ascending, and their counts."""
    few = docs.select(F.col(text_col).alias("t")).sample(min(1.0, SAMPLE / max(1, docs.count())), 42)
    often = few.select(F.explode(_sets(F.col("t"), shingle)).alias("h")).groupBy("h").count().filter("count > 1")
    rows = sorted(often.orderBy(F.desc("count"), "h").limit(COMMON).collect(), key=lambda r: r["h"] % (1 << 64))
    return np.array([r["h"] % (1 << 64) for r in rows], np.uint64), np.array([r["count"] for r in rows], np.int64)


def _may_link(a: str, b: str) -> str:
    """SQL condition that the sizes and the places of a shared shingle allow a link."""
    part, whole = SIMILAR
    most = f"least({a}.size - {a}.place, {b}.size - {b}.place)"
    return f"{whole} * least({a}.size, {b}.size) >= {part} * greatest({a}.size, {b}.size) and {part + whole} * ({most}) >= {part} * ({a}.size + {b}.size)"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row``, the text, and what a row is found again by without moving its text: ``id`` (or what stands for none) and ``h``, a hash of the text.
    Rows that agree in both are repeated rows."""
    text = F.col(text_col)
    return docs.select(F.struct("*").alias("_row"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text, text.isNull()).alias("h"))


def _confirmed(pairs: DataFrame, marks: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """Those of the pairs ``a, b`` (a < b, no repeats) that link.  ``marks`` has ``node, size, odd``; ``nodes`` has ``node, id, h``; ``texts`` has ``id, h, text``.

    The sets of the texts whose parities allow a link are made again; ``repeats`` says that several rows may have the same key.  If those texts are few, their keys are sent to the scan, so only
    their own texts are moved.
    """
    part, whole = SIMILAR
    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("odd").alias("x")), "a").join(marks.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("odd").alias("y")), "b")
    # what is in both is half of m + n less what is in one only
    likely = stored(both.filter((part + whole) * (F.col("m") + F.col("n") - _least_apart(F.col("x"), F.col("y"))) >= 2 * part * (F.col("m") + F.col("n"))).select("a", "b"), "likely")
    met = stored(nodes.join(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "asked")
    sets = texts.select("id", "h", "text").join(small(met), ["id", "h"]).select("node", _sets(F.col("text"), shingle).alias("s"))
    sets = stored(sets.groupBy("node").agg(F.first("s").alias("s")) if repeats else sets, "sets")
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = stored(both.filter((part + whole) * shared >= part * (F.size("x") + F.size("y"))).select("a", "b"), "similar")
    for table in (likely, met, sets):
        drop(table)
    return found


def _pairs(pairs: DataFrame, *without: DataFrame) -> DataFrame:
    """The pairs ``a, b``, a < b, once each, but those of other tables."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for other in without:
        pairs = pairs.join(other, ["a", "b"], "left_anti")
    return stored(pairs, "pairs")


def _about(size: str) -> Column:
    """Sizes in steps; those of two linked texts are at most one step apart."""
    part, whole = SIMILAR
    return F.floor(F.log(F.col(size)) / math.log(whole / part)).cast("int")


def _beside(rows: DataFrame) -> DataFrame:
    """``a, b``: each text at a shingle with its neighbour and with the hub, if they may link."""
    near = rows.select("me", F.explode(F.array("prev", "hub")).alias("it")).filter("me.node <> it.node").filter(_may_link("me", "it"))
    return near.select(F.col("me.node").alias("a"), F.col("it.node").alias("b"))


def _to_main(left: DataFrame) -> DataFrame:
    """``a, b``: each text outside the main component at a shingle with that component's hubs of about its size there, if they may link."""
    sized = left.withColumn("about", _about("me.size"))
    hubs = sized.filter("c = main").groupBy("key", "about").agg(F.min_by("me", "me.place").alias("it")).alias("h")
    off = sized.filter("c <> main").select("key", "me", "about").alias("o")
    near = off.join(hubs, F.expr(f"o.key = h.key and abs(o.about - h.about) <= 1 and {_may_link('o.me', 'h.it')}"))
    return near.select(F.col("o.me.node").alias("a"), F.col("h.it.node").alias("b"))


def _mixed(met: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows at shingles where several components meet, with the component ``c`` of each and the one with most rows there, ``main``."""
    named = met.withColumn("node", F.col("me.node")).join(groups, "node", "left").withColumn("c", F.coalesce("component", "node"))
    main = named.groupBy("key", "c").count().groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("n")).filter("n > 1").select("key", "main")
    return named.join(main, "key").select(*met.columns, "c", "main")


def _close(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs to confirm that SimHash finds: equal fingerprints, and those that the anchors link."""
    first = stored(sets.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = sets.select("fp", F.col("node").alias("b")).join(first, "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    return equal.unionByName(link(first))


def links(sets: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, repeats: bool) -> DataFrame:
    """``a, b``: links whose components are those of all pairs that are similar enough.

    ``sets`` is a stored table, dropped here, with ``node``, ``size``, ``fp``, ``prefix`` and ``odd``, one row for each distinct set; ``nodes`` has ``node, id, h`` of them;
    ``texts`` has ``id, h, text``.
    """
    close = stored(_close(sets), "close")
    rows = sets.select("node", "size", F.posexplode("prefix").alias("place", "key")).select("key", "node", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    order = Window.partitionBy("key").orderBy("at", "node")
    here = F.struct("node", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))
    rows = rows.withColumn("prev", F.lag(here).over(order)).withColumn("lead", F.lead("node").over(order)).withColumn("size", F.shiftright("at", 32))
    # of the texts up to this one in order, those of its step of sizes come last
    rows = rows.withColumn("hub", F.min_by(here, F.shiftleft(-_about("size").cast("long"), 32) + F.col("at").bitwiseAND(F.lit((1 << 32) - 1))).over(order))
    met = stored(rows.filter("prev is not null or lead is not null").select("key", here.alias("me"), "prev", "hub"), "met")
    marks = stored(sets.select("node", "size", "odd"), "marks")
    drop(sets)
    # two shingles of each text, by their hashes, so that near copies mostly take the same ones
    two = met.filter("prev is not null").withColumn("r", F.struct("me", "prev", "hub")).groupBy("me.node").agg(F.min_by("r", F.xxhash64("key")).alias("x"), F.max_by("r", F.xxhash64("key")).alias("y"))
    near = _pairs(_beside(two.select(F.explode(F.array("x", "y")).alias("r")).select("r.*")).unionByName(close))
    found = _confirmed(near, marks, nodes, texts, shingle, repeats)
    drop(close)
    left = stored(_mixed(met, components(found)), "left")
    drop(met)
    beside = _pairs(_beside(left.filter("c <> main")).unionByName(_to_main(left)), near)
    found = found.unionByName(_confirmed(beside, marks, nodes, texts, shingle, repeats))
    mixed = _mixed(left.select("key", "me"), components(found))
    mixed = stored(mixed.withColumn("past", F.lag("key").over(Window.partitionBy("me.node").orderBy("me.place"))), "mixed")
    drop(left)
    off, every = mixed.filter("c <> main").alias("o"), mixed.alias("e")
    far = off.join(every, F.expr(f"o.key = e.key and o.c <> e.c and (e.c = e.main or o.me.node < e.me.node) and not coalesce(o.past = e.past, false) and {_may_link('o.me', 'e.me')}"))
    far = _pairs(far.select(F.col("o.me.node").alias("a"), F.col("e.me.node").alias("b")), near, beside)
    rest = _confirmed(far, marks, nodes, texts, shingle, repeats)
    for table in (near, beside, far, mixed, marks):
        drop(table)
    return found.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One document of each component, the one with the least id, in the documents' own columns.

    A repeated row is a copy like any other: of rows that share the least id, one stays.  Of a component
    whose documents have no id at all, one stays.
    """
    texts = _keyed(docs, id_col, text_col)
    common = _common(docs, text_col, shingle)
    marked = stored(texts.select("id", "h", F.monotonically_increasing_id().alias("n"), _marked(F.col("text"), shingle, *common).alias("_set")).select("id", "h", "n", "_set.*"), "marked")
    first = stored(marked.groupBy("digest").agg(F.min(F.struct("id", "n", "h")).alias("k")).select("k.id", F.col("k.n").alias("node"), "k.h"), "first")
    sets = stored(marked.join(first.select(F.col("node").alias("n")), "n").select(F.col("n").alias("node"), "size", "fp", "prefix", "odd"), "sets")
    rows = stored(marked.select("id", "h", "n"), "rows")
    drop(marked)
    repeats = not rows.groupBy("id", "h").count().filter("count > 1").isEmpty()
    groups = components(links(sets, first, texts, shingle, repeats))
    whole = first.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("c"))
    kept = stored(whole.agg(F.min(F.struct("id", F.col("node").alias("n"), "h")).alias("k")).select("k.*"), "kept")
    gone = stored(rows.join(kept.select("n"), "n", "left_anti").select("id", "h").distinct(), "gone")
    # a key of which one row stays and others go is that of repeated rows: all go, and one comes back
    again = gone.join(kept.select("id", "h"), ["id", "h"], "left_semi")
    stay = texts.join(small(gone), ["id", "h"], "left_anti").select("_row")
    if repeats:
        stay = stay.unionByName(texts.join(small(again), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select("_row"))
    return stay.select("_row.*")
