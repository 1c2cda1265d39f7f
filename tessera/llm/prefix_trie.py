"""Prefix trie of conversations, families first.

A conversation's family is named by its base id, c - c % 100.  Its turns are rebuilt: the first h turns of the base conversation, then its own
turns after its first h, where h = crc32(decimal c) % 6.  A node of the trie is a sequence of first turns that some rebuilt
conversations share.

1. The scan makes 16 bytes (MD5 of role and text) and the length of each turn, so no text is moved.  The first
   turns of base conversations are cut out by a window that keeps five rows a conversation before the shuffle.
2. Conversations are cogrouped with the first turns of their base by base id.  Each family is rebuilt into one row of paths: a node's name is the XOR, over the turns that
   lead to it, of two hashes of (place, turn), with its depth: 128 bits.  Such names need no order of work, so a path can be named in pieces.
3. Each family's small trie is built from its paths: a row for each node with its members counted, its least member, how many end there, and who.
   Only these combined rows are shuffled, summed before and after.
4. Sums over subtrees need no walk.  A node belongs to its least member; what belongs to a conversation is an end of its path, from some depth
   on.  The sum over the different nodes below v of any figure is then a sum over v's members of what belongs to each from v's depth on.  So the
   merged nodes tell each conversation the depth from which it owns its path, and whether it owns a leaf; a second
   round of family tries sums these, and the rows are merged like the first ones.
5. The members that end at a node are hashed as a stream: families are ranges of ids, so a family's list is one row, and a worker that reads
   a node's rows in order holds one family at a time.

A conversation of more than ``LONG`` turns is not put into one group.  Its turns are sorted by ranges over many tasks; counts, XORs and
lengths of the pieces in each task are added up from piece to piece, and within a piece by windows.

Defined cases: rows with a null conv_id take no part; null turns come first; turns of one number, repeated rows among them, are ordered by the
MD5 of length of role, role and text, and each of them is a turn; null or empty roles and texts are
empty ones; an empty table gives no rows, not even a root; texts of any length count whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, forget, shuffle_partitions, small, stored, trim

FAMILY = 100
#: h is less than this.
HEADS = 6
#: Turns of a conversation that go into its family's group.
LONG = 4000
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_FAMILY = T.StructType([T.StructField("base", T.LongType()), T.StructField("conv", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("y", T.ArrayType(T.LongType())), T.StructField("chars", T.ArrayType(T.LongType()))])
_NODES = "x long, y long, depth int, px long, py long, chars long, n_convs long, least long, n_ends long, base long, ends array<long>"
_EMPTY = hashlib.sha256(b"").hexdigest()


def shared_head(conv: int) -> int:
    """How many first turns of the base a conversation starts with."""
    return zlib.crc32(str(conv).encode()) % HEADS


def _head_column(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _base(conv: Column) -> Column:
    return conv - conv % FAMILY


def turn_names(digests: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each (place, turn); ``digests`` has two unsigned longs a turn."""
    out = []
    for lane in (0, 1):
        h = digests[:, lane] + places.astype(np.uint64) * _MIX[2 + lane]
        for k in (0, 1):
            h = (h ^ h >> np.uint64(30 - 3 * k)) * _MIX[k]
        h ^= digests[:, 1 - lane] * _MIX[3 - lane]
        h = (h ^ h >> np.uint64(29)) * _MIX[lane]
        out.append(h ^ h >> np.uint64(32))
    return out[0], out[1]


def _digests(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


# -- families ---------------------------------------------------------------------------------------------------


def rebuilt(own: pa.Table, head: pa.Table) -> pa.Table:
    """One family: its conversations' turns (``c, turn, digest, chars``) and its base's first turns -> one row of paths."""
    forget()
    by = [("c", "ascending"), ("turn", "ascending"), ("digest", "ascending")]
    own = own.take(pc.sort_indices(own, by, null_placement="at_start"))
    base = own["base"][0].as_py()
    head = head.sort_by("place")
    first, first_chars = _digests(head["digest"]), head["chars"].to_numpy()
    conv, digest, chars = own["c"].to_numpy(), _digests(own["digest"]), own["chars"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    sizes, xs, ys, lengths = [], [], [], []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(conv)], strict=True):
        h = shared_head(int(conv[a]))
        turns, length = np.concatenate([first[:h], digest[a + h : b]]), np.concatenate([first_chars[:h], chars[a + h : b]])
        x, y = turn_names(turns, np.arange(1, len(turns) + 1))
        sizes.append(len(turns))
        xs.append(np.bitwise_xor.accumulate(x))
        ys.append(np.bitwise_xor.accumulate(y))
        lengths.append(length)
    row = [base, conv[begin].tolist(), sizes, np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64), np.concatenate(lengths)]
    return pa.table([pa.array([v], kind) for v, kind in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3), strict=True)], names=_FAMILY.names)


def _trie(batch: pa.RecordBatch, i: int) -> tuple:
    """A family's paths with their roots: conversation ids and path lengths, and for each step its conversation's number, depth, lanes, length; and
    the family's nodes: which is each step's, and a step of each."""
    lists = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in _FAMILY.names[1:]}
    conv, n = lists["conv"], lists["n"].astype(np.int64)
    of = np.repeat(np.arange(len(conv)), n + 1)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    x, y, chars = (np.zeros(len(of), np.int64) for _ in range(3))
    x[depth > 0], y[depth > 0], chars[depth > 0] = lists["x"], lists["y"], lists["chars"]
    order = np.lexsort((y, x, depth))
    new = np.ones(len(of), bool)
    new[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in (depth, x, y)], axis=0)
    node = np.empty(len(of), np.int64)
    node[order] = np.cumsum(new) - 1
    step = order[new]
    return conv, n, of, depth, x, y, chars, node, step


def _nodes(batches):
    """Families -> their tries' nodes."""
    for batch in batches:
        for i in range(batch.num_rows):
            conv, n, of, depth, x, y, chars, node, step = _trie(batch, i)
            size = len(step)
            least = np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(least, node, conv[of])
            last = depth == n[of]
            ends = np.bincount(node[last], minlength=size)
            order = np.lexsort((conv[of[last]], node[last]))
            offsets = np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)
            past = np.maximum(step - 1, 0)  # the step before, of the same path
            inner = depth[step] > 0
            columns = [
                x[step], y[step], depth[step].astype(np.int32), np.where(inner, x[past], 0), np.where(inner, y[past], 0), chars[step], np.bincount(node, minlength=size), least, ends,
                np.full(size, batch.column("base")[i].as_py()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(conv[of[last]][order])),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["x", "y", "depth", "px", "py", "chars", "n_convs", "least", "n_ends", "base", "ends"])
    trim()


def _subtree(batches):
    """Families with what their conversations own (``owned``: conv, depth, leaf) -> for each node, the sums over its members."""
    for batch in batches:
        for i in range(batch.num_rows):
            conv, n, of, depth, x, y, chars, node, step = _trie(batch, i)
            own, leaf = np.full(len(conv), np.iinfo(np.int64).max), np.zeros(len(conv), np.int64)
            for o in batch.column("owned")[i].as_py() or ():
                at = np.searchsorted(conv, o["conv"])
                if at < len(conv) and conv[at] == o["conv"]:
                    own[at], leaf[at] = o["depth"], o["leaf"]
            total = np.concatenate([[0], np.cumsum(chars)])
            end = np.cumsum(n + 1)[of]
            here = np.arange(len(of))
            owned_from = np.minimum(here + np.maximum(0, np.minimum(own[of], n[of] + 1) - depth), end)
            saved = total[owned_from] - total[here]  # the lengths from here on, but those that the conversation owns
            sums = [np.zeros(len(step), np.int64), np.zeros(len(step), np.int64)]
            np.add.at(sums[0], node, saved)
            np.add.at(sums[1], node, leaf[of])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[step], y[step], depth[step].astype(np.int32), *sums)], ["x", "y", "depth", "saved", "leaves"])
    trim()


# -- conversations too long for a group ---------------------------------------------------------------------------


def _pieces(batches):
    """Sorted turns of a task -> the same, with the task's number and the place in the task's piece of the conversation."""
    from pyspark import TaskContext

    task, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("c").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])) if len(conv) else np.zeros(0, int)
        place = np.arange(len(conv)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(conv)]])))
        if len(conv) and conv[0] == last:
            place[: begin[1] if len(begin) > 1 else len(conv)] += count
        if len(conv):
            last, count = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), task, np.int32)), batch.column("c"), pa.array(place.astype(np.int64)), batch.column("digest"), batch.column("chars")], ["piece", "c", "place", "digest", "chars"])


def _named(digest: Column, depth: Column) -> Column:
    @F.arrow_udf("x long, y long")
    def udf(digest: pa.Array, depth: pa.Array) -> pa.Array:
        x, y = turn_names(_digests(digest), depth.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

    return udf(digest, depth)


def _carried(rows: DataFrame, *sums: Column) -> DataFrame:
    """What the pieces before each one add up to: a row for each piece; ``sums`` are windowless aggregates with names."""
    each = rows.groupBy("c", "piece").agg(*sums)
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    names = [n for n in each.columns if n not in ("c", "piece")]
    plus = lambda n: F.bit_xor(n) if n in ("x", "y") else F.sum(n)
    return each.select("c", "piece", *[F.coalesce(plus(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names])


def _long_paths(turns: DataFrame, heads: DataFrame, partitions: int) -> DataFrame:
    """Long conversations' paths, a row for each step: ``c, depth, x, y, px, py, chars, so_far, last`` (``so_far``: length up to and with it)."""
    order = ["c", F.col("turn").asc_nulls_first(), "digest", "n"]
    dealt = turns.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    pieces = stored(dealt.select("c", "digest", "chars").mapInArrow(_pieces, "piece int, c long, place long, digest binary, chars long"), "pieces")
    started = pieces.join(small(_carried(pieces, F.count("*").alias("m"))), ["c", "piece"]).select("piece", "c", "digest", "chars", (F.col("place") + F.col("m_before") + 1).alias("j"))
    convs = pieces.select("c").distinct().select("c", _head_column(F.col("c")).alias("h"))
    given = convs.join(heads, (_base(F.col("c")) == F.col("base")) & (F.col("place") <= F.col("h"))).select("c", "h", "place", "digest", "chars")
    shift = convs.join(given.groupBy("c").agg(F.count("*").alias("m")), "c", "left").select("c", "h", (F.col("h") - F.coalesce("m", F.lit(0))).alias("shift"))
    own = started.join(small(shift), "c").filter("j > h").select("piece", "c", (F.col("j") - F.col("shift")).cast("int").alias("depth"), "digest", "chars")
    every = given.select(F.lit(-1).alias("piece"), "c", F.col("place").alias("depth"), "digest", "chars").unionByName(own)
    named = stored(every.select("piece", "c", "depth", "chars", _named(F.col("digest"), F.col("depth")).alias("t")).select("piece", "c", "depth", "chars", "t.x", "t.y"), "named")
    carry = _carried(named, F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("chars").alias("chars"))
    ends = named.groupBy("c").agg(F.max("depth").alias("end"))
    here = Window.partitionBy("c", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = named.select("piece", "c", "depth", "chars", F.col("x").alias("own_x"), F.col("y").alias("own_y"), F.bit_xor("x").over(here).alias("x"), F.bit_xor("y").over(here).alias("y"), F.sum("chars").over(here).alias("so_far"))
    rows = rows.join(small(carry), ["c", "piece"]).join(small(ends), "c")
    x, y = F.col("x").bitwiseXOR(F.col("x_before")), F.col("y").bitwiseXOR(F.col("y_before"))
    paths = rows.select("c", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("own_x")).alias("px"), y.bitwiseXOR(F.col("own_y")).alias("py"), "chars", (F.col("so_far") + F.col("chars_before")).alias("so_far"), (F.col("depth") == F.col("end")).alias("last"))
    nothing = F.lit(0).cast("long")
    roots = convs.join(ends, "c", "left").select("c", F.lit(0).alias("depth"), *[nothing.alias(n) for n in ("x", "y", "px", "py", "chars", "so_far")], F.col("end").isNull().alias("last"))
    return stored(paths.unionByName(roots), "long-paths")


def _long_nodes(paths: DataFrame) -> DataFrame:
    end = F.col("last")
    return paths.select("x", "y", "depth", "px", "py", "chars", F.lit(1).cast("long").alias("n_convs"), F.col("c").alias("least"), end.cast("long").alias("n_ends"), _base(F.col("c")).alias("base"), F.when(end, F.array("c")).otherwise(F.array().cast("array<long>")).alias("ends"))


def _long_subtree(paths: DataFrame, owned: DataFrame) -> DataFrame:
    ends = paths.filter("last").select("c", F.col("so_far").alias("total"))
    own = ends.join(owned, ends.c == owned.conv, "left").select("c", "total", F.coalesce("depth", F.lit((1 << 31) - 1)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    until = paths.join(own.select("c", "own"), "c").filter("depth < own").groupBy("c").agg(F.max("so_far").alias("until"))  # the length that others own
    own = own.join(until, "c", "left").select("c", "total", F.coalesce("until", F.lit(0)).alias("until"), "leaf")
    rest = F.col("until") - (F.col("so_far") - F.col("chars"))
    return paths.join(small(own), "c").select("x", "y", "depth", F.greatest(rest, F.lit(0)).alias("saved"), F.col("leaf").cast("long").alias("leaves"))


# -- the whole -------------------------------------------------------------------------------------------------


def _hashed(batches):
    """Rows of (node, base, ends), sorted by node and base -> SHA-256 of each node's ids; a family is held at a time."""
    key, base, ids, digest, some = None, None, [], None, False
    out = []

    def flush():
        nonlocal ids, some
        if ids:
            digest.update((("," if some else "") + ",".join(map(str, sorted(ids)))).encode())
            ids, some = [], True

    for batch in batches:
        for x, y, depth, family, ends in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "depth", "base", "ends")), strict=True):
            if (x, y, depth) != key:
                if key is not None:
                    flush()
                    out.append((*key, digest.hexdigest()))
                key, base, digest, some = (x, y, depth), family, hashlib.sha256(), False
            elif family != base:
                flush()
                base = family
            ids += ends
        if out:
            yield _hashes(out)
            out = []
    if key is not None:
        flush()
        yield _hashes([(*key, digest.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["x", "y", "depth", "sha"])


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG) -> DataFrame:
    """A row for each node: ``conv_id`` (its least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = conversations.sparkSession
    parts = shuffle_partitions(spark)
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    turns = written = stored(turns.withColumn("base", _base(F.col("c"))), "turns")
    first = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = turns.filter("c = base").withColumn("place", F.row_number().over(first)).filter(F.col("place") < HEADS).select("base", "place", "digest", "chars")
    heads = stored(heads, "heads")
    lengthy = stored(turns.groupBy("c").agg(F.count("*").alias("m")).filter(F.col("m") > long).select("c"), "lengthy")
    paths = None
    if not lengthy.isEmpty():
        paths = _long_paths(turns.join(small(lengthy), "c", "left_semi"), heads, parts)
        turns = turns.join(small(lengthy), "c", "left_anti")
    families = turns.groupBy("base").cogroup(heads.groupBy("base")).applyInArrow(lambda own, head: rebuilt(own, head) if own.num_rows else _FAMILY_EMPTY, _FAMILY)
    families = stored(families, "families")
    drop(written)
    every = families.mapInArrow(_nodes, _NODES)
    every = stored(every if paths is None else every.unionByName(_long_nodes(paths)), "family-nodes")
    name = ["x", "y", "depth"]
    merged = every.groupBy(*name).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"), F.sum("n_ends").alias("n_ends"))
    merged = stored(merged, "nodes")
    owned = merged.groupBy(F.col("least").alias("conv")).agg(F.min("depth").alias("depth"), F.max((F.col("n_ends") == F.col("n_convs")).cast("int")).alias("leaf"))
    owned = stored(owned, "owned")
    of_family = owned.groupBy(_base(F.col("conv")).alias("base")).agg(F.collect_list(F.struct("conv", "depth", "leaf")).alias("owned"))  # a family's ids at most
    sums = families.join(of_family, "base", "left").mapInArrow(_subtree, "x long, y long, depth int, saved long, leaves long")
    sums = sums if paths is None else sums.unionByName(_long_subtree(paths, owned))
    ends = every.filter("n_ends > 0").select(*name, "base", "ends").repartition(parts, *name).sortWithinPartitions(*name, "base")
    ends = ends.mapInArrow(_hashed, "x long, y long, depth int, sha string")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    own = merged.select(*name, "px", "py", "least", "n_convs", *none("long", "child", "saved", "leaves"), *none("string", "sha"))
    child = merged.filter("depth > 0").select(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("depth") - 1).alias("depth"), *none("long", "px", "py", "least", "n_convs"), F.lit(1).cast("long").alias("child"), *none("long", "saved", "leaves"), *none("string", "sha"))
    summed = sums.select(*name, *none("long", "px", "py", "least", "n_convs", "child"), "saved", "leaves", *none("string", "sha"))
    hashed = ends.select(*name, *none("long", "px", "py", "least", "n_convs", "child", "saved", "leaves"), "sha")
    whole = own.unionByName(child).unionByName(summed).unionByName(hashed).groupBy(*name).agg(*[F.max(n).alias(n) for n in ("px", "py", "least", "n_convs", "sha")], *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("child", "saved", "leaves")])
    above = merged.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    return whole.withColumn("px", F.when(F.col("depth") > 0, F.col("px"))).join(above, ["px", "py", "depth"], "left").select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("child").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256")
    )


_FAMILY_EMPTY = pa.table({n: pa.array([], pa.int64() if n == "base" else pa.list_(pa.int32() if n == "n" else pa.int64())) for n in _FAMILY.names})
