"""The index as a log of segments: a write costs what it brings, whatever the store holds.

A commit adds one segment: Parquet folders of its ledger, parents and children, of ``touched``, the sources that it replaces or
deletes, and of ``terms``, the signed change that it makes to the term statistics.  Nothing written before is changed.  A row
counts unless a later segment touched its source, which a read settles by an anti join against the sources touched since (merge on read).

Versions are numbered manifests, each naming the segments that hold.  The next number is taken by an operation that fails if it is taken, so of two
writers one has to try again; its segment is written already and only gets a later number, so both commit.  A writer that dies
before has changed nothing that a reader can see.

When the newest segments have grown to the size of the one before them, they are merged (size-tiered compaction): each row is rewritten a number of
times that grows with the logarithm of the store.  What no source counts any more is dropped then.

Statistics are kept up with the log: document frequencies, number and length of the children are sums over the segments' signed changes.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, under_root
from .index import LEDGER
from .lexical import weighed

#: Columns of the tables; children have an ``embedding`` too where one was made.
TABLES = {
    "ledger": LEDGER,
    "parents": "source string, parent_index int, heading string, parent_text string, char_len int, parent_id string",
    "children": "parent_id string, source string, parent_index int, child_index int, char_start int, char_end int, child_text string, child_id string",
}
TOUCHED = "source string"
TERMS = "term string, df long, n long, length long"
#: Newest segments that are merged at a time, at least.
FAN = 4
#: Touched sources that are sent to every task of a read; beyond, both sides are shuffled.
SENT = 500_000
#: Sources that are looked up as literals, which the scan of a sorted table skips by.
LITERALS = 1000
#: Rows of a merged table from which ids get Bloom filters.
BLOOM = 100_000
RETRIES = 50


@dataclass(frozen=True)
class Segment:
    """``number``: the version that brought it; ``rows`` and ``schemas`` by table; ``least`` and ``greatest`` touched source; ``terms``: the folder of that table."""

    number: int
    folder: str
    rows: dict[str, int]
    schemas: dict[str, str]
    size: int
    least: str | None
    greatest: str | None
    terms: str = "terms"

    def may_hold(self, source: str) -> bool:
        return self.least is not None and self.least <= source <= self.greatest


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[Segment, ...]


class Conflict(RuntimeError):
    """What was to be replaced isn't there any more."""


class Store:
    """Ledger, parents and children under ``path``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, statistics: bool = True, fan: int = FAN):
        self.spark, self.path, self.statistics, self.fan = spark, path.rstrip("/"), statistics, fan
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions ----------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> int | None:
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def at(self, number: int | None = None) -> Version:
        """A version, by default the last; before the first, an empty one of number 0."""
        number = self.version() if number is None else number
        if number is None:
            return Version(0, ())
        stream = self._fs.open(self._path(f"manifests/{number}.json"))
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, tuple(Segment(**s) for s in told["segments"]))

    def _publish(self, version: Version) -> bool:
        """Makes a version the current one; False if its number is taken.

        A whole file appears under the number, or none: by a hard link on a local disk, a conditional put in stores of objects, elsewhere by a
        renaming, which doesn't replace.
        """
        body = json.dumps({"segments": [asdict(s) for s in version.segments]}).encode()
        folder, final = self._path("manifests"), self._path(f"manifests/{version.number}.json")
        self._fs.mkdirs(folder)
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            to = final.toUri().getPath()
            aside = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
            with open(aside, "xb") as f:
                f.write(body)
            try:
                os.link(aside, to)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        if scheme in ("s3a", "gs"):
            try:
                stream = self._fs.createFile(final).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
                stream.write(bytearray(body))
                stream.close()
            except Exception as e:
                if "FileAlreadyExists" in str(e) or "412" in str(e):
                    return False
                raise
            return True
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            self._fs.delete(aside, False)
            return False
        return True

    def _commit(self, change: Callable[[Version], tuple[Segment, ...]]) -> int:
        """Publishes what ``change`` makes of the last version; when another writer was first, of the one after."""
        for attempt in range(RETRIES):
            now = self.at()
            if self._publish(Version(now.number + 1, change(now))):
                return now.number + 1
            time.sleep(random.uniform(0, min(2.0, 0.02 * 2**attempt)))
        raise Conflict(f"{RETRIES} other writers were first")

    def initialize(self) -> int:
        """An empty store, unless there is one already."""
        number = self.version()
        if number is None:
            self._publish(Version(1, ()))
        return self.version()

    # -- reads -------------------------------------------------------------------------------------------------

    def _own(self, segment: Segment, table: str) -> DataFrame:
        schema = segment.schemas[table]
        if not segment.rows[table]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment.folder}/{segment.terms if table == 'terms' else table}")

    def _all(self, segments, table: str) -> DataFrame:
        """Rows of some segments with ``_seq``; a table that none has is empty."""
        found = None
        for s in segments:
            if s.rows.get(table):
                rows = self._own(s, table).withColumn("_seq", F.lit(s.number).cast("long"))
                found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        if found is None:
            schema = {**TABLES, "touched": TOUCHED, "terms": TERMS}[table] if not segments else segments[-1].schemas[table]
            found = self.spark.createDataFrame([], schema).withColumn("_seq", F.lit(0).cast("long"))
        return found

    def _live(self, segments, table: str, only=None) -> DataFrame:
        """Rows of the segments that none of the later ones touched.  ``only``: a condition on ``source`` that goes to all scans."""
        where = (lambda df: df) if only is None else (lambda df: df.filter(only))
        *older, last = segments or [None]
        newest = self._all([last] if last else [], table).drop("_seq")
        if not older:
            return where(newest)
        shadow = where(self._all(segments[1:], "touched")).groupBy(F.col("source").alias("_source")).agg(F.max("_seq").alias("_since"))
        if sum(s.rows["touched"] for s in segments[1:]) <= SENT:
            shadow = F.broadcast(shadow)
        rows = where(self._all(older, table))
        rows = rows.join(shadow, (F.col("source") == F.col("_source")) & (F.col("_seq") < F.col("_since")), "left_anti").drop("_seq")
        return rows.unionByName(where(newest), allowMissingColumns=True)

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """A table of the current version, or of one before that wasn't vacuumed; None before the first one."""
        version = self.at(number)
        return None if not version.number else self._live(version.segments, table)

    def of_source(self, table: str, source: str) -> DataFrame:
        """Rows of one source: only segments whose range of sources holds it are read, and only the parts of them that may."""
        return self._live([s for s in self.at().segments if s.may_hold(source)], table, F.col("source") == source)

    def fingerprint(self, source: str) -> str | None:
        """Fingerprint of a source, or None if it isn't indexed."""
        row = self.of_source("ledger", source).select("fingerprint").first()
        return None if row is None else row.fingerprint

    def sources(self, root: str) -> DataFrame:
        """Sources at or below a root."""
        return self._live(self.at().segments, "ledger").filter(under_root(F.col("source"), F.lit(root))).select("source")

    def parent(self, parent_id: str) -> DataFrame:
        """The parent with an id: the equality reaches the scans, where ranges and Bloom filters skip."""
        return self._live(self.at().segments, "parents").filter(F.col("parent_id") == parent_id)

    def parents(self, ids: DataFrame) -> DataFrame:
        """Parents with the ids asked for (``parent_id``); ids that aren't there give no row."""
        return self._live(self.at().segments, "parents").join(ids.select("parent_id").distinct(), "parent_id", "left_semi")

    def vectors(self, ids: DataFrame) -> DataFrame:
        """``child_id, embedding`` of the children asked for that are there and have a vector."""
        rows = self._live(self.at().segments, "children")
        if "embedding" not in rows.columns:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        return rows.filter("embedding is not null").join(ids.select("child_id").distinct(), "child_id", "left_semi").select("child_id", "embedding")

    def terms(self, number: int | None = None) -> DataFrame:
        """``term, df, idf, avg_len`` over all children, from the segments' changes: what ``lexical.fit`` counts from scratch."""
        if not self.statistics:
            raise ValueError("this store keeps no statistics")
        changes = self._all(self.at(number).segments, "terms")
        totals = changes.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("avg_len"))
        return weighed(changes.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"), totals)

    # -- writes ------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, folder: str, table: str, rows: int = 0) -> tuple[int, str]:
        writer = df.write
        if rows >= BLOOM:
            for name in ("parent_id", "child_id"):
                if name in df.columns:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", str(rows))
        writer.parquet(f"{self.path}/{folder}/{table}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{table}").count(), schema

    def _segment(self, folder: str, written: dict[str, tuple[int, str]], number: int = 0) -> Segment:
        """What a manifest says of a segment whose tables are written."""
        touched = self.spark.read.schema(TOUCHED).parquet(f"{self.path}/{folder}/touched") if written["touched"][0] else self.spark.createDataFrame([], TOUCHED)
        held = touched if not written["ledger"][0] else touched.unionByName(self.spark.read.schema("source string").parquet(f"{self.path}/{folder}/ledger"))
        least, greatest = held.agg(F.min("source"), F.max("source")).first()
        size = self._fs.getContentSummary(self._path(folder)).getLength()
        return Segment(number, folder, {t: n for t, (n, _) in written.items()}, {t: s for t, (_, s) in written.items()}, size, least, greatest)

    def _changed_terms(self, version: Version, folder: str, touched: DataFrame, n_touched: int) -> DataFrame:
        """The signed change of the statistics: the segment's children come, those that the version has of the touched sources go."""
        only = None
        segments = version.segments
        if n_touched <= LITERALS:
            asked = [r.source for r in touched.collect()]
            segments = [s for s in segments if any(s.may_hold(x) for x in asked)]
            only = F.col("source").isin(asked)
        old = self._live(segments, "children", only).select("source", "child_text")
        if n_touched > LITERALS:
            old = old.join(F.broadcast(touched) if n_touched <= SENT else touched, "source", "left_semi")
        new = self.spark.read.schema(TABLES["children"]).parquet(f"{self.path}/{folder}/children")
        said = lambda df, sign: df.select(tokens(F.col("child_text")).alias("t"), F.lit(sign).alias("sign"))
        both = said(new, 1).unionByName(said(old, -1))
        each = both.select(F.explode(F.array_distinct("t")).alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).filter("df <> 0")
        totals = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("t") * F.col("sign")), F.lit(0)).alias("length"))
        none, nothing = F.lit(None).cast("string").alias("term"), F.lit(0).cast("long")
        return each.select("term", "df", nothing.alias("n"), nothing.alias("length")).unionByName(totals.select(none, nothing.alias("df"), "n", "length"))

    def sync(self, new_ledger: DataFrame, new_parents: DataFrame, new_children: DataFrame | Callable[[DataFrame], DataFrame], gone: DataFrame) -> int:
        """Replaces the sources of ``new_ledger`` and deletes those of ``gone``; doing it twice changes nothing.

        ``new_children``: a function makes them of the parents as they are written, so that these aren't made twice.
        """
        folder = f"segments/{uuid.uuid4().hex}"
        written = {}
        for name, rows in (("ledger", new_ledger), ("parents", new_parents), ("children", new_children)):
            rows = rows(self.spark.read.schema(written["parents"][1]).parquet(f"{self.path}/{folder}/parents")) if callable(rows) else rows
            written[name] = self._write(rows.sortWithinPartitions("source"), folder, name)
        ledger = self.spark.read.schema(LEDGER).parquet(f"{self.path}/{folder}/ledger")
        written["touched"] = self._write(ledger.select("source").unionByName(gone.select("source")).distinct().sortWithinPartitions("source"), folder, "touched")
        touched, n = self.spark.read.schema(TOUCHED).parquet(f"{self.path}/{folder}/touched"), written["touched"][0]
        segment = counted_at = None

        def change(now: Version) -> tuple[Segment, ...]:
            nonlocal segment, counted_at
            if segment is None or self.statistics and self._others(counted_at, now, segment, touched):
                at = f"terms-{uuid.uuid4().hex}"
                if self.statistics:
                    written["terms"] = self._write(self._changed_terms(now, folder, touched, n), folder, at)
                segment, counted_at = replace(self._segment(folder, {"terms": (0, TERMS), **written}), terms=at), now
            return (*now.segments, replace(segment, number=now.number + 1))

        number = self._commit(change)
        while self.compact():
            pass
        return number

    def _others(self, then: Version, now: Version, mine: Segment, touched: DataFrame) -> bool:
        """Whether a segment that came between touched a source of ours, so that our changes of the statistics are out of date."""
        came = [s for s in now.segments if s.number > then.number and s.least is not None and mine.least is not None and s.least <= mine.greatest and mine.least <= s.greatest]
        return bool(came) and not self._all(came, "touched").join(touched, "source", "left_semi").isEmpty()

    def _due(self, segments: tuple[Segment, ...]) -> tuple[Segment, ...]:
        """The newest segments up to one that is larger than all after it together, if there are enough."""
        run, size = list(segments[-1:]), sum(s.size for s in segments[-1:])
        for s in reversed(segments[:-1]):
            if s.size > size:
                break
            run, size = [s, *run], size + s.size
        return tuple(run) if len(run) >= self.fan else ()

    def compact(self, whole: bool = False) -> bool:
        """Merges the newest segments, if enough of a size have come (``whole``: all); returns whether it did."""
        now = self.at()
        run = now.segments if whole and len(now.segments) > 1 else self._due(now.segments)
        if not run:
            return False
        folder, first = f"segments/{uuid.uuid4().hex}", run[0] == now.segments[0]
        written = {}
        for name in TABLES:
            rows = self._live(run, name)
            written[name] = self._write(rows.repartitionByRange("source").sortWithinPartitions("source"), folder, name, sum(s.rows[name] for s in run))
        touched = self._all(run, "touched").select("source").distinct()
        written["touched"] = self._write((touched.limit(0) if first else touched).sortWithinPartitions("source"), folder, "touched")  # nothing is older than the first
        if any(s.rows["terms"] for s in run):
            terms = self._all(run, "terms").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "length")]).filter("df <> 0 or term is null")
            written["terms"] = self._write(terms, folder, "terms")
        merged = self._segment(folder, {"terms": (0, TERMS), **written}, run[-1].number)

        def change(now: Version) -> tuple[Segment, ...]:
            gone = {s.folder for s in run}
            if not gone <= {s.folder for s in now.segments}:
                raise Conflict("another writer has merged these segments")
            at = next(i for i, s in enumerate(now.segments) if s.folder == run[0].folder)
            return (*now.segments[:at], merged, *(s for s in now.segments[at:] if s.folder not in gone))

        try:
            self._commit(change)
        except Conflict:
            self._fs.delete(self._path(folder), True)
            return False
        return True

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Removes manifests but the last ``keep``, and segments that none left names and that are so many seconds old, so that nobody is still
        writing them; returns how many segments."""
        numbers = self._numbers()
        live = {s.folder.split("/")[1] for n in numbers[-keep:] for s in self.at(n).segments}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"manifests/{n}.json"), False)
        if not self._fs.exists(self._path("segments")):
            return 0
        until = (time.time() - older_than) * 1000
        dead = [f.getPath() for f in self._fs.listStatus(self._path("segments")) if f.getPath().getName() not in live and f.getModificationTime() <= until]
        for folder in dead:
            self._fs.delete(folder, True)
        return len(dead)
