"""The index in a PostgreSQL database with vectors: its tables, reads of them, and writes in one transaction.

A write goes to staging tables first, by all tasks at once.  When they are whole, the driver's one transaction notes the batch, deletes what the batch replaces or deletes, and moves
the staged rows in, inside the database.  A task that fails, or a driver that dies, before that has changed nothing; a batch that was noted before is not applied again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EMBED_DIM

#: Tables and columns.  Fixed values.
TABLES = {
    "source_document": "source TEXT PRIMARY KEY, fingerprint TEXT NOT NULL, indexed_at TIMESTAMPTZ NOT NULL DEFAULT now()",
    "parent_chunk": "parent_id UUID PRIMARY KEY, parent_text TEXT NOT NULL, source TEXT NOT NULL REFERENCES source_document(source) ON DELETE CASCADE, heading TEXT, parent_index INT, char_len INT",
    "child_chunk": "child_id UUID PRIMARY KEY, parent_id UUID NOT NULL REFERENCES parent_chunk(parent_id) ON DELETE CASCADE, child_text TEXT NOT NULL, embedding vector({dim}) NOT NULL, child_index INT, char_start INT, char_end INT",
}
#: Parameters of the graph index.  Fixed values.
HNSW_M, HNSW_EF_CONSTRUCTION = 16, 64


def ddl(dim: int = EMBED_DIM) -> list[str]:
    """Statements that make what is missing; running them again changes nothing."""
    if dim <= 0:
        raise ValueError("a vector has at least one dimension")
    tables = [f"CREATE TABLE IF NOT EXISTS {name} ({columns.format(dim=dim)})" for name, columns in TABLES.items()]
    near = f"CREATE INDEX IF NOT EXISTS child_embedding_idx ON child_chunk USING hnsw (embedding vector_cosine_ops) WITH (m = {HNSW_M}, ef_construction = {HNSW_EF_CONSTRUCTION})"
    keys = [f"CREATE INDEX IF NOT EXISTS {name} ON {on}" for name, on in (("child_parent_idx", "child_chunk (parent_id)"), ("parent_source_idx", "parent_chunk (source)"))]
    return ["CREATE EXTENSION IF NOT EXISTS vector", *tables, near, *keys]


def read(spark: SparkSession, url: str, table: str, partitions: int = 1, **options: str) -> DataFrame:
    """A table as a DataFrame; filters and columns go to the database.

    With several ``partitions`` its rows are dealt out by ranges of their id, each a query of its own: ids are hashes, so the ranges are of a size.
    Ids and vectors come as text.
    """
    if table not in TABLES:
        raise ValueError(f"unknown table {table}")
    key = {"parent_chunk": "parent_id", "child_chunk": "child_id"}.get(table)
    got = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    if partitions > 1 and key:
        named = next(f'"{c}"' for c in got.columns if c.lower() == key)
        bounds = [f"{(i << 32) // partitions:08x}-0000-0000-0000-000000000000" for i in range(1, partitions)]
        parts = [" AND ".join([f"{named} >= '{a}'"] * (a is not None) + [f"{named} < '{b}'"] * (b is not None)) for a, b in zip([None, *bounds], [*bounds, None])]
        got = spark.read.jdbc(url, table, predicates=parts, properties=options)
    got = got.toDF(*[c.lower() for c in got.columns])
    if "embedding" in got.columns and dict(got.dtypes)["embedding"] == "string":
        got = got.withColumn("embedding", F.from_json("embedding", "array<float>"))
    return got


#: What the writer needs besides: the batches that were applied.
BATCHES = "CREATE TABLE {} (batch VARCHAR(200) NOT NULL PRIMARY KEY)"
_BATCH_TABLE = "tessera_batch"
_COLUMNS = {
    "source_document": ["source", "fingerprint", "indexed_at"],
    "parent_chunk": ["parent_id", "parent_text", "source", "heading", "parent_index", "char_len"],
    "child_chunk": ["child_id", "parent_id", "child_text", "embedding", "child_index", "char_start", "char_end"],
}
_CASTS = {"parent_id": "UUID", "child_id": "UUID", "embedding": "vector"}
_KEYS = "source VARCHAR(4000), parent_id VARCHAR(64), child_id VARCHAR(64), fingerprint VARCHAR(64)"
#: Times that a staging table is written before duplicates in it, which a repeated task leaves, are an error.
ATTEMPTS = 3


class Connection:
    """A connection of the driver, through the JDBC driver that Spark's own reads use."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        jvm = spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for name, value in options.items():
            properties.setProperty(name, value)
        if "driver" in options:
            jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
        self._own = jvm.java.sql.DriverManager.getConnection(url, properties)
        self._own.setAutoCommit(False)

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self._own.rollback()  # what was not committed
        self._own.close()

    def run(self, sql: str, *values: str) -> int:
        statement = self._own.prepareStatement(sql)
        try:
            for i, value in enumerate(values):
                statement.setString(i + 1, value)
            return statement.executeUpdate()
        finally:
            statement.close()

    def number(self, sql: str, *values: str) -> int:
        statement = self._own.prepareStatement(sql)
        try:
            for i, value in enumerate(values):
                statement.setString(i + 1, value)
            rows = statement.executeQuery()
            rows.next()
            return rows.getLong(1)
        finally:
            statement.close()

    def has(self, table: str) -> bool:
        meta = self._own.getMetaData()
        return any(meta.getTables(None, None, name, None).next() for name in (table.lower(), table.upper()))

    def commit(self) -> None:
        self._own.commit()


def initialize(spark: SparkSession, url: str, statements: list[str] | None = None, **options: str) -> None:
    """Makes the tables that are missing, in one transaction; ``statements`` by default those of ``ddl``."""
    with Connection(spark, url, options) as db:
        for sql in ddl() if statements is None else statements:
            db.run(sql)
        if not db.has(_BATCH_TABLE):
            db.run(BATCHES.format(_BATCH_TABLE))
        db.commit()


def _staged(rows: DataFrame, url: str, name: str, key: str, options: dict[str, str]) -> None:
    """Rows in a staging table, each once, whatever was there."""
    spark = rows.sparkSession
    kinds = ", ".join(k for k in _KEYS.split(", ") if k.split(" ")[0] in rows.columns)
    for _ in range(ATTEMPTS):
        rows.write.format("jdbc").mode("overwrite").options(url=url, dbtable=name, createTableColumnTypes=kinds, **options).save()
        with Connection(spark, url, options) as db:
            if db.number(f"SELECT COUNT(*) - COUNT(DISTINCT \"{key}\") FROM {name}") == 0:
                return
    raise ValueError(f"{key} is not unique in what is written to {name}")


def replace(ledger: DataFrame, parents: DataFrame, children: DataFrame, gone: DataFrame, url: str, batch: str, **options: str) -> bool:
    """Replaces the sources of ``ledger`` and deletes those of ``gone``, all in one transaction; False if the batch was applied before.

    ``children`` have ``embedding`` (an array).  Speculative execution should be off while staging tables are written.
    """
    spark = ledger.sparkSession
    with Connection(spark, url, options) as db:
        if db.number(f"SELECT COUNT(*) FROM {_BATCH_TABLE} WHERE batch = ?", batch):
            return False
    mark = hashlib.sha256(batch.encode()).hexdigest()[:12]
    vector = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    staged = {
        "source_document": (ledger, "source"), "parent_chunk": (parents, "parent_id"), "child_chunk": (children.withColumn("embedding", vector), "child_id"),
        "gone": (ledger.select("source").unionByName(gone.select("source")).distinct(), "source"),
    }
    name = {table: f"stage_{mark}_{table}" for table in staged}
    try:
        for table, (rows, key) in staged.items():
            _staged(rows.select(*_COLUMNS.get(table, ["source"])), url, name[table], key, options)
        quote = '"{}"'.format  # as Spark names the columns of a table that it makes
        cast = (lambda c: f"CAST({quote(c)} AS {_CASTS[c]})" if c in _CASTS else quote(c)) if url.startswith("jdbc:postgresql") else quote
        touched = f"SELECT {quote('source')} FROM {name['gone']}"
        with Connection(spark, url, options) as db:
            try:
                db.run(f"INSERT INTO {_BATCH_TABLE} (batch) VALUES (?)", batch)
            except Exception:  # the key is taken: another writer was applying the same batch
                if db.number(f"SELECT COUNT(*) FROM {_BATCH_TABLE} WHERE batch = ?", batch):
                    return False
                raise
            db.run(f"DELETE FROM child_chunk WHERE parent_id IN (SELECT parent_id FROM parent_chunk WHERE source IN ({touched}))")
            for table in ("parent_chunk", "source_document"):
                db.run(f"DELETE FROM {table} WHERE source IN ({touched})")
            for table, columns in _COLUMNS.items():
                db.run(f"INSERT INTO {table} ({', '.join(columns)}) SELECT {', '.join(map(cast, columns))} FROM {name[table]}")
            db.commit()
    finally:
        with Connection(spark, url, options) as db:
            for table in name.values():
                if db.has(table):
                    db.run(f"DROP TABLE {table}")
            db.commit()
    return True
