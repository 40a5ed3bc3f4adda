"""Tables that grow by batches, where a batch counts as a whole or not at all.

A batch writes its parts of any number of tables into folders of its own and, when all are there, one commit
record. Readers take the parts that records name, so they never see half a batch, and a batch that was
killed and runs again leaves each row once: what the lost run wrote is named by no record. One writer at a time.

``KeyIndex`` keeps the keys stored so far beside such a table, in sorted runs of hash buckets. A batch is dealt by its
keys once and meets the runs where they lie: the runs are not shuffled, and of a small batch only the buckets that it touches are
read. Runs are merged by levels, so their number grows with the logarithm of the number of batches.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.operators.ordering import first_per_key

_RECORD = "seq long, batch string, table string, part string, level int, live boolean, buckets int, columns string"
BUCKETS, FANOUT = 64, 4
NAMED = 1000  # rows of a batch up to which its buckets are picked by name


@dataclass(frozen=True)
class Part:
    """A committed folder: its place, level (of runs; else 0), number of buckets (0: none) and schema."""

    path: str
    level: int
    buckets: int
    schema: StructType


class Store:
    """Tables below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], _RECORD).write.mode("ignore").parquet(f"{self.root}/log/first")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_RECORD).option("recursiveFileLookup", "true").parquet(f"{self.root}/log")

    def has(self, batch: str) -> bool:
        return not self._log().where(F.col("batch") == batch).isEmpty()

    def batches(self) -> list[str]:
        """Committed batches in the order of their commits."""
        return [r["batch"] for r in self._log().groupBy("batch").agg(F.min("seq").alias("seq")).orderBy("seq").collect()]

    def parts(self, table: str) -> list[Part]:
        """Committed parts, oldest first, less those that a later commit replaced."""
        rows = self._log().where(F.col("table") == table).orderBy("seq", F.col("live").desc()).collect()
        gone = {r["part"] for r in rows if not r["live"]}
        return [Part(r["part"], r["level"], r["buckets"], StructType.fromDDL(r["columns"])) for r in rows if r["live"] and r["part"] not in gone]

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """All committed rows. ``schema`` is needed only where nothing may be committed yet."""
        parts = self.parts(table)
        if not parts:
            if schema is None:
                raise ValueError(f"nothing is committed to {table}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(parts[-1].schema).parquet(*[p.path for p in parts])

    def write_part(self, table: str, rows: DataFrame) -> Part:
        """Write rows that do not count before a commit names them."""
        path = f"{self.root}/parts/{table}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return Part(path, 0, 0, rows.schema)

    def write_run(self, table: str, rows: DataFrame, buckets: int, level: int = 0) -> Part:
        """Write rows in hash buckets of their column ``_key``, sorted by it."""
        path = f"{self.root}/parts/{table}/{uuid.uuid4().hex}"
        dealt = rows.repartition(buckets, "_key").write.format("parquet").bucketBy(buckets, "_key").sortBy("_key")
        dealt.option("path", path).saveAsTable(_table_name(path))
        return Part(path, level, buckets, rows.schema)

    def open_part(self, part: Part) -> DataFrame:
        """A part's rows; Spark knows the buckets of a run, whichever session wrote it."""
        if not part.buckets:
            return self.spark.read.schema(part.schema).parquet(part.path)
        name = _table_name(part.path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (_key) SORTED BY (_key) INTO {part.buckets} BUCKETS LOCATION '{part.path}'")
        return self.spark.table(name)

    def commit(self, batch: str, added: dict[str, Part], replaced: dict[str, list[Part]] | None = None) -> bool:
        """Make parts count, all at once, in place of ``replaced`` ones. False if the batch has been committed before."""
        log = self._log().agg(F.max("seq").alias("seq"), F.max(F.col("batch") == batch).alias("known")).first()
        if log["known"]:
            return False
        seq = (log["seq"] or 0) + 1
        rows = [(seq, batch, t, p.path, p.level, True, p.buckets, _ddl(p.schema)) for t, p in added.items()]
        rows += [(seq, batch, t, p.path, p.level, False, p.buckets, _ddl(p.schema)) for t, old in (replaced or {}).items() for p in old]
        rows = rows or [(seq, batch, None, None, 0, False, 0, None)]
        # One file, which appears when it is complete.
        self.spark.createDataFrame(rows, _RECORD).coalesce(1).write.parquet(f"{self.root}/log/{seq:012d}-{uuid.uuid4().hex}")
        return True

    def add(self, batch: str, tables: dict[str, DataFrame]) -> bool:
        """Write and commit one batch of rows of several tables; nothing happens if it was committed before."""
        if self.has(batch):
            return False
        return self.commit(batch, {t: self.write_part(t, rows) for t, rows in tables.items()})


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _table_name(path: str) -> str:
    return f"pagemill_run_{hashlib.md5(path.encode()).hexdigest()}"


class KeyIndex:
    """Rows of ``table`` in a store, one per key over all batches; keys (and ``values``) lie in bucketed runs as well."""

    def __init__(self, store: Store, table: str, keys: list[str], values: list[str] | None = None, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.store, self.table, self.keys, self.values, self.fanout = store, table, keys, values or [], fanout
        runs = store.parts(self._runs)
        self.buckets = runs[0].buckets if runs else buckets  # runs keep the number they began with

    @property
    def _runs(self) -> str:
        return f"{self.table}.keys"

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """The rows with all their key columns as one text, which knows NULL."""
        return rows.withColumn("_key", F.to_json(F.struct(*[F.col(f"`{k}`") for k in self.keys]), {"ignoreNullFields": "false"}))

    def _opened(self, keyed: DataFrame) -> list[DataFrame]:
        """The runs; for a batch of few rows only the buckets and pages of files that can hold them. The batch is looked at before it is dealt."""
        parts = self.store.parts(self._runs)
        some = [r["_key"] for r in keyed.select("_key").limit(NAMED + 1).collect()] if parts else []
        runs = [self.store.open_part(p) for p in parts]
        return [r.where(F.col("_key").isin(some)) for r in runs] if len(some) <= NAMED else runs

    def _less_known(self, dealt: DataFrame, runs: list[DataFrame]) -> DataFrame:
        for run in runs:
            # An anti-join would be moved before the dealing. A key is in one run only, so no row is doubled.
            dealt = dealt.alias("n").join(run.select("_key").alias("r"), F.col("n._key") == F.col("r._key"), "left").where("r._key IS NULL").select("n.*")
        return dealt.drop("_key")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys no committed batch has."""
        keyed = self._keyed(rows)
        return self._less_known(keyed.repartition(self.buckets, "_key"), self._opened(keyed))

    def first_unseen(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """Of each key that no committed batch has the first row by ``order``. Rows of a key are told apart before they are dealt, and once."""
        keyed = self._keyed(rows)
        return self._less_known(first_per_key(keyed, ["_key"], order), self._opened(keyed))

    def looked_up(self, rows: DataFrame) -> DataFrame:
        """The rows with ``values`` of their keys, NULL where no committed batch has the key."""
        keyed = self._keyed(rows)
        dealt = keyed.repartition(self.buckets, "_key").select("*", *[F.lit(None).alias(v) for v in self.values])
        for run in self._opened(keyed):
            both = [F.coalesce(F.col(f"n.`{v}`"), F.col(f"r.`{v}`")).alias(v) for v in self.values]
            met = dealt.alias("n").join(run.alias("r"), F.col("n._key") == F.col("r._key"), "left")
            dealt = met.select(*[F.col(f"n.`{c}`") for c in [*rows.columns, "_key"]], *both)
        return dealt.drop("_key")

    def add(self, batch: str, new: DataFrame, more: dict[str, Part] | None = None, asked: Column | None = None) -> bool:
        """Commit rows whose keys are new and distinct, together with parts of other tables. With ``asked`` only the keys of rows that meet it are kept in runs."""
        part = self.store.write_part(self.table, new)
        rows = self.store.open_part(part)
        keyed = self._keyed(rows if asked is None else rows.where(asked)).select("_key", *self.values)
        done = self.store.commit(batch, {self.table: part, self._runs: self.store.write_run(self._runs, keyed, self.buckets)} | (more or {}))
        self._merge()
        return done

    def append(self, batch: str, rows: DataFrame, order: list[str] | None = None) -> bool:
        """Add the first row (by ``order``) of each key that is new. A batch that was committed before adds nothing."""
        if self.store.has(batch):
            return False
        by = [F.col(c) for c in (order or [c for c in rows.columns if c not in self.keys] or self.keys)]
        return self.add(batch, self.unseen(first_per_key(rows, self.keys, by)))

    def _merge(self) -> None:
        """Merge the runs of a level once there are ``fanout`` of them."""
        level = 0
        while len(runs := [p for p in self.store.parts(self._runs) if p.level == level]) >= self.fanout:
            rows = self.store.spark.read.schema(runs[0].schema).parquet(*[p.path for p in runs])
            merged = self.store.write_run(self._runs, rows, self.buckets, level + 1)
            self.store.commit(f"merge-{uuid.uuid4().hex}", {self._runs: merged}, {self._runs: runs})
            level += 1

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        return self.store.read(self.table, schema)
