"""Keyed tables: Parquet files under numbered snapshots, the newest sequence of a key wins.

Layout: ``data/commit=<id>/bucket=<n>/*.parquet`` and ``snapshots/<id>.json``. A
snapshot's file is written whole and renamed to a name that must be free, so it is
the commit: files that no snapshot names don't exist. An APPEND adds a commit
folder and rewrites nothing. Reading merges the folders that the snapshot names:
of each key the row of the greatest (sequence, commit) stays, an aggregation with
partial results whose keys are already in buckets. COMPACT writes the merged rows
as one folder and names it alone. A snapshot also says, for every writer, the
last identifier it committed, so a batch that is run again is known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, DataError, TableError
from .files import Files

ROWKIND = "rowkind"
KINDS = ("+I", "-U", "+U", "-D")


@dataclass(frozen=True)
class Snapshot:
    id: int
    kind: str  # APPEND, COMPACT, OVERWRITE, ANALYZE
    live: tuple[str, ...]  # commit folders whose rows make the table
    delta: tuple[str, ...]  # what this commit added
    writers: dict[str, int] = field(default_factory=dict)
    progress: dict[str, object] = field(default_factory=dict)  # what a writer saved with it, by writer
    merged: str | None = None  # the live folder that a compaction wrote

    @classmethod
    def of(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        return cls(**raw | {"live": tuple(raw["live"]), "delta": tuple(raw["delta"])})


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    primary_key: tuple[str, ...]
    buckets: int = 1
    bucket_key: tuple[str, ...] = ()
    sequence_field: str | None = None
    rowkind_field: str | None = None
    changelog: str = "none"  # none, input

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"schema": json.loads(self.schema.json())})

    @classmethod
    def of(cls, text: str) -> TableSpec:
        raw = json.loads(text)
        return cls(**raw | {"schema": T.StructType.fromJson(raw["schema"]), "primary_key": tuple(raw["primary_key"]), "bucket_key": tuple(raw["bucket_key"])})


#: For one write: adaptive execution, which streams turn off, as it alone knows how large a shuffle's parts are; and
#: files of so many buckets open in a task (beyond that Spark sorts), so that rows are not sorted by their bucket.
WRITE = {"spark.sql.adaptive.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "8"}

#: A byte of a table's files is up to so many when it is shuffled (2.8 for `lineitem` by order).
SHUFFLED = 4


def unsorted_parts(spark: SparkSession) -> int:
    """Of how many parts an exchange's map task writes its rows as they come; for more it holds all of them, to sort."""
    return max(1, int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200")))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class KeyedTable:
    """One table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        if not self.files.exists(f"{self.path}/table.json"):
            raise TableError(f"there is no table at {path}")
        self.spec = TableSpec.of(self.files.read(f"{self.path}/table.json"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec, *, exists_ok: bool = False) -> KeyedTable:
        names = spec.schema.fieldNames()
        for c in (*spec.primary_key, *spec.bucket_key, *filter(None, (spec.sequence_field, spec.rowkind_field))):
            if c not in names:
                raise TableError(f"the table has no column '{c}'")
        if not spec.primary_key:
            raise TableError("the table has no primary key")
        if spec.rowkind_field in spec.primary_key:
            raise TableError("the row kind is no part of the primary key")
        if spec.buckets < 1:
            raise TableError("the table has one bucket at least")
        if not Files(spark).publish(f"{path.rstrip('/')}/table.json", spec.to_json()) and not exists_ok:
            raise TableError(f"there is a table at {path}")
        return cls(spark, path)

    # --- snapshots -----------------------------------------------------------

    def latest_id(self) -> int:
        """0 before the first commit."""
        ids = [int(n[:-5]) for n in self.files.names(f"{self.path}/snapshots") if n.endswith(".json") and n[0] != "_"]
        return max(ids, default=0)

    def snapshot(self, number: int | None = None) -> Snapshot:
        number = self.latest_id() if number is None else number
        if number == 0:
            return Snapshot(0, "APPEND", (), ())
        return Snapshot.of(self.files.read(f"{self.path}/snapshots/{number}.json"))

    def last_identifier(self, writer: str) -> int | None:
        """The last identifier that ``writer`` committed."""
        return self.snapshot().writers.get(writer)

    def _publish(self, base: Snapshot, kind: str, live: tuple[str, ...], delta: tuple[str, ...], writer: str | None, identifier: int | None, progress: object) -> Snapshot:
        writers, saved = dict(base.writers), dict(base.progress)
        if writer is not None:
            writers[writer] = identifier
            if progress is not None:
                saved[writer] = progress
        merged = live[0] if kind == "COMPACT" else base.merged if base.merged in live else None
        new = Snapshot(base.id + 1, kind, live, delta, writers, saved, merged)
        if not self.files.publish(f"{self.path}/snapshots/{new.id}.json", json.dumps(asdict(new))):
            raise ConflictError(f"snapshot {new.id} was published by another writer")
        return new

    # --- writing -------------------------------------------------------------

    def _checked(self, rows: DataFrame) -> DataFrame:
        spec = self.spec
        kind = spec.rowkind_field or (ROWKIND if ROWKIND in rows.columns and ROWKIND not in spec.schema.fieldNames() else None)
        names = spec.schema.fieldNames() + ([kind] if kind and kind not in spec.schema.fieldNames() else [])
        if rows.columns != names:
            raise DataError(f"the rows have the columns {rows.columns}, the table has {names}")
        for f in spec.schema:
            if rows.schema[f.name].dataType != f.dataType:
                raise DataError(f"'{f.name}' is {rows.schema[f.name].dataType.simpleString()}, the table has {f.dataType.simpleString()}")
        if kind and spec.changelog != "input" and not spec.rowkind_field:
            raise DataError("row kinds need a table with the changelog 'input' or a row kind field")
        fail = lambda text: F.raise_error(F.lit(text)).cast("string")
        own = []
        for f in spec.schema:
            c = F.col(f"`{f.name}`")
            if f.name in spec.primary_key or not f.nullable:
                c = F.when(c.isNull(), F.raise_error(F.lit(f"'{f.name}' is null")).cast(f.dataType)).otherwise(c)
            own.append(c.alias(f.name))
        if kind:
            k = F.upper(F.col(kind))
            k = F.when(k.isNull(), fail("a row kind is null")).when(k.isin(*KINDS), k).otherwise(fail("a row kind is none of +I, -U, +U, -D"))
            own = [c for c, f in zip(own, spec.schema, strict=True) if f.name != kind] + [k.alias("__kind")]
        else:
            own.append(F.lit("+I").alias("__kind"))
        return rows.select(*own)

    def _bucket(self) -> Column:
        key = self.spec.bucket_key or self.spec.primary_key
        return F.pmod(F.xxhash64(*key), F.lit(self.spec.buckets)).cast("int")

    def _write(self, rows: DataFrame, parts: int = 0) -> str:
        """A commit folder of the rows; its name. Exchanges in the rows' own plan have ``parts`` parts, if the session sets fewer."""
        name, own = uuid.uuid4().hex, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # large buckets are split among tasks by the size that was shuffled, but never within a map output
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", min(own, unsorted_parts(rows.sparkSession)), "bucket")
        with settings(rows.sparkSession, WRITE | {"spark.sql.shuffle.partitions": str(max(own, parts))}):
            dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/commit={name}")
        return name

    def commit(self, rows: DataFrame, *, writer: str = "", identifier: int | None = None, progress: object = None, tries: int = 3, kind: str = "APPEND") -> Snapshot | None:
        """Add rows as one snapshot; None if there are none or the identifier was committed before.

        With an identifier a commit is idempotent: of one writer only identifiers
        above its last one are taken. Another writer's snapshot in between is no
        obstacle: the files are published on top of it.
        """
        last = self.last_identifier(writer) if identifier is not None else None
        if last is not None and last >= identifier:
            return None
        checked = self._checked(rows)
        name = self._write(checked)
        if not self.files.names(f"{self.path}/data/commit={name}") or not [n for n in self.files.names(f"{self.path}/data/commit={name}") if n.startswith("bucket=")]:
            self.files.delete(f"{self.path}/data/commit={name}")
            return None
        for left in reversed(range(tries)):
            base = self.snapshot()
            if identifier is not None and base.writers.get(writer, -1) >= identifier:
                self.files.delete(f"{self.path}/data/commit={name}")
                return None
            live = (name,) if kind == "OVERWRITE" else (*base.live, name)
            try:
                return self._publish(base, kind, live, (name,), writer if identifier is not None else None, identifier, progress)
            except ConflictError:
                if not left:
                    raise
        raise AssertionError

    def compact(self, min_files: int = 8, tries: int = 3) -> Snapshot | None:
        """Merge the live folders into one, if a bucket has ``min_files`` files or more.

        A large bucket's merged rows are several files; they count as one, as
        merging them again would change nothing.
        """
        if min_files < 2:
            raise TableError("compaction takes two files or more")
        for left in reversed(range(tries)):
            base = self.snapshot()
            counts: dict[str, int] = {}
            for folder in base.live:
                for bucket in self.files.names(f"{self.path}/data/commit={folder}"):
                    n = sum(f.endswith(".parquet") for f in self.files.names(f"{self.path}/data/commit={folder}/{bucket}"))
                    counts[bucket] = counts.get(bucket, 0) + (min(n, 1) if folder == base.merged else n)
            if max(counts.values(), default=0) < min_files:
                return None
            name = self._write(self._merged(base, keep_order=True), self._passes(base)[0])
            try:
                return self._publish(base, "COMPACT", (name,), (), None, None, None)
            except ConflictError:
                self.files.delete(f"{self.path}/data/commit={name}")
                if not left:
                    raise
        raise AssertionError

    # --- reading -------------------------------------------------------------

    def _physical(self) -> T.StructType:
        names = [f for f in self.spec.schema if f.name != self.spec.rowkind_field]
        extra = [T.StructField("__kind", T.StringType()), T.StructField("bucket", T.IntegerType())]
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in names] + extra)

    def _folders(self, names: tuple[str, ...]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self._physical()).withColumn("__commit", F.lit(0).cast("long"))
        paths = [f"{self.path}/data/commit={n}" for n in names]
        rows = self.spark.read.schema(self._physical()).option("basePath", f"{self.path}/data").parquet(*paths)
        order = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]), F.regexp_extract("_metadata.file_path", r"/commit=([0-9a-f]+)/", 1))
        return rows.withColumn("__commit", order.cast("long"))

    def _shares(self, snapshot: Snapshot) -> int:
        """Into how many shares of bounded size a merge of the snapshot deals its rows."""
        number = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        # parts under the second size are put together again
        share = max(number(self.spark.conf.get(f"spark.sql.adaptive.{k}")) for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"))
        return -(-SHUFFLED * sum(self.files.size(f"{self.path}/data/commit={n}") for n in snapshot.live) // share)

    def _passes(self, snapshot: Snapshot) -> tuple[int, int]:
        """Into how many shares a merge deals its rows each time, and in how many times it goes over the buckets: more than one only if the key says the bucket."""
        spec, shares = self.spec, self._shares(snapshot)
        parts = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), unsorted_parts(self.spark))
        times = max(1, min(spec.buckets, -(-shares // parts))) if set(spec.bucket_key) <= set(spec.primary_key) else 1
        return -(-shares // times), times

    def _merged(self, snapshot: Snapshot, keep_order: bool = False) -> DataFrame:
        """Of each key its row.

        The exchange by key that ends an aggregation has as many parts as the session
        sets, however many rows there are. A table that is too large for them is merged
        a few buckets at a time, each time with all parts; a bucket holds its keys whole
        if the key says the bucket. A compaction also sets more parts for its write.
        """
        spec = self.spec
        rows, parts = self._folders(snapshot.live), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shares, times = self._passes(snapshot)
        dealt = max(shares, parts)
        if self.spark.conf.get("spark.sql.adaptive.enabled") == "true":
            # parts that are too large are split
            dealt = min(dealt, unsorted_parts(self.spark))
        if times == 1:
            return self._best(rows, spec.primary_key, dealt, keep_order)
        # by the bucket too, as Spark puts the parts of equally partitioned frames together again in a union
        each = [self._best(rows.where(F.col("bucket") % times == i), ("bucket", *spec.primary_key), dealt, keep_order) for i in range(times)]
        return reduce(DataFrame.unionAll, each)

    def _best(self, rows: DataFrame, by: tuple[str, ...], shares: int, keep_order: bool) -> DataFrame:
        spec = self.spec
        values = [f.name for f in spec.schema if f.name not in spec.primary_key and f.name != spec.rowkind_field]
        rank = F.struct(*([F.col(spec.sequence_field)] if spec.sequence_field else []), F.col("__commit"), F.col("__kind").isin("+I", "+U").alias("whole"), *[F.col(v) for v in values if not isinstance(spec.schema[v].dataType, T.MapType)])
        best = F.max_by(F.struct("__kind", *values), rank).alias("__row")
        # before-images say nothing about what a key is now
        rows = rows.where("__kind <> '-U'")
        # aggregating structs sorts a task's rows, and a scan's task has any number of them: shares of bounded
        # size first. By a column of their own, so that a key too large for one share may lie in several.
        dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*spec.primary_key), F.lit(4096)).cast("int")).hint("rebalance", shares, "__share")
        one = dealt.groupBy(*by).agg(best)
        kept = one if keep_order else one.where("__row.__kind <> '-D'")
        if spec.rowkind_field is None or keep_order:
            names = [f.name for f in spec.schema if f.name != spec.rowkind_field]
            columns = [F.col(n) if n in spec.primary_key else F.col(f"__row.`{n}`").alias(n) for n in names]
            return kept.select(*columns, *([F.col("__row.__kind").alias("__kind")] if keep_order else []))
        return kept.select(*[F.col(f.name) if f.name in spec.primary_key else F.col("__row.__kind").alias(f.name) if f.name == spec.rowkind_field else F.col(f"__row.`{f.name}`").alias(f.name) for f in spec.schema])

    def read(self, snapshot_id: int | None = None) -> DataFrame:
        """The table's rows now, or at a snapshot."""
        return self._merged(self.snapshot(snapshot_id))

    def _delta(self, snapshot: Snapshot, changelog: bool) -> DataFrame:
        names = [f.name for f in self.spec.schema if f.name != self.spec.rowkind_field]
        rows = self._folders(snapshot.delta)
        if changelog:
            return rows.select(F.col("__kind").alias(ROWKIND), *names)
        return rows.where("__kind in ('+I', '+U')").select(*names)

    def next_append(self, after: int, *, changelog: bool = False) -> tuple[int, DataFrame] | None:
        """(id, rows) of the first APPEND snapshot behind ``after``; None if there is none.

        COMPACT and ANALYZE add no rows. OVERWRITE replaced rows that were handed
        out before: an error, or, for a changelog, passed over.
        """
        latest = self.latest_id()
        while after < latest:
            after += 1
            s = self.snapshot(after)
            if s.kind == "OVERWRITE" and not changelog:
                raise TableError(f"snapshot {after} overwrites the table; a tail can't follow it")
            if s.kind == "APPEND":
                return after, self._delta(s, changelog)
        return None

    def rows_of(self, snapshot: Snapshot) -> int:
        """How many rows a commit added, from the files' footers."""
        return self._folders(snapshot.delta).select("bucket").count() if snapshot.delta else 0

    def tail(self, after: int, *, changelog: bool = False) -> tuple[int, DataFrame | None]:
        """(latest id, rows of all APPEND snapshots behind ``after``)."""
        rows, at = None, after
        while (found := self.next_append(at, changelog=changelog)) is not None:
            at = found[0]
            rows = found[1] if rows is None else rows.unionByName(found[1])
        return max(self.latest_id(), after), rows
