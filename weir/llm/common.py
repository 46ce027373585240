"""Helpers shared by the corpus operators: shared-folder tables and Arrow access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import Files

#: What splits words everywhere in this subpackage: the space and 0x09 to 0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Spark's setting that deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of an Arrow batch between Spark and Python; the session's own setting is kept where it is lower.
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, where no machine is another, one is made and set if there is none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weir-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths given out by this process, for ``scratch_since``.
_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/weir/{uuid.uuid4().hex}/{name}"
    _given.append(path)
    return path


def scratch_mark() -> int:
    """A point in the order of the paths given out."""
    return len(_given)


def drop_scratch(spark: SparkSession, mark: int, *keep: str) -> None:
    """Delete the tables written since ``mark`` but ``keep``; results that read them must be written themselves."""
    files = Files(spark)
    for path in _given[mark:]:
        if path not in keep:
            files.delete(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks it was running,
    since the written files are on storage that every machine reads. The shuffle
    files of the plan are deleted once it is written, as nothing asks for them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def heavy(counts: DataFrame, key: list[str], n: str, least: int, most: int) -> DataFrame:
    """``key, parts`` of the keys to be dealt into several parts: those with over ``least`` rows and over 1 / ``most`` of all.

    ``counts`` has a row a key with its number of rows. No more than ``most`` keys
    can have so many, whatever the table, so the result may be broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    bound = max(least, total // most)
    hot = counts.where(F.col(n) > bound).select(*key, F.ceil(F.col(n) / bound).cast("long").alias("parts"))
    return materialize(hot, "heavy_keys")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, count: str, out: str, chunk: int = 100_000) -> DataFrame:
    """Each row as often as its (long) ``count`` says, numbered from 0 in ``out``.

    Rows of more than ``chunk`` are dealt to tasks in ranges of as many, so one row
    that stands for a third of a table is no single task's work.
    """
    (lo,) = unused([*df.columns, out], "lo")
    n, zero = F.col(count), F.lit(0).cast("long")
    small = df.where((n > 0) & (n <= chunk)).withColumn(out, F.explode(F.sequence(zero, n - 1)))
    ranges = df.where(n > chunk).withColumn(lo, F.explode(F.sequence(zero, n - 1, F.lit(chunk).cast("long")))).repartition(F.col(lo))
    large = ranges.withColumn(out, F.explode(F.sequence(F.col(lo), F.least(F.col(lo) + chunk, n) - 1))).drop(lo)
    return small.unionByName(large)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Splits nothing into an array of words twice."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc32_of_id(column: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, offsets) of a text column, without a copy; null texts are empty."""
    if pa.types.is_large_string(array.type):
        kind, width = pa.large_string(), np.int64
    else:
        kind, width = pa.string(), np.int32
    array = array.cast(kind)
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    return raw[off[0] : off[-1]], off - off[0]


Batches = Iterator[pa.RecordBatch]


def small_slices(batches: Batches, column: str, limit: int = 4_000_000) -> Batches:
    """Cut record batches so that a slice's texts hold about ``limit`` bytes at most.

    A slice has one row at least, so one very long text makes a larger slice.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(off, off[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def arrow_map(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows, since the rows hold texts."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
