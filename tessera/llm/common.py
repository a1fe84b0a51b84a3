"""What the operators of this subpackage share: scratch tables, bounded batches, small expressions."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one Python step holds at a time, unless a single text is longer.
SLICE_BYTES = 4 << 20

#: Scratch paths that the innermost open passing() of this thread has made, and the path of each staged table.
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (local tests) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    if (made := _OPEN.get()) is not None:
        made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a session that has ended already leaves it to the folder's owner."""
    if spark.sparkContext._jsc is not None and spark.sparkContext._jvm is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        try:
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch table and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the scratch table of a frame that stage() returned, once all that reads it has been written."""
    if path := _PATHS.pop(df, None):
        drop_path(df.sparkSession, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the scratch tables made inside at the end, save those staged frames that the yielded function was given."""
    made: list[str] = []
    kept: list[str] = []
    token = _OPEN.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_PATHS[df])
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in made:
            if path not in kept:
                drop_path(spark, path)
        if (outer := _OPEN.get()) is not None:
            outer += kept


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't gather in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice holds over limit bytes of text, save a single longer one."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
