"""Staging, housekeeping and small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python worker holds at once; Arrow batches are cut to this.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches to BATCH_BYTES, so that workers hold little however long the texts; a lower setting stays."""
    if not str(spark.conf.get(_BATCH_CONF, "64m")).rstrip("b").isdigit() or int(spark.conf.get(_BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def tidy(run):
    """A mapper over batches that gives its worker's free memory back when its task ends: workers live on and do other work."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; where that is unset a local one, which a cluster doesn't have."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no later result reads, then let Spark drop the shuffle files of finished steps."""
    for df in staged:
        spark, path = df.sparkSession, df._foliant_path
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    settle()


def settle() -> None:
    """Collect driver garbage, which is what lets Spark's cleaner remove shuffle files of finished steps from the executors' disks."""
    spark = SparkSession.getActiveSession()
    gc.collect()
    if spark is not None:
        spark._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drawn(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The `most` rows of least `order`, a hash of 64 bits. Rows that can hardly be among them stay in their tasks: what leaves these is little more than `most` rows however many tasks there are."""
    n = rows.count()
    if n > most:
        share = min(1.0, (most + 8 * most**0.5 + 64) / n)
        rows = rows.where(order <= int(share * (1 << 64)) - (1 << 63) - 1)
    return rows.orderBy(order).limit(most)


def slices(texts, limit: int = BATCH_BYTES):
    """Ranges [a, b) of a list of texts that hold at most `limit` characters each, or one longer text."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t)
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column's name begins with, in any case."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return mark
