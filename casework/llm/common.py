"""Shared helpers of the training-data operators: scratch tables and hashing.

Intermediate results are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver can read them, so a lost executor
costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path. Only where the session names none (tests, a laptop) is a local one used."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="casework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Shuffle files go when the query that made them ends; its result is a table by then. Batches to Python are small, as rows can be long.
CLEAN_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


class Scratch:
    """A folder of intermediate tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.bucketed_tables: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` as a table and return a DataFrame that reads it."""
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        with session_conf(self.spark, **CLEAN_CONF):
            writer.parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, *names: str) -> DataFrame:
        """The rows of all these tables, with the columns of ``like``, in one scan: unlike a union, its plan doesn't grow with their number."""
        return self.spark.read.schema(like.schema).parquet(*map(self.path, names))

    def bucketed(self, df: DataFrame, name: str, buckets: int, by: list[str]) -> DataFrame:
        """Write ``df`` dealt by the columns ``by`` into so many buckets, a file each; what groups or joins by them later moves no row of it. :meth:`unbucket` ends its use."""
        table = self.bucketed_tables[name] = f"bucketed_{uuid.uuid4().hex}"
        with session_conf(self.spark, **CLEAN_CONF):
            df.repartition(buckets, *by).write.bucketBy(buckets, *by).option("path", self.path(name)).saveAsTable(table)
        return self.spark.table(table)

    def unbucket(self) -> None:
        """Take the bucketed tables out of the catalogue and delete their files."""
        for name, table in self.bucketed_tables.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.drop(name)
        self.bucketed_tables.clear()

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 1 << 20


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Arrow batches cut, without a copy, so that ``column`` has about ``most`` bytes in each; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(sizes, dtype=np.int64) // most
        starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def of_worker() -> dict:
    """What this Python worker keeps from one task to the next; functions that travel by value have no module of their own to keep it in."""
    return sys.modules.setdefault("casework_of_worker", types.ModuleType("casework_of_worker")).__dict__.setdefault("kept", {})


def forget() -> None:
    """Drop what tasks of another stage have kept in this worker: it lives on after them, and its memory counts against this stage."""
    if of_worker():
        of_worker().clear()
        release()


#: Lets Catalyst put a Bloom filter of the smaller side before the shuffle of a join's larger side, at any size. Its bits are bounded (1 MB by
#: default). Broadcasts are off so that small and large inputs get one plan.
BLOOM_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(1 << 40),
}


@contextmanager
def session_conf(spark: SparkSession, **values: str):
    """Run a block, with the actions in it, under other session settings."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bloom_join(scratch: Scratch, name: str, large: DataFrame, small: DataFrame, key: str, then) -> DataFrame:
    """Write ``then(large JOIN small)`` as a table; rows of ``large`` whose key a bounded Bloom filter of ``small`` rules out are dropped before the shuffle.

    ``small`` should end in a comparison over a scan, which is what makes Catalyst add the filter. The result does not depend on the filter.
    """
    with session_conf(scratch.spark, **BLOOM_CONF):
        return scratch.table(then(large.join(small, key)), name)


#: Words of the bitmap in :func:`may_contain`: a table of at most so many rows, 8 MB, is broadcast, whatever the number of keys.
BITMAP_WORDS = 1 << 19


def may_contain(rows: DataFrame, keys: DataFrame, key: str, words: int = BITMAP_WORDS) -> DataFrame:
    """``rows`` less those whose ``key`` a bitmap of the hashed keys of ``keys`` rules out; others may pass, and the more do the more keys there are.

    For keys that come out of an explode, where Catalyst puts no Bloom filter of its own.
    """
    h = F.xxhash64(key)
    slot, bit = F.pmod(h, F.lit(words)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int"))
    bitmap = keys.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumn("__slot", slot).join(F.broadcast(bitmap), "__slot")
    return marked.filter(F.col("__bits").bitwiseAND(bit) != 0).select(*rows.columns)
