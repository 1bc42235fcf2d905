"""Helpers shared by the corpus operators: word pattern, scratch tables, two-level prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local master (tests, one machine), where it is
    unset, gets a temporary folder in its place."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="survista-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of a batch that goes to a Python worker while a scratch table is made.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as a table in the shared scratch folder and read it back: lineage ends there,
    and a lost executor costs a re-read rather than a recomputation. Python workers get small batches."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/survista/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    _scratch.append((spark, path))
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables, as materialize() gave them, that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        found = [x for x in _scratch if x[1] == df.scratch_path]
        for spark, path in found:
            _delete(spark, path)
            _scratch.remove((spark, path))


def release(spark: SparkSession) -> None:
    """Let the cleaner drop shuffle files that nothing refers to any more: a long query keeps no more on
    disk than the step it is in needs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch, of `most` bytes together by `sizes`; a larger row alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def bytes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each string or binary of a column, null as none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def trimmed(run: Callable) -> Callable:
    """A function of batches for mapInArrow that gives the memory it freed back to the system in its end: workers live on,
    and what one task needed is not kept from what runs next to it."""

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # no such call but in glibc
                ctypes.CDLL(None).malloc_trim(0)

    return trimming


class Places:
    """A set of numbers below 2 ** bits as a table of bits, of one size whatever it holds."""

    def __init__(self, numbers: np.ndarray, bits: int = 24):
        table = np.zeros(1 << bits, bool)
        table[numbers] = True
        self.table = np.packbits(table, bitorder="little")

    def has(self, numbers: np.ndarray) -> np.ndarray:
        return (self.table[numbers >> 3] >> (numbers & 7).astype(np.uint8)) & 1 == 1


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_scratch() -> None:
    """Delete the scratch tables of this process; results not yet consumed become unreadable."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have gone first
            return


def n_words(text: Column) -> Column:
    """Words of a whole text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `groups`, in the order (bucket, *order).

    Two levels, so that no group is ordered by a single task: sums run inside a bucket, and bucket
    totals (one row each) give the offsets. Nulls in `groups` form a group of their own.
    """
    within = Window.partitionBy(*groups, bucket).orderBy(*order)
    total = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        F.col(bucket).alias("_o_bucket"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    run = df.withColumn("_run", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = F.col(bucket) == F.col("_o_bucket")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return run.join(offset, on).withColumn(out, F.col("_run") + F.col("_offset")).drop("_run", "_offset", "_o_bucket", *[f"_o_{g}" for g in groups])
