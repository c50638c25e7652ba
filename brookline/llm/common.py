"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import shipping

__all__ = ["BROADCAST_ROWS", "bitmap_bits", "bitmap_filter", "bounded_sample", "clean", "cut", "in_bitmap", "own_dir", "release", "running_sum", "shared_dir", "ship", "small_side", "table", "tidy", "without", "written"]

#: Rows that a broadcast side may have: narrow rows of some tens of bytes, so
#: tens of MB at most.  Beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 200_000


#: Rows of an Arrow batch; Spark's default of 10,000 is meant for narrower rows than texts.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Prepares the session for Python passes over texts.

    Workers get the package's modules.  Unless the session sets it, Arrow batches
    are limited to `ARROW_ROWS` rows, as both sides hold whole batches in memory.
    """
    shipping.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def release() -> None:
    """Gives the free memory of this process back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function):
    """``function`` of a task's batches, after which the Python worker gives free memory back.

    Workers live on for later tasks, and would keep what their largest batch took.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` below ``sf_dir``; any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset in a
    local session is a temporary folder made, and set for the session; on a
    cluster executors would not see it, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brookline-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; intermediate tables stay there until `clean`."""
    return f"{shared_dir(spark)}/brookline/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Deletes this application's intermediate tables; results that aren't run yet are lost with them.

    Tables that ``but`` reads stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if but is None:
        system.delete(path, True)
        return
    read = but.inputFiles()
    for found in system.listStatus(path) if system.exists(path) else ():
        if not any(f"/{found.getPath().getName()}/" in f for f in read):
            system.delete(found.getPath(), True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, without its lineage.

    Meant for narrow rows: these are kept as they are, uncompressed.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    For wide rows: columns are compressed, and later reads can prune them.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it, else as it is.

    ``df`` must be cheap to read twice, so it is written out by the caller.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``rows`` rows of ``df`` at most: those with the smallest hashes of ``key``.

    A counted share of the hash range is cut off first, so that what tasks hand
    over for the final choice is some ``rows`` in all, not for each task.
    """
    order = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40))
    count = max(1, df.count())
    share = min(1.0, (rows + 5 * rows**0.5 + 50) / count)
    few = df.filter(order <= F.lit(int(share * (1 << 40))))
    return few.orderBy(order, *(F.col(c) for c in df.columns)).limit(rows)


def bitmap_bits(count: int) -> int:
    """The bits of a bitmap for ``count`` keys: 16 slots for each, 8 MB at most."""
    return min(26, max(16, (16 * count).bit_length()))


def bitmap_filter(keys: DataFrame, key: Column, bits: int = 22) -> DataFrame:
    """Which of ``2**bits`` slots the hashed ``key`` values of ``keys`` occupy.

    Rows ``(_bl_slot, _bl_map)`` of 4 KB each, ``2**(bits - 15)`` at most: 0.5 MB
    for 22 bits, 8 MB for the most that `bitmap_bits` gives, whatever the input, and
    therefore safe to broadcast.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (
        keys.select((slot + 1).alias("_bl_s"))
        .groupBy(F.bitmap_bucket_number("_bl_s").alias("_bl_slot"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bl_s")).alias("_bl_map"))
    )


def in_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, name: str, bits: int = 22) -> DataFrame:
    """``df`` with a boolean ``name``: false only if ``key`` is surely not in it."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    df = df.withColumn("_bl_s", slot).withColumn("_bl_slot", F.bitmap_bucket_number("_bl_s"))
    df = df.join(F.broadcast(bitmap), "_bl_slot", "left")
    pos = F.bitmap_bit_position("_bl_s")
    byte = F.conv(F.hex(F.substring("_bl_map", (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, int(bitmap_bit_position(_bl_s) % 8))")) != 0
    return df.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bl_s", "_bl_slot", "_bl_map")


def without(docs: DataFrame, gone: DataFrame, id_col: str, tie: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``tie`` (a hash of the text) aren't in ``gone``.

    ``gone`` has distinct ``(_bl_gid, _bl_gtie)`` rows and is cheap to read again.  Up to
    `BROADCAST_ROWS` it is broadcast; beyond, a bitmap lets through what is surely not in
    it, so that only the texts of rows that are to go, and few others, are shuffled.
    """
    count = gone.count()
    same = F.col("_bl_did").eqNullSafe(F.col("_bl_gid")) & (F.col("_bl_tie") == F.col("_bl_gtie"))
    rows = docs.select("*", F.col(id_col).alias("_bl_did"), tie.alias("_bl_tie"))
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), same, "left_anti").select(*docs.columns)
    bits = bitmap_bits(count)
    rows = in_bitmap(rows, F.col("_bl_tie"), cut(bitmap_filter(gone, F.col("_bl_gtie"), bits)), "_bl_maybe", bits)
    stay = rows.filter("not _bl_maybe").select(*docs.columns)
    return stay.unionByName(rows.filter("_bl_maybe").join(gone, same, "left_anti").select(*docs.columns))


def running_sum(df: DataFrame, group: list[str], coarse: str, fine: str, order: list, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the inclusive running sum of ``value`` per ``group``.

    The order is by ``coarse``, ``fine`` and ``order``, where ``coarse`` and
    ``fine`` are bucket numbers that follow the order.  Three small windows do
    the work of one: inside a bucket, over the fine buckets of a coarse one, and
    over the coarse ones.  No task sees all rows of a group, however hot.
    """
    keys = [*group, coarse, fine]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_bl_part"))
    before = (Window.unboundedPreceding, -1)
    fines = Window.partitionBy(*group, coarse).orderBy(fine).rowsBetween(*before)
    coarses = Window.partitionBy(*group).orderBy(coarse).rowsBetween(*before)
    top = sums.groupBy(*group, coarse).agg(F.sum("_bl_part").alias("_bl_top"))
    top = top.withColumn("_bl_top", F.coalesce(F.sum("_bl_top").over(coarses), F.lit(0)))
    sums = sums.withColumn("_bl_part", F.coalesce(F.sum("_bl_part").over(fines), F.lit(0)))
    sums = sums.join(top, [*group, coarse]).select(*keys, (F.col("_bl_part") + F.col("_bl_top")).alias("_bl_before"))
    inner = df.withColumn("_bl_in", F.sum(value).over(inside))
    return inner.join(sums, keys).withColumn(out, F.col("_bl_in") + F.col("_bl_before")).drop("_bl_in", "_bl_before")
