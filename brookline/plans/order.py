"""The order of a sequence, carried in columns.

Rows of a DataFrame have no order, so a pipeline keeps its source's order in
hidden columns: the source's ordinal, and one more position for each expansion.
Rows compare by these columns from left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "__ord"
#: Rows that are numbered in one run, about, while there are few runs for each shuffle partition.
RUN = 1 << 14
#: Runs for each shuffle partition at most, and rows of the sample for each run.
RUNS, SAMPLED = 4, 32


def ordinal(k: int) -> str:
    return f"{PREFIX}{k}"


def key(order: list[str]) -> Column:
    """The whole ordinal as one comparable value."""
    return F.struct(*order)


def literal(value, kind: T.DataType) -> Column:
    """A collected value as a literal of its type."""
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*(literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)))
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*(literal(v, kind.elementType) for v in value)).cast(kind)
    return F.lit(value).cast(kind)


def run_of(df: DataFrame, order: list[str], size: int) -> Column:
    """The run of a row: how many of some fixed ordinals are not above its own.

    The ordinals come from a sample, which decides only how even the runs are.  They
    are literals, so that a row has the same run wherever this is evaluated.
    """
    runs = min(-(-size // RUN), RUNS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if runs <= 1:
        return F.lit(0)
    keys = df.select(*order)
    if size > runs * SAMPLED:
        keys = keys.sample(runs * SAMPLED / size)
    found = keys.orderBy(*order).collect()
    first = list(dict.fromkeys(k * len(found) // runs for k in range(1, runs))) if found else []
    if not first:
        return F.lit(0)
    bounds = F.array(*(literal(found[k], keys.schema) for k in first))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(first).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) <= key(order), n + step).otherwise(n))


def positions(df: DataFrame, order: list[str], out: str, size: int | None = None) -> DataFrame:
    """``df``, of ``size`` rows, with the 0-based position of each row in ``out``.

    Rows are dealt by runs of the ordinal and numbered in their run; the rows before
    each run are added.  Runs are a function of the ordinal: they are counted without
    the other columns, and partitions that Spark samples or coalesces would not be the
    same there.  The only thing that is in one place is one row per run.
    """
    runs = df.withColumn("__run", run_of(df, order, df.count() if size is None else size))
    counts = runs.groupBy("__run").count()
    over = Window.partitionBy(F.lit(0)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__run", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__run").orderBy(*order)
    numbered = runs.withColumn(out, F.row_number().over(inside) - 1)
    numbered = numbered.join(F.broadcast(before), "__run")  # one row per run
    return numbered.withColumn(out, F.col(out) + F.col("__before")).drop("__run", "__before")
