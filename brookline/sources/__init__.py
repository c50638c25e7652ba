"""Sources of pipelines: tables and files with a declared order, local rows, ranges, generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.order import ordinal
from ..plans.pipeline import SequentialPipeline, SplittableSource


def from_dataframe(df: DataFrame, order_by: list[str], splittable: bool = True, unique: bool = True) -> SequentialPipeline:
    """The rows of ``df`` in the order of columns that tell all rows apart.

    With ``unique`` false they need not: rows that they leave equal are ordered by a hash
    of all their columns, and a skip counts rows that are equal in all columns one by one.
    """
    keys = [F.col(c) for c in order_by] + ([] if unique else [F.xxhash64(*df.columns)])
    order = [ordinal(i) for i in range(len(keys))]
    rows = df.select(*(c.alias(o) for c, o in zip(keys, order)), "*")
    return (SplittableSource if splittable else SequentialPipeline)(rows, order, ties=not unique)


def from_parquet(spark: SparkSession, path: str, order_by: list[str]) -> SplittableSource:
    return from_dataframe(spark.read.parquet(path), order_by)


def from_table(spark: SparkSession, name: str, order_by: list[str]) -> SplittableSource:
    return from_dataframe(spark.table(name), order_by)


def from_range(spark: SparkSession, count: int, expression: Callable | None = None) -> SplittableSource:
    """The numbers 0 to ``count - 1`` as ``value``, or the columns that ``expression`` makes of them."""
    rows = spark.range(count).select(F.col("id").alias(ordinal(0)), F.col("id").alias("value"))
    source = SplittableSource(rows, [ordinal(0)], indexed=count)
    if expression is None:
        return source
    made = source.map(expression)
    return SplittableSource(made._df, made._order, indexed=count)


def _local(spark: SparkSession, rows: Iterable, kind: str | None) -> tuple[DataFrame, int]:
    """Local rows with their index; ``kind`` is the type of scalar elements, or a row type."""
    rows = list(rows)
    wrapped = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    if kind is None:
        width = len(rows[0]) if rows and isinstance(rows[0], tuple) else 1
        names = ["value"] if width == 1 else [f"_{i + 1}" for i in range(width)]
        if not rows:
            return spark.createDataFrame([], f"{ordinal(0)} bigint, value int"), 0
        whole = lambda k: all(isinstance(r[k + 1], int) and not isinstance(r[k + 1], bool) and -(2**31) <= r[k + 1] < 2**31 for r in wrapped if r[k + 1] is not None) and any(r[k + 1] is not None for r in wrapped)
        df = spark.createDataFrame(wrapped, [ordinal(0), *names])
        # Whole numbers of 32 bits are ints, as literals of the source language are.
        return df.select(ordinal(0), *(F.col(n).cast("int").alias(n) if whole(k) else F.col(n) for k, n in enumerate(names))), len(rows)
    parsed = T._parse_datatype_string(kind)
    fields = parsed.fields if isinstance(parsed, T.StructType) and len(parsed.fields) > 1 else [T.StructField("value", parsed.fields[0].dataType if isinstance(parsed, T.StructType) else parsed)]
    schema = T.StructType([T.StructField(ordinal(0), T.LongType()), *fields])
    return spark.createDataFrame(wrapped, schema), len(rows)


def from_array(spark: SparkSession, rows: Iterable, kind: str | None = None) -> SplittableSource:
    """Local rows, in the order they are in."""
    df, n = _local(spark, rows, kind)
    return SplittableSource(df, [ordinal(0)], indexed=n)


from_rows = from_array


def from_iterable(spark: SparkSession, rows: Iterable, kind: str | None = None) -> SequentialPipeline:
    """Local rows from any finite iterable, read once; not splittable."""
    df, n = _local(spark, rows, kind)
    return SequentialPipeline(df, [ordinal(0)], indexed=n)


def of(spark: SparkSession, value, kind: str | None = None) -> SequentialPipeline:
    """One element, which may be null."""
    column = F.lit(value) if kind is None else F.lit(value).cast(kind)
    return SequentialPipeline(spark.range(1).select(F.col("id").alias(ordinal(0)), column.alias("value")), [ordinal(0)], indexed=1)


def from_generator(spark: SparkSession, function: Callable[[], Iterable], kind: str) -> SequentialPipeline:
    """What the iterator that ``function`` returns yields, for ever if need be.

    A limit or a short-circuiting collector must follow.
    """
    from ..plans.shipping import ship
    from ..streaming.generator import GeneratorSource, packed

    ship(spark)
    spark.dataSource.register(GeneratorSource)
    df = spark.read.format(GeneratorSource.name()).option("function", packed(function)).option("schema", kind).load()
    return SequentialPipeline(df, [ordinal(0)], bounded=False)
