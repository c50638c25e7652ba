"""Terminals: what a pipeline's elements are reduced to.

A collector has a plan, a DataFrame that is not yet run, and makes a Python value
of it.  Folds are given as functions of columns, so that they run as Catalyst
expressions; order-sensitive folds run over an array in source order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CompileConfig, RuntimeConfig
from ..functions.chunks import chunk_count, chunk_of, start_of
from ..functions.sums import adder, check_summable, typed_sum
from ..plans.order import key, positions


@dataclass(frozen=True)
class Found:
    """The element that `find_first` found; it may be null."""

    value: Any


def plain(row):
    """A one-column element as its value, others as rows."""
    return row[0] if len(row) == 1 else row


class Terminal:
    #: Whether parts can be reduced on their own and combined.
    combinable = False
    short_circuiting = False

    def check(self, pipeline, config: CompileConfig) -> None:
        from ..plans.pipeline import ParallelPipeline

        if isinstance(pipeline, ParallelPipeline) and not self.combinable:
            raise TypeError(f"a parallel pipeline needs a ParallelCollector; {type(self).__name__} cannot be combined")
        if not self.short_circuiting:
            pipeline._check_bounded()

    def plan(self, pipeline, runtime: RuntimeConfig) -> DataFrame:
        raise NotImplementedError

    def run(self, pipeline, planned: Callable[[], DataFrame]):
        raise NotImplementedError


class _Elements(Terminal):
    def plan(self, pipeline, runtime):
        return pipeline.dataframe()

    def run(self, pipeline, planned):
        return [plain(r) for r in planned().collect()]


class ToArray(_Elements):
    combinable = True


class ToList(_Elements):
    pass


class ToSet(Terminal):
    """Distinct elements; null is one of them."""

    def plan(self, pipeline, runtime):
        return pipeline.rows.select(*pipeline.names).distinct()

    def run(self, pipeline, planned):
        return {plain(r) for r in planned().collect()}


class FindFirst(Terminal):
    """The first element, as `Found`, or None; no rows or one in the plan."""

    short_circuiting = True

    def plan(self, pipeline, runtime):
        return pipeline.limit(1).dataframe()

    def run(self, pipeline, planned):
        rows = planned().collect()
        return Found(plain(rows[0])) if rows else None


class Summing(Terminal):
    """The sum of one-column elements, in their own type; zero if there are none.

    ``exact`` adds in source order within each of the run's chunks, then the
    chunks' sums in order; for floating point only that is reproducible to the bit.
    """

    combinable = True

    def __init__(self, exact: bool = False):
        self.exact = exact

    def plan(self, pipeline, runtime):
        (name,) = pipeline.names if len(pipeline.names) == 1 else (None,)
        if name is None:
            raise TypeError(f"summing needs elements of one column, not {', '.join(pipeline.names)}")
        kind = pipeline._df.schema[name].dataType
        check_summable(kind)
        if not self.exact:
            return pipeline.rows.agg(typed_sum(F.col(name), kind).alias("value"))
        zero, add = adder(kind)
        return folded(pipeline, runtime, lambda: zero, add, add, lambda b: b)

    def run(self, pipeline, planned):
        return planned().first()[0]


class Collector(Terminal):
    """A fold: ``supplier()`` makes the buffer, ``accumulator(buffer, element)`` the next one,
    ``finisher(buffer)`` the result.  All are functions of columns.

    Elements of one column come as its value, others as structs with its columns.
    One buffer goes through all elements in source order, `BLOCK` of them at a time, so
    a long sequence takes many rounds; a `ParallelCollector` takes as many of one chunk.
    """

    def supplier(self) -> Column:
        raise NotImplementedError

    def accumulator(self, buffer: Column, element: Column) -> Column:
        raise NotImplementedError

    def finisher(self, buffer: Column) -> Column:
        return buffer

    _needed = ("supplier", "accumulator")

    def check(self, pipeline, config):
        super().check(pipeline, config)
        if config.strict_inlining:
            if getattr(type(self), "_anonymous", False):
                raise TypeError("strict inlining requires a named concrete collector class")
            for name in self._needed:
                if getattr(type(self), name) in (getattr(Collector, name, None), getattr(ParallelCollector, name, None)):
                    raise TypeError(f"{type(self).__name__}.{name} must have a concrete inline implementation")

    def plan(self, pipeline, runtime):
        return folded(pipeline, RuntimeConfig(1, 1), self.supplier, self.accumulator, None, self.finisher)

    def run(self, pipeline, planned):
        return planned().first()[0]


class ParallelCollector(Collector):
    """A fold whose parts are combined in order: ``combine(buffer, buffer)`` must be associative."""

    combinable = True
    _needed = ("supplier", "accumulator", "combine")

    def combine(self, left: Column, right: Column) -> Column:
        raise NotImplementedError

    def plan(self, pipeline, runtime):
        return folded(pipeline, runtime, self.supplier, self.accumulator, self.combine, self.finisher)


#: Elements that a fold holds in one array.
BLOCK = 1 << 16


def folded(pipeline, runtime: RuntimeConfig, supplier, accumulator, combine, finisher, block: int | None = None) -> DataFrame:
    """Chunks of the sequence folded in order, then their buffers from left to right.

    There are as many chunks as the run asks for.  A chunk of more than `BLOCK` elements
    is folded in rounds: in each, every chunk's buffer takes its next block, so that no
    array is longer.  The second fold has one buffer per chunk.
    """
    block = block or BLOCK
    rows, order, names = pipeline.rows, pipeline._order, pipeline.names
    if pipeline._indexed is not None and len(order) == 1:
        size, rows = pipeline._indexed, rows.withColumn("__at", F.col(order[0]))
    else:
        size = rows.count()
        rows = positions(rows, order, "__at", size)
    chunks = chunk_count(size, runtime)
    element = F.struct(*names) if len(names) > 1 else F.col(names[0])
    chunk = chunk_of(F.col("__at"), max(size, 1), max(chunks, 1))
    # The struct around an element keeps those that are null.
    rows = rows.select(chunk.alias("__chunk"), "__at", key(order).alias("o"), F.struct(element.alias("v")).alias("e"))
    every = F.array_sort(F.collect_list(F.struct("__at", "o", "e")))
    fold = lambda array, first: F.aggregate(array, first, lambda b, x: accumulator(b, x["e"]["v"]))
    longest = -(-size // max(chunks, 1))
    if longest <= block:
        parts = rows.groupBy("__chunk").agg(fold(every, supplier()).alias("b"))
    else:
        parts = _rounds(rows, every, fold, supplier, size, chunks, -(-longest // block), block)
    if chunks <= 1:
        return parts.agg(F.first(F.struct("b")).alias("s")).select(F.when(F.col("s").isNull(), finisher(supplier())).otherwise(finisher(F.col("s.b"))).alias("value"))
    every = F.array_sort(F.collect_list(F.struct("__chunk", F.struct("b").alias("s"))))
    first = F.get(every, 0)["s"]["b"]
    rest = F.slice(every, F.lit(2), F.greatest(F.size(every), F.lit(1)))
    return parts.agg(F.when(F.size(every) == 0, finisher(supplier())).otherwise(F.aggregate(rest, first, lambda b, x: combine(b, x["s"]["b"]), finisher)).alias("value"))


def _rounds(rows: DataFrame, every: Column, fold, supplier, size: int, chunks: int, rounds: int, block: int) -> DataFrame:
    """``(__chunk, b)`` after ``rounds`` rounds of a block of each chunk; a buffer for each chunk passes through the driver."""
    spark = rows.sparkSession
    start = start_of(F.col("__chunk"), size, chunks)
    rows = rows.withColumn("__block", F.floor((F.col("__at") - start) / block)).persist(StorageLevel.DISK_ONLY)
    parts = None
    for k in range(rounds):
        now = rows.filter(F.col("__block") == k).groupBy("__chunk").agg(every.alias("x"))
        if parts is None:
            now = now.select("__chunk", fold(F.col("x"), supplier()).alias("b"))
        else:
            now = parts.join(now, "__chunk", "left")
            now = now.select("__chunk", F.when(F.col("x").isNull(), F.col("b")).otherwise(fold(F.col("x"), F.col("b"))).alias("b"))
        parts = spark.createDataFrame(now.collect(), now.schema)
    rows.unpersist()
    return parts


class ShortCircuitingCollector(Terminal):
    """A fold in Python on the driver that may stop: ``accumulator`` returns true for enough.

    Elements come over partition by partition in order, and no more than needed.
    """

    short_circuiting = True

    def supplier(self):
        raise NotImplementedError

    def accumulator(self, buffer, element) -> bool:
        raise NotImplementedError

    def finisher(self, buffer):
        return buffer

    def plan(self, pipeline, runtime):
        return pipeline.dataframe() if pipeline._bounded else pipeline.rows.select(*pipeline.names)

    def run(self, pipeline, planned):
        buffer = self.supplier()
        for row in planned().toLocalIterator():
            if self.accumulator(buffer, plain(row)):
                break
        return self.finisher(buffer)


def collector(supplier, accumulator, finisher=lambda b: b, combine=None) -> Collector:
    """A collector from functions; it has no name, so strict inlining refuses it."""
    body = {
        "_anonymous": True,
        "supplier": lambda self: supplier(),
        "accumulator": lambda self, b, e: accumulator(b, e),
        "finisher": lambda self, b: finisher(b),
    }
    if combine is not None:
        body["combine"] = lambda self, a, b: combine(a, b)
    return type("AnonymousCollector", (ParallelCollector if combine else Collector,), body)()


class MinMax(Terminal):
    """The smallest and largest of one-column elements; nulls if there are none."""

    combinable = True

    def plan(self, pipeline, runtime):
        (name,) = pipeline.names
        return pipeline.rows.agg(F.min(name).alias("min"), F.max(name).alias("max"))

    def run(self, pipeline, planned):
        return tuple(planned().first())


class ToMap(Terminal):
    """Key and value of two-column elements; of equal keys the last element counts."""

    def plan(self, pipeline, runtime):
        k, v = pipeline.names
        last = F.max_by(F.struct(v), key(pipeline._order))
        return pipeline.rows.groupBy(k).agg(last.alias("s")).select(k, F.col("s")[v].alias(v))

    def run(self, pipeline, planned):
        return {r[0]: r[1] for r in planned().collect()}


class StringJoin(ParallelCollector):
    """Elements as strings, joined in order."""

    def __init__(self, separator: str = ""):
        self.separator = separator

    def supplier(self):
        return F.lit(None).cast("string")

    def accumulator(self, buffer, element):
        return F.when(buffer.isNull(), element.cast("string")).otherwise(F.concat(buffer, F.lit(self.separator), element.cast("string")))

    def combine(self, left, right):
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.concat(left, F.lit(self.separator), right))

    def finisher(self, buffer):
        return F.coalesce(buffer, F.lit(""))


class ListOf(ParallelCollector):
    """A list of one-column elements in order: parts build lists of their own, which are joined."""

    def __init__(self, kind: str):
        self.kind = kind

    def supplier(self):
        return F.array().cast(f"array<{self.kind}>")

    def accumulator(self, buffer, element):
        return F.array_append(buffer, element.cast(self.kind))

    def combine(self, left, right):
        return F.concat(left, right)


class TakeFirst(Terminal):
    """The first ``count`` elements; the source ends there."""

    short_circuiting = True

    def __init__(self, count: int):
        self.count = count

    def plan(self, pipeline, runtime):
        return pipeline.limit(self.count).dataframe()

    def run(self, pipeline, planned):
        return [plain(r) for r in planned().collect()]


def to_array() -> ToArray:
    return ToArray()


def to_list() -> ToList:
    return ToList()


def to_set() -> ToSet:
    return ToSet()


def find_first() -> FindFirst:
    return FindFirst()


def summing(exact: bool = False) -> Summing:
    return Summing(exact)
