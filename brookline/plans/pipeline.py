"""Pipelines: immutable descriptions of an ordered sequence on top of a DataFrame.

What may follow is fixed by the class: a splittable source can be made parallel
before anything else; a parallel pipeline has no slices and takes collectors only
whose parts can be combined.  All steps are lazy; Catalyst fuses, prunes and
pushes them down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CompileConfig, RuntimeConfig
from ..operators import inner as inner_sequences
from .order import PREFIX, key, ordinal


class Element:
    """The columns of the current element, as attributes or items."""

    def __init__(self, names: list[str]):
        self._names = names

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__") or name not in self._names:
            raise AttributeError(f"the element has no column {name!r}; it has {', '.join(self._names)}")
        return F.col(name)

    def __getitem__(self, name: str) -> Column:
        return getattr(self, name)


class Pipeline:
    """What all pipelines share: filter, map and flat_map."""

    def __init__(self, df: DataFrame, order: list[str], bounded: bool = True, skipped: int = 0, indexed: int | None = None, ties: bool = False):
        #: ``ties``: rows may have equal ordinals.
        #: ``skipped``: a skip that is still to be done; with a limit after it, it is one operator.
        #: ``indexed``: the number of elements, if the one ordinal is their 0-based index.
        self._df, self._order, self._bounded, self._skipped, self._indexed, self._ties = df, order, bounded, skipped, indexed, ties

    def _as(self, df: DataFrame, order: list[str] | None = None, **state) -> Pipeline:
        kind = ParallelPipeline if isinstance(self, ParallelPipeline) else SequentialPipeline
        return kind(df, order or self._order, state.get("bounded", self._bounded), state.get("skipped", 0), state.get("indexed"), self._ties)

    @property
    def names(self) -> list[str]:
        """The columns of an element."""
        return [c for c in self._df.columns if not c.startswith(PREFIX)]

    @property
    def rows(self) -> DataFrame:
        """Elements with their ordinal columns, all steps done, in no order."""
        df = self._df
        if self._skipped:
            # The largest ordinal among the first n; with fewer than n rows nothing is above it.
            first = df.orderBy(*self._order).limit(self._skipped) if self._bounded else df.limit(self._skipped)
            last = first.agg(F.max(key(self._order)).alias("m"))
            if not self._ties:
                return df.filter(key(self._order) > last.scalar())
            # Of the rows that are equal to the last one left out, as many go as are among the first n.
            end = last.first()["m"]
            if end is None:
                return df
            end = F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(self._order, end)))
            within = first.filter(key(self._order).eqNullSafe(end)).count()
            equal = df.filter(key(self._order).eqNullSafe(end))
            df = df.filter(key(self._order) > end).unionByName(equal.offset(within))
        return df

    def dataframe(self) -> DataFrame:
        """The elements in order, without ordinals."""
        self._check_bounded()
        if self._skipped:
            return self._df.orderBy(*self._order).offset(self._skipped).select(*self.names)
        return self._df.orderBy(*self._order).select(*self.names)

    def _check_bounded(self) -> None:
        if not self._bounded:
            raise ValueError("an unbounded source needs a limit or a short-circuiting collector")

    def _call(self, function) -> object:
        if isinstance(function, str):
            return F.expr(function)
        return function(Element(self.names)) if callable(function) and not isinstance(function, Column) else function

    def filter(self, predicate: Callable[[Element], Column] | Column | str) -> Pipeline:
        """Keeps the elements for which ``predicate`` is true."""
        return self._as(self.rows.filter(self._call(predicate)))

    def map(self, function: Callable[[Element], Column | dict | tuple] | Column | str) -> Pipeline:
        """One element for each: a column (``value``), named columns, or a tuple (``_1``, ``_2``, ...)."""
        got = self._call(function)
        if isinstance(got, (Pipeline, inner_sequences.Inner)):
            raise TypeError("map cannot return a Stream. Use flatMap instead.")
        if isinstance(got, tuple):
            got = {f"_{i + 1}": c for i, c in enumerate(got)}
        if not isinstance(got, dict):
            got = {"value": got}
        for c in got.values():
            if isinstance(c, (Pipeline, inner_sequences.Inner)):
                raise TypeError("a Stream cannot contain another Stream as an element")
        columns = [(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in got.items()]
        return self._as(self.rows.select(*self._order, *columns), indexed=self._indexed if not self._skipped else None)

    def flat_map(self, function: Callable[[Element], inner_sequences.Inner]) -> Pipeline:
        """The elements of an inner sequence for each element, in the order of both.

        ``function`` returns `items` of an array, a `related` pipeline, a
        `generated` sequence or another sequential pipeline, with its own steps and slices.
        """
        rows, order = inner_of(self._call(function)).expand(self.rows, self._order, ordinal(len(self._order)))
        return self._as(rows, order)


def inner_of(got) -> inner_sequences.Inner:
    """What a function for flat_map returned, as an inner sequence."""
    if isinstance(got, ParallelPipeline):
        raise TypeError("the inner sequence of flatMap must be a SequentialStream, not a ParallelStream")
    if isinstance(got, Pipeline):
        return inner_sequences.Whole(got)
    if not isinstance(got, inner_sequences.Inner):
        raise TypeError("flatMap needs an inner Stream; it cannot contain another Stream as an element")
    return got


class _Collecting:
    def plan(self, collector, compile_config: CompileConfig | None = None, runtime_config: RuntimeConfig | None = None) -> DataFrame:
        """The result of ``collector`` as a DataFrame, not yet run."""
        compile_config = compile_config or CompileConfig()
        collector.check(self, compile_config)
        df = collector.plan(self, runtime_config or RuntimeConfig())
        if compile_config.enable_logging:
            df.explain("codegen")
        return df

    def collect(self, collector, compile_config: CompileConfig | None = None, runtime_config: RuntimeConfig | None = None):
        """Runs the pipeline and returns what ``collector`` makes of it."""
        collector.check(self, compile_config or CompileConfig())
        return collector.run(self, lambda: self.plan(collector, compile_config, runtime_config))


class SequentialPipeline(_Collecting, Pipeline):
    """An ordered sequence with slices."""

    def skip(self, count: int) -> SequentialPipeline:
        """Leaves out the first ``count`` elements that get here."""
        if count < 0:
            raise ValueError(f"skip count cannot be negative: {count}")
        return self._as(self._df, skipped=self._skipped + count)

    def limit(self, count: int) -> SequentialPipeline:
        """Passes the first ``count`` elements that get here, and ends the source then."""
        if count < 0:
            raise ValueError(f"limit count cannot be negative: {count}")
        if not self._bounded:
            # Elements come from one partition in order; sorting would never end.
            df = self._df.offset(self._skipped) if self._skipped else self._df
            return self._as(df.limit(count), bounded=True)
        df = self._df.orderBy(*self._order)
        if self._skipped:
            df = df.offset(self._skipped)
        return self._as(df.limit(count))


class SplittableSource(SequentialPipeline):
    """A source that can be split, with nothing applied yet."""

    def parallel(self) -> ParallelPipeline:
        return ParallelPipeline(self._df, self._order, self._bounded, 0, self._indexed, self._ties)


class ParallelPipeline(_Collecting, Pipeline):
    """A sequence whose parts are reduced on their own and combined in order."""
