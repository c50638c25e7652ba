"""Inner sequences of flat_map: arrays, related rows, generated rows, other pipelines, and sequences inside these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _check(what: str, count: int) -> None:
    if count < 0:
        raise ValueError(f"{what} count cannot be negative: {count}")


class Inner:
    """An inner sequence; its slices count anew for each outer element."""

    def expand(self, outer: DataFrame, order: list[str], position: str) -> tuple[DataFrame, list[str]]:
        raise NotImplementedError


class Items(Inner):
    """The elements of an array: all steps stay in one row of the outer element."""

    def __init__(self, array: Column, keep: tuple[str, ...] = ()):
        self.array, self.keep = array, keep

    def filter(self, predicate: Callable[[Column], Column]) -> Items:
        return Items(F.filter(self.array, predicate), self.keep)

    def map(self, function: Callable[[Column], Column]) -> Items:
        def checked(x: Column) -> Column:
            got = function(x)
            if isinstance(got, Inner):
                raise TypeError("map cannot return a Stream. Use flatMap instead.")
            return got

        return Items(F.transform(self.array, checked), self.keep)

    def flat_map(self, function: Callable[[Column], Items]) -> Items:
        """``function`` returns `items` of an array; see `Related.flat_map` for sequences of other kinds."""

        def array(x: Column) -> Column:
            got = function(x)
            if not isinstance(got, Items):
                raise TypeError("flatMap needs an inner Stream; it cannot contain another Stream as an element")
            return got.array

        return Items(F.flatten(F.transform(self.array, array)), self.keep)

    def nest(self, function: Callable) -> Nested:
        """Like `flat_map`, for inner sequences of any kind; ``function`` takes the columns (``value``)."""
        return Nested(self, function)

    def skip(self, count: int) -> Items:
        _check("skip", count)
        return Items(F.slice(self.array, F.lit(count + 1), F.greatest(F.size(self.array), F.lit(0))), self.keep)

    def limit(self, count: int) -> Items:
        _check("limit", count)
        return Items(F.slice(self.array, F.lit(1), F.lit(count)), self.keep)

    def expand(self, outer, order, position):
        kept = [F.col(c) for c in (*order, *self.keep)]
        rows = outer.select(*kept, F.posexplode(self.array).alias(position, "value"))
        return rows, [*order, position]


class Related(Inner):
    """Rows of another DataFrame that belong to the outer element by equal columns.

    Slices number the related rows of each key once, before the join, so a key
    with very many rows is cut down first.
    """

    def __init__(self, df: DataFrame, on: dict[str, str], order_by: list[str], keep: tuple[str, ...] = ()):
        self.df, self.on, self.order_by, self.keep = df, on, order_by, keep

    def _with(self, df: DataFrame) -> Related:
        return Related(df, self.on, self.order_by, self.keep)

    def filter(self, predicate: Column | str) -> Related:
        return self._with(self.df.filter(predicate))

    def map(self, **columns: Column) -> Related:
        kept = dict.fromkeys([*self.on.values(), *self.order_by])
        return self._with(self.df.select(*(c for c in kept if c not in columns), *(c.alias(n) for n, c in columns.items())))

    def flat_map(self, function: Callable) -> Nested:
        """``function`` takes a related row's columns and returns an inner sequence of any kind."""
        return Nested(self, function)

    def _slice(self, low: int, high: int | None) -> Related:
        over = Window.partitionBy(*self.on.values()).orderBy(*self.order_by)
        rows = self.df.withColumn("__rn", F.row_number().over(over)).filter(F.col("__rn") > low)
        return self._with((rows if high is None else rows.filter(F.col("__rn") <= high)).drop("__rn"))

    def skip(self, count: int) -> Related:
        _check("skip", count)
        return self._slice(count, None)

    def limit(self, count: int) -> Related:
        _check("limit", count)
        return self._slice(0, count)

    def expand(self, outer, order, position):
        left = outer.select(*order, *self.keep, *(F.col(c).alias(f"__on{i}") for i, c in enumerate(self.on)))
        ties = [f"{position}_{i}" for i in range(len(self.order_by))]
        right = self.df.select("*", *(F.col(c).alias(t) for c, t in zip(self.order_by, ties)), *(F.col(c).alias(f"__to{i}") for i, c in enumerate(self.on.values())))
        same = [left[f"__on{i}"] == right[f"__to{i}"] for i in range(len(self.on))]
        rows = left.join(right, same).drop(*(f"__on{i}" for i in range(len(self.on))), *(f"__to{i}" for i in range(len(self.on))))
        return rows, [*order, *ties]


class Generated(Inner):
    """What a Python generator function yields for the outer element's columns.

    Its steps are Python functions of an item, taken one by one as items are asked for.
    The generator may have no end; so it needs a limit, and is run up to it only.
    """

    def __init__(self, function: Callable, arguments: list[str], kind: str, steps: tuple = (), keep: tuple[str, ...] = ()):
        self.function, self.arguments, self.kind, self.steps, self.keep = function, arguments, kind, steps, keep

    def _with(self, step: str, what, kind: str | None = None) -> Generated:
        return Generated(self.function, self.arguments, kind or self.kind, (*self.steps, (step, what)), self.keep)

    def filter(self, predicate: Callable) -> Generated:
        return self._with("filter", predicate)

    def map(self, function: Callable, kind: str | None = None) -> Generated:
        """``kind`` is the type of what ``function`` returns, if another."""
        return self._with("map", function, kind)

    def flat_map(self, function: Callable, kind: str | None = None) -> Generated:
        """``function`` returns an iterable, which may have no end either."""
        return self._with("flat_map", function, kind)

    def skip(self, count: int) -> Generated:
        _check("skip", count)
        return self._with("skip", count)

    def limit(self, count: int) -> Generated:
        _check("limit", count)
        return self._with("limit", count)

    def expand(self, outer, order, position):
        if not any(step == "limit" for step, _ in self.steps):
            raise ValueError("a generated inner sequence needs a limit")
        function, steps = self.function, self.steps

        def rows(*values):
            from itertools import chain, islice

            found = iter(function(*values))
            for step, what in steps:
                if step == "filter":
                    found = filter(what, found)
                elif step == "map":
                    found = map(what, found)
                elif step == "flat_map":
                    found = chain.from_iterable(map(what, found))
                else:
                    found = islice(found, what, None) if step == "skip" else islice(found, what)
            return list(found)

        array = F.udf(rows, f"array<{self.kind}>", useArrow=True)(*self.arguments)
        return Items(array, self.keep).expand(outer, order, position)


class Whole(Inner):
    """All elements of a pipeline that doesn't depend on the outer element, for each of these."""

    def __init__(self, pipeline, keep: tuple[str, ...] = ()):
        self.pipeline, self.keep = pipeline, keep

    def expand(self, outer, order, position):
        self.pipeline._check_bounded()
        own, names = self.pipeline._order, self.pipeline.names
        ties = [f"{position}_{i}" for i in range(len(own))]
        right = self.pipeline.rows.select(*(F.col(c).alias(t) for c, t in zip(own, ties)), *names)
        return outer.select(*order, *self.keep).crossJoin(right), [*order, *ties]


class Nested(Inner):
    """A sequence for each element of a sequence; steps and slices after it count per outer element."""

    def __init__(self, base: Inner, function: Callable, steps: tuple = ()):
        self.base, self.function, self.steps = base, function, steps

    def _with(self, step: str, what) -> Nested:
        return Nested(self.base, self.function, (*self.steps, (step, what)))

    def filter(self, predicate: Column | str) -> Nested:
        return self._with("filter", predicate)

    def map(self, **columns: Column) -> Nested:
        return self._with("map", columns)

    def flat_map(self, function: Callable) -> Nested:
        return Nested(self, function)

    def skip(self, count: int) -> Nested:
        _check("skip", count)
        return self._with("skip", count)

    def limit(self, count: int) -> Nested:
        _check("limit", count)
        return self._with("limit", count)

    def expand(self, outer, order, position):
        from ..plans.order import ordinal
        from ..plans.pipeline import Element, inner_of

        rows, middle = self.base.expand(outer, order, position)
        names = [c for c in rows.columns if c not in middle]
        rows, every = inner_of(self.function(Element(names))).expand(rows, middle, f"{ordinal(len(middle))}n")
        for step, what in self.steps:
            if step == "filter":
                rows = rows.filter(what)
            elif step == "map":
                rows = rows.select(*every, *(c.alias(n) for n, c in what.items()))
            else:
                over = Window.partitionBy(*order).orderBy(*every[len(order) :])
                rows = rows.withColumn("__rn", F.row_number().over(over))
                rows = rows.filter(F.col("__rn") > what if step == "skip" else F.col("__rn") <= what).drop("__rn")
        return rows, every


def items(array: Column, keep: tuple[str, ...] = ()) -> Items:
    """The elements of ``array``, as ``value``; ``keep`` names outer columns that go along."""
    return Items(array, keep)


def related(df: DataFrame, on: dict[str, str], order_by: list[str], keep: tuple[str, ...] = ()) -> Related:
    """Rows of ``df`` whose columns ``on.values()`` equal the outer ``on`` keys, by ``order_by``."""
    return Related(df, on, order_by, keep)


def whole(pipeline, keep: tuple[str, ...] = ()) -> Whole:
    """All elements of ``pipeline``; ``keep`` names outer columns that go along."""
    return Whole(pipeline, keep)


def generated(function: Callable, arguments: list[str], kind: str = "string", keep: tuple[str, ...] = ()) -> Generated:
    """What ``function`` yields for the named outer columns; ``kind`` is the type of an item."""
    return Generated(function, arguments, kind, keep=keep)
