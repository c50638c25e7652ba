"""Typed sums, folds, parallel reductions, rejected programs."""

import pytest
from pyspark.sql import functions as F

from brookline import Collector, CompileConfig, ListOf, MinMax, ParallelCollector, RuntimeConfig, ShortCircuitingCollector, StringJoin, TakeFirst, ToMap, collector, find_first, from_dataframe, from_iterable, from_range, from_rows, generated, items, of, summing, to_array, to_list, to_set
from brookline.functions import chunk_count, chunk_of

TOP = 2**31 - 1


def test_sums_keep_their_type(spark):
    assert from_rows(spark, [1, 2, 3], "bigint").collect(summing()) == 6
    assert from_rows(spark, [1.5, 2.5, 3.5], "float").collect(summing()) == 7.5
    assert from_rows(spark, [1.5, 2.5, 3.5], "double").collect(summing()) == 7.5
    assert from_rows(spark, [2**63 - 1, 1], "bigint").collect(summing()) == -(2**63)
    assert from_rows(spark, [2**63 - 1, 1], "bigint").collect(summing(exact=True)) == -(2**63)
    assert from_rows(spark, [1, None, 3], "int").collect(summing()) == 4
    with pytest.raises(TypeError, match="summing needs"):
        from_rows(spark, ["a"], "string").collect(summing())


@pytest.mark.parametrize("exact", [False, True])
def test_int_sum_wraps(spark, exact):
    source = from_rows(spark, [TOP] * 103).parallel()
    assert source.collect(summing(exact), runtime_config=RuntimeConfig(3, 8)) == 2147483545


def test_order_of_additions(spark):
    source = from_rows(spark, [1e16, 1.0, -1e16, 1.0], "double").parallel()
    assert [source.collect(summing(exact=True), runtime_config=RuntimeConfig(2, k)) for k in (1, 2)] == [0.0, 1.0]


def test_long_products(spark):
    values = [(i - 51) * TOP for i in range(103)]
    got = from_rows(spark, values, "bigint").parallel().map(lambda e: e.value * 3).filter(lambda e: e.value > 0)
    assert got.collect(summing(), runtime_config=RuntimeConfig(3, 8)) == sum(v * 3 for v in values if v > 0)


@pytest.mark.parametrize(
    "size,workers,each,chunks",
    [(0, 8, 8, 0), (1, 8, 8, 1), (10**6, 1, 8, 1), (10**6, 8, 8, 64), (TOP, TOP, 8, TOP), (17, 2, 1, 2), (17, 2, 4, 8), (17, 2, 32, 17), (17, 2, TOP, 17)],
)
def test_chunk_count(size, workers, each, chunks):
    assert chunk_count(size, RuntimeConfig(workers, each)) == chunks


def test_chunks_begin_where_they_should(spark):
    for size, chunks in ((17, 5), (100, 64), (3, 3), (1000, 7)):
        got = [r[0] for r in spark.range(size).select("id", chunk_of(F.col("id"), size, chunks).alias("c")).orderBy("id").select("c").collect()]
        want = [c for c in range(chunks) for _ in range((c + 1) * size // chunks - c * size // chunks)]
        assert got == want
    far = spark.range(1).select(chunk_of(F.lit(TOP - 1), TOP, TOP)).first()[0]
    assert far == TOP - 1


@pytest.mark.parametrize("size", [0, 1, 2, 37, 10003])
@pytest.mark.parametrize("workers", [1, 16])
def test_each_element_once(spark, size, workers):
    got = from_range(spark, size).parallel().map(lambda e: (e.value * 3 + 1)).filter(lambda e: e.value % 5 != 0)
    config = RuntimeConfig(workers, 8)
    want = sum(x * 3 + 1 for x in range(size) if (x * 3 + 1) % 5)
    assert got.collect(summing(), runtime_config=config) == want
    assert got.collect(summing(exact=True), runtime_config=config) == want


def test_parallel_keeps_order(spark):
    ints = from_rows(spark, list(range(1, 51)))
    got = ints.parallel().map(lambda e: e.value * 3).filter(lambda e: e.value % 2 == 0)
    want = [x * 3 for x in range(1, 51) if x * 3 % 2 == 0]
    assert got.collect(to_array()) == want
    for config in (RuntimeConfig(3, 2), RuntimeConfig(1, 1), RuntimeConfig(50, 8)):
        assert got.collect(StringJoin(","), runtime_config=config) == ",".join(map(str, want))
    pairs = from_rows(spark, [1, 2, 3]).parallel().flat_map(lambda e: items(F.array(e.value, -e.value)))
    assert pairs.collect(to_array()) == [1, -1, 2, -2, 3, -3]
    assert pairs.collect(StringJoin(" "), runtime_config=RuntimeConfig(2, 2)) == "1 -1 2 -2 3 -3"
    assert from_rows(spark, [1, 3]).parallel().filter(lambda e: e.value > 5).collect(StringJoin(",")) == ""


class Letters(Collector):
    def supplier(self):
        return F.lit("")

    def accumulator(self, buffer, element):
        return F.concat(buffer, element)

    def finisher(self, buffer):
        return F.upper(buffer)


def test_folds(spark):
    assert from_rows(spark, ["b", "a", "c"], "string").collect(Letters()) == "BAC"
    assert from_rows(spark, [], "string").collect(Letters()) == ""
    assert from_rows(spark, [3, 1, 2]).collect(MinMax()) == (1, 3)
    assert from_rows(spark, [("a", 1), ("b", 2), ("a", 3)], "k string, v int").collect(ToMap()) == {"a": 3, "b": 2}
    assert from_rows(spark, [5, 4, 3]).collect(TakeFirst(2)) == [5, 4]


def test_short_circuit_on_the_driver(spark):
    class TakeTwo(ShortCircuitingCollector):
        def supplier(self):
            return []

        def accumulator(self, buffer, element):
            buffer.append(element)
            return len(buffer) == 2

    got = from_rows(spark, [1, 2, 3]).flat_map(lambda e: items(F.transform(F.array(F.lit(10), F.lit(20), F.lit(30)), lambda x: x + e.value)))
    assert got.collect(TakeTwo()) == [11, 21]


def test_rejected_programs(spark):
    source = from_rows(spark, [1, 2, 3])
    with pytest.raises(TypeError, match="Use flatMap instead."):
        source.map(lambda e: items(F.array(e.value)))
    with pytest.raises(TypeError, match="Use flatMap instead."):
        source.map(lambda e: source)
    with pytest.raises(TypeError, match="cannot contain another Stream as an element"):
        source.flat_map(lambda e: e.value)
    with pytest.raises(TypeError, match="ParallelStream"):
        source.flat_map(lambda e: source.parallel())
    assert not hasattr(source.map(lambda e: e.value), "parallel")
    assert not hasattr(source.parallel(), "parallel")
    assert not hasattr(from_iterable(spark, [1]), "parallel") and not hasattr(of(spark, 1), "parallel")
    assert not hasattr(source.parallel(), "skip") and not hasattr(source.parallel(), "limit")
    for terminal in (find_first(), to_list(), to_set(), Letters()):
        with pytest.raises(TypeError, match="ParallelCollector"):
            source.parallel().collect(terminal)
    with pytest.raises(AttributeError, match="no column"):
        source.map(lambda e: e.other)


def test_strict_collectors(spark):
    source = from_rows(spark, [1, 2, 3])
    anonymous = collector(lambda: F.lit(0), lambda b, e: b + e, combine=lambda a, b: a + b)
    with pytest.raises(TypeError, match="requires a named concrete collector class"):
        source.collect(anonymous)
    loose = CompileConfig(strict_inlining=False)
    assert source.collect(anonymous, loose) == 6
    assert source.parallel().collect(anonymous, loose, RuntimeConfig(2, 1)) == 6

    class NoCombine(ParallelCollector):
        def supplier(self):
            return F.lit(0)

        def accumulator(self, buffer, element):
            return buffer + element

    with pytest.raises(TypeError, match="must have a concrete inline implementation"):
        source.parallel().collect(NoCombine())


def test_configs():
    for bad in ({"worker_count": 0}, {"chunks_per_worker": -1}):
        with pytest.raises(ValueError, match="must be positive"):
            RuntimeConfig(**bad)
    with pytest.raises(TypeError, match="must be known"):
        CompileConfig(use_unsafe="yes")


def test_failure_surfaces_and_session_goes_on(spark):
    source = from_range(spark, 103).parallel()
    failing = source.map(lambda e: F.when(e.value == 42, F.raise_error(F.lit("boom 42")).cast("bigint")).otherwise(e.value))
    with pytest.raises(Exception, match="boom 42"):
        failing.collect(summing())
    assert source.collect(summing()) == sum(range(103))


@pytest.mark.parametrize("workers,each", [(1, 1), (3, 1), (3, 4)])
def test_folds_in_rounds(spark, monkeypatch, workers, each):
    from brookline.operators import collectors

    values = [((k * 7919) % 1000) * 10.0 ** (k % 17 - 8) for k in range(1003)]
    source = from_rows(spark, values, "double").parallel()
    words = from_rows(spark, [f"w{k}" if k % 5 else None for k in range(301)], "string").filter(lambda e: e.value.isNotNull() | e.value.isNull())
    config = RuntimeConfig(workers, each)
    whole = source.collect(summing(exact=True), runtime_config=config)
    joined = words.collect(ListOf("string"))
    monkeypatch.setattr(collectors, "BLOCK", 37)
    assert source.collect(summing(exact=True), runtime_config=config) == whole
    assert words.collect(ListOf("string")) == joined == [f"w{k}" if k % 5 else None for k in range(301)]
    assert from_rows(spark, [], "double").parallel().collect(summing(exact=True), runtime_config=config) == 0


def test_logging_prints_the_plan(spark, capfd):
    source = from_rows(spark, [1, 2, 3])
    source.collect(summing())
    assert "Codegen" not in capfd.readouterr().out
    source.collect(summing(), CompileConfig(enable_logging=True))
    assert "codegen" in capfd.readouterr().out.lower()


def test_inner_sequences_of_any_kind(spark):
    outer = from_rows(spark, [2, 3])
    inner = from_rows(spark, [10, 20]).map(lambda e: {"x": e.value})
    assert outer.flat_map(lambda e: inner).collect(to_list()) == [10, 20, 10, 20]
    deep = outer.flat_map(lambda e: items(F.sequence(F.lit(1), e.value), keep=("value",) * 0).nest(lambda v: generated(lambda n: iter(range(n)), ["value"], "int").limit(9)).limit(4))
    assert deep.collect(to_list()) == [0, 0, 1, 0, 0, 1, 0]
    with pytest.raises(TypeError, match="ParallelStream"):
        outer.flat_map(lambda e: from_rows(spark, [1]).parallel())
    with pytest.raises(ValueError, match="needs a limit"):
        outer.flat_map(lambda e: generated(lambda v: iter(int, 1), ["value"], "int").map(abs)).collect(to_list())


def test_skip_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b"), (2, "c"), (2, "b")], "k int, v string")
    source = from_dataframe(df, ["k"], unique=False)
    for n in range(10):
        assert len(source.skip(n).rows.collect()) == max(0, 8 - n)
