"""Order, slices, expansion, nulls, empty input."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookline import Found, find_first, from_array, from_dataframe, from_generator, from_iterable, from_range, from_rows, generated, items, of, related, summing, to_array, to_list, to_set
from brookline.sources import from_parquet


def even(e):
    return e.value % 2 == 0


@pytest.fixture
def ints(spark):
    return lambda n: from_rows(spark, list(range(1, n + 1)))


def test_slices_count_where_they_stand(ints):
    assert ints(8).skip(1).filter(even).limit(2).skip(1).collect(to_list()) == [4]
    assert ints(8).skip(100).limit(1).collect(to_list()) == []
    assert ints(8).limit(2).collect(to_list()) == [1, 2]
    assert ints(10).skip(3).collect(to_list()) == [4, 5, 6, 7, 8, 9, 10]
    assert ints(10).limit(4).collect(to_list()) == [1, 2, 3, 4]
    assert ints(10).skip(3).limit(4).collect(to_list()) == [4, 5, 6, 7]
    assert ints(10).limit(0).collect(to_list()) == []
    assert ints(10).skip(2).skip(3).collect(to_list()) == [6, 7, 8, 9, 10]


def test_map_filter_and_slices(ints):
    assert ints(5).map(lambda e: e.value * 2).skip(1).filter(lambda e: e.value > 4).limit(2).collect(to_array()) == [6, 8]
    kept = ints(5).filter(even).map(lambda e: e.value * 3)
    assert kept.collect(to_list()) == [6, 12]
    assert kept.collect(to_set()) == {6, 12}
    assert kept.collect(summing()) == 18
    assert ints(5).map(lambda e: (e.value, e.value)).limit(1).collect(to_list()) == [(1, 1)]
    assert ints(5).skip(1).limit(3).collect(summing()) == 9


def test_skip_keeps_rows_spread(ints, spark):
    plan = from_range(spark, 1000).skip(10).rows._jdf.queryExecution().toString()
    assert "Offset" not in plan  # no single partition for the rest


@pytest.mark.parametrize("what", ["skip", "limit"])
def test_negative_bounds(ints, what):
    with pytest.raises(ValueError, match=f"{what} count cannot be negative: -1"):
        getattr(ints(3), what)(-1)
    with pytest.raises(ValueError, match=f"{what} count cannot be negative: -2"):
        getattr(items(F.array()), what)(-2)


def test_find_first(spark, ints):
    assert ints(5).collect(find_first()) == Found(1)
    assert ints(5).skip(2).collect(find_first()) == Found(3)
    assert ints(5).filter(lambda e: e.value > 9).collect(find_first()) is None
    assert from_rows(spark, [None, "a"], "string").collect(find_first()) == Found(None)


def test_nulls_are_elements(spark):
    texts = from_rows(spark, [None, "keep", None, "discard"], "string")
    assert texts.filter(lambda e: e.value.isNull() | (e.value == "keep")).collect(to_list()) == [None, "keep", None]
    assert texts.filter(F.lit(True)).collect(to_list()) == [None, "keep", None, "discard"]
    assert texts.filter(F.lit(False)).collect(to_list()) == []
    assert texts.collect(to_set()) == {None, "keep", "discard"}


def test_empty_input(spark):
    empty = from_rows(spark, [], "int")
    assert empty.collect(to_array()) == []
    assert empty.collect(summing()) == 0
    assert empty.collect(summing(exact=True)) == 0
    assert empty.collect(find_first()) is None
    assert empty.collect(to_set()) == set()


def test_sources(spark, tmp_path):
    assert of(spark, "single").collect(to_array()) == ["single"]
    assert of(spark, None, "string").collect(to_array()) == [None]
    assert from_iterable(spark, (x for x in (3, 1, 2))).collect(to_list()) == [3, 1, 2]
    assert from_array(spark, ["1", "2", "x", "4"], "string").filter(lambda e: F.expr("try_cast(value as int)") % 2 == 0).collect(to_list()) == ["2", "4"]
    assert from_range(spark, 4).skip(1).collect(to_list()) == [1, 2, 3]
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    df.write.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in from_parquet(spark, str(tmp_path / "t"), ["k"]).collect(to_list())] == [(1, "a"), (2, "b")]


def test_unbounded_generator(spark):
    def naturals():
        k = 0
        while True:
            yield k
            k += 1

    source = from_generator(spark, naturals, "bigint")
    assert source.filter(lambda e: e.value % 3 == 0).skip(1).limit(3).collect(to_list()) == [3, 6, 9]
    assert source.limit(4).collect(summing()) == 6
    assert source.skip(5).collect(find_first()) == Found(5)
    with pytest.raises(ValueError, match="unbounded"):
        source.collect(to_list())


def test_flat_map_orders(spark, ints):
    pairs = ints(3).flat_map(lambda e: items(F.array(e.value, -e.value)))
    assert pairs.collect(to_list()) == [1, -1, 2, -2, 3, -3]
    sliced = ints(3).flat_map(lambda e: items(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: e.value * 10 + j)).skip(1).limit(2))
    assert sliced.collect(to_list()) == [11, 12, 21, 22, 31, 32]
    nested = ints(2).flat_map(lambda e: items(F.array(e.value, e.value + 10)).flat_map(lambda m: items(F.array(m, m * 2)).map(lambda x: x + e.value)))
    assert nested.collect(to_list()) == [2, 3, 12, 23, 4, 6, 14, 26]
    assert ints(3).limit(1).flat_map(lambda e: items(F.array(e.value, e.value + 10))).collect(summing()) == 12
    chained = ints(2).flat_map(lambda e: items(F.array(e.value, e.value + 10))).flat_map(lambda e: items(F.array(e.value, e.value * 2)).filter(lambda x: x != 2))
    assert chained.collect(to_list()) == [1, 11, 22, 2 + 2, 12, 24]


def test_generated_inner(spark):
    def doubling(s):
        k = 1
        while True:
            yield s * k
            k += 1

    texts = from_rows(spark, ["1", "2", "3"], "string")
    got = texts.flat_map(lambda e: generated(doubling, ["value"]).skip(1).limit(2)).limit(3)
    assert got.collect(to_list()) == ["11", "111", "22"]
    long = from_rows(spark, list("abcdef"), "string").flat_map(lambda e: generated(doubling, ["value"]).limit(4)).limit(20)
    assert long.collect(to_list())[-1] == "eeee"
    with pytest.raises(ValueError, match="limit"):
        texts.flat_map(lambda e: generated(doubling, ["value"]))


def test_related_inner(spark):
    outer = from_dataframe(spark.createDataFrame([(2,), (1,)], "k int"), ["k"])
    inner = spark.createDataFrame([(1, 5), (1, 4), (1, 6), (2, 9), (3, 1)], "ik int, x int")
    got = outer.flat_map(lambda e: related(inner, {"k": "ik"}, ["x"]).skip(1).limit(1).filter("x > 0").map(x=F.col("x") * 10))
    assert [r.x for r in got.dataframe().collect()] == [50]


STEPS = st.one_of(
    st.tuples(st.just("filter"), st.integers(2, 3)),
    st.tuples(st.just("map"), st.integers(-2, 3)),
    st.tuples(st.just("skip"), st.integers(0, 4)),
    st.tuples(st.just("limit"), st.integers(0, 9)),
    st.tuples(st.just("flat"), st.integers(0, 2)),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-9, 9), max_size=8), st.lists(STEPS, max_size=4))
def test_any_chain_is_a_list(spark, values, steps):
    got, want = from_rows(spark, values, "int"), list(values)
    for what, n in steps:
        if what == "filter":
            got, want = got.filter(lambda e, n=n: e.value % n == 0), [x for x in want if x % n == 0]
        elif what == "map":
            got, want = got.map(lambda e, n=n: e.value + n), [x + n for x in want]
        elif what == "flat":
            inner = lambda e, n=n: items(F.array(e.value, -e.value)).limit(n)
            got, want = got.flat_map(inner), [y for x in want for y in [x, -x][:n]]
        else:
            got, want = getattr(got, what)(n), want[n:] if what == "skip" else want[:n]
    assert got.collect(to_list()) == want
