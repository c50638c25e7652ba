"""Positions of rows over many partitions, and the folds that go by them."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from brookline.plans import order
from brookline.plans.order import positions
from brookline.plans.queries import QUERIES, SQL


@pytest.fixture
def unlike(spark):
    """Partitions are coalesced by a size that rows with values and rows without fill differently."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_positions_of_rows_with_values(spark, unlike):
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).alias("k"), F.rand(7).alias("v"))
    got = positions(df, ["k"], "at").agg(F.count("*"), F.count_if(F.col("at") == F.col("k")), F.max("v") < 1).first()
    assert tuple(got) == (60_000, 60_000, True)


def test_par_sum_exact_over_many_partitions(spark, duck, unlike, tmp_path):
    copies = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").crossJoin(spark.range(6).withColumnRenamed("id", "copy"))
    copies.withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * 15_000).drop("copy").write.parquet(f"{tmp_path}/orders.parquet")
    want = duck.sql(SQL["par_sum_exact"].replace("from orders", f"from '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in QUERIES["par_sum_exact"](spark, str(tmp_path)).collect()] == want == [(22550637720.36,)]


KEYS = [
    ("k int", [3, None, 1, 2, None, 3]),
    ("k double", [0.5, float("nan"), None, -1.0, float("inf"), 2.0]),
    ("k string", ["b", "", None, "é", "a'", "b"]),
    ("k binary", [b"\x00", b"\xff", None, b"", b"a", b"\x00"]),
    ("k boolean", [True, None, False, True, False, None]),
    ("k date", [datetime.date(2020, 1, d) if d else None for d in (3, 1, 0, 2, 9, 3)]),
    ("k timestamp", [datetime.datetime(2020, 1, d) if d else None for d in (3, 1, 0, 2, 9, 3)]),
    ("k decimal(20,2)", [decimal.Decimal(d) if d else None for d in (3, 1, 0, 2, 9, 3)]),
    ("k array<int>", [[1], None, [], [1, None], [0, 5], [1]]),
    ("k struct<a: int, b: string>", [(1, "x"), None, (None, "y"), (1, None), (0, "z"), (1, "x")]),
]


@pytest.mark.parametrize("schema,keys", KEYS, ids=[s for s, _ in KEYS])
def test_runs_by_keys_of_any_type(spark, monkeypatch, schema, keys):
    monkeypatch.setattr(order, "RUN", 1)
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], f"{schema}, n int")
    want = [r.n for r in df.orderBy("k", "n").collect()]
    for size in (None, 2, 100):  # the size decides only how many runs there are
        rows = positions(df, ["k", "n"], "at", size).collect()
        assert [r.n for r in sorted(rows, key=lambda r: r.at)] == want
        assert sorted(r.at for r in rows) == list(range(6))


def test_runs_are_many_and_of_like_size(spark):
    df = spark.range(100_000).select((F.col("id") * F.col("id")).alias("k"))
    sizes = [r["count"] for r in df.groupBy(order.run_of(df, ["k"], 100_000).alias("run")).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 40_000
    assert positions(df, ["k"], "at", 0).agg(F.max("at")).first()[0] == 99_999
