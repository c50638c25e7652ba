"""Every registered query with SQL, against DuckDB; the benchmark's sums against their known values."""

import pytest

from brookline.plans.queries import BENCHMARK, QUERIES, SQL, benchmark


def rows(values):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(tidy, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall()
    assert rows(df.select(columns).collect()) == rows(expected)


KNOWN = {
    10: [774.9, 85.99, 5.1495, 13.798, 34.0956, 206.97, 0.0, 138.591, 91.329],
    100: [23249.0, 1329.95, 218.892, 577.475, 162.7824, 5924.75, 0.0, 1040.364, 4378.29],
    1000: [250490.0, 12299.5, 2479.41, 1204.95, 1781.8416, 62247.5, 203.88, 10497.276, 52182.9],
    100000: [25049000.0, 1229950.0, 247941.0, 120495.0, 178184.16, 6224750.0, 20388.0, 1049727.6, 5218290.0],
}


@pytest.mark.parametrize("count", KNOWN)
def test_benchmark_values(spark, count):
    found = [benchmark(name)(spark, None, count).first()[0] for name in BENCHMARK]
    assert found == pytest.approx(KNOWN[count], abs=0.0051)
