"""The registered queries over the shared tables, and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompileConfig, RuntimeConfig
from ..operators.collectors import Collector, ListOf, MinMax, ShortCircuitingCollector, StringJoin, TakeFirst, ToMap, find_first, summing, to_array, to_set
from ..functions import opaque
from ..operators.inner import generated, items, related, whole
from ..plans.order import positions
from ..plans.shipping import ship
from ..sources import from_array, from_dataframe, from_generator, from_iterable, from_range, of

#: Elements of the generated transactions (a fixed value of the benchmark).
TRANSACTIONS = 100_000
CATEGORIES = ["Electronics", "Groceries", "Fashion", "Books", "Home"]


def load(spark: SparkSession, sf_dir: str, name: str, order_by: list[str]):
    return from_dataframe(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order_by)


def orders(spark, d):
    return load(spark, d, "orders", ["o_orderkey"])


def nation(spark, d):
    return load(spark, d, "nation", ["n_nationkey"])


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lineitem(spark, d):
    return load(spark, d, "lineitem", LINE)


def transactions(spark: SparkSession, count: int = TRANSACTIONS):
    """Generated transactions with a user, an amount, a category and a status."""

    def columns(e):
        i = e.value
        return {
            "id": i,
            "userId": (i % 1000).cast("int"),
            "amount": ((i * 17) % 500).cast("double") + 0.99,
            "category": F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 5 + 1).cast("int")),
            "status": (i % 4).cast("int"),
        }

    return from_range(spark, count, columns)


#: The benchmark's queries: what is kept, and what is summed.
BENCHMARK = {
    "mono": (None, lambda t: t.amount),
    "q1": (lambda t: (t.status == 1) & (t.category == "Electronics"), lambda t: t.amount),
    "q2": (lambda t: (t.category == "Groceries") & (t.amount > 50), lambda t: t.amount * 0.05),
    "q3": (lambda t: (t.status == 2) & (t.userId < 200), lambda t: t.amount * 0.1),
    "q4": (lambda t: (t.category == "Fashion") & (t.amount >= 20) & (t.amount <= 200), lambda t: t.amount * 0.22),
    "q5": (lambda t: (t.status == 0) & (t.userId.bitwiseAND(1) == 0), lambda t: t.amount),
    "q6": (lambda t: (t.category == "Books") & (t.amount < 30), lambda t: t.amount + 2.5),
    "q7": (lambda t: (t.category == "Home") & (t.status == 1) & (t.amount > 150), lambda t: t.amount * 0.9),
    "q8": (lambda t: t.userId % 5 == 0, lambda t: t.amount * 1.05),
}
BENCHMARK_SQL = {
    "mono": ("true", "amount"),
    "q1": ("status = 1 and category = 'Electronics'", "amount"),
    "q2": ("category = 'Groceries' and amount > 50", "amount * 0.05::double"),
    "q3": ("status = 2 and userId < 200", "amount * 0.1::double"),
    "q4": ("category = 'Fashion' and amount between 20 and 200", "amount * 0.22::double"),
    "q5": ("status = 0 and userId & 1 = 0", "amount"),
    "q6": ("category = 'Books' and amount < 30", "amount + 2.5::double"),
    "q7": ("category = 'Home' and status = 1 and amount > 150", "amount * 0.9::double"),
    "q8": ("userId % 5 = 0", "amount * 1.05::double"),
}
TRANSACTIONS_SQL = f"""(select i id, (i % 1000)::int userId, ((i * 17) % 500)::double + 0.99::double amount,
  ({CATEGORIES})[(i % 5 + 1)::int] category, (i % 4)::int status from range({TRANSACTIONS}) t(i))"""


def benchmark(name: str):
    keep, value = BENCHMARK[name]

    def run(spark: SparkSession, sf_dir: str | None = None, count: int = TRANSACTIONS) -> DataFrame:
        source = transactions(spark, count).parallel()
        source = source.filter(keep) if keep else source
        return source.map(value).plan(summing()).select(F.round("value", 2).alias("total"))

    return run


def benchmark_at_once(spark: SparkSession, sf_dir: str | None = None, count: int = TRANSACTIONS) -> DataFrame:
    """All benchmark queries over one scan: a sum for each, of what it keeps."""
    t = transactions(spark, count)
    sums = []
    for name, (keep, value) in BENCHMARK.items():
        row = t._call(value)
        sums.append(F.round(F.coalesce(F.sum(F.when(t._call(keep), row) if keep else row), F.lit(0.0)), 2).alias(name))
    return t.rows.agg(*sums)


class TotalLength(Collector):
    """The total length of strings, as an ordered fold."""

    def supplier(self):
        return F.lit(0)

    def accumulator(self, buffer, element):
        return buffer + F.length(element)


def with_positions(p, name: str) -> DataFrame:
    """The elements of a sequence as ``(pos, name)`` rows."""
    return positions(p.rows, p._order, "__at").select(F.col("__at").cast("int").alias("pos"), F.col(p.names[0]).alias(name))


class UntilTotal(ShortCircuitingCollector):
    """How many elements it takes for their sum to pass ``total``, and that sum."""

    def __init__(self, total: float):
        self.total = total

    def supplier(self):
        return [0, 0.0]

    def accumulator(self, buffer, element):
        buffer[0] += 1
        buffer[1] += element
        return buffer[1] > self.total

    def finisher(self, buffer):
        return (buffer[0], round(buffer[1], 2))


def _short_circuit(s, d):
    found = orders(s, d).map(lambda e: e.o_totalprice).collect(UntilTotal(1_000_000.0))
    return s.createDataFrame([found], "taken int, total double")


def _related_nested(s, d):
    nations, suppliers = (s.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "supplier"))
    inner = related(nations, {"r_regionkey": "n_regionkey"}, ["n_nationkey"], keep=("r_name",))
    deep = inner.flat_map(lambda n: related(suppliers, {"n_nationkey": "s_nationkey"}, ["s_suppkey"], keep=("r_name", "n_name"))).skip(1).limit(4)
    return load(s, d, "region", ["r_regionkey"]).flat_map(lambda e: deep).rows.select("r_name", "n_name", "s_suppkey")


def _generated_steps(s, d):
    ship(s)
    steps = generated(_doubling, ["n_name"], keep=("n_nationkey",)).map(len, "int").filter(lambda n: n % 2 == 0).flat_map(lambda n: (n, -n)).limit(3)
    return nation(s, d).flat_map(lambda e: steps).rows.select("n_nationkey", "value")


def _pipeline_inside(s, d):
    inner = load(s, d, "region", ["r_regionkey"]).filter(lambda r: r.r_regionkey > 0).limit(2)
    return nation(s, d).flat_map(lambda e: whole(inner, keep=("n_nationkey",))).rows.select("n_nationkey", "r_name")


def _wrap_int(s, d):
    return from_range(s, 103, lambda e: F.lit(2147483647)).parallel().plan(summing()).withColumnRenamed("value", "total")


def _wrap_long(s, d):
    return orders(s, d).map(lambda e: e.o_orderkey * F.lit(0).cast("long") + F.lit(9223372036854775807)).plan(summing()).withColumnRenamed("value", "total")


def _relation_limit(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    inner = related(lines, {"o_orderkey": "l_orderkey"}, LINE[1:]).limit(2)
    kept = orders(s, d).filter(lambda e: e.o_totalprice > 1000)
    return kept.flat_map(lambda e: inner).rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


def _events_first(s, d):
    e = load(s, d, "events", ["event_id"])
    return e.filter(lambda x: x.event_type == "purchase").map(lambda x: {"event_id": x.event_id, "event_type": x.event_type}).plan(find_first())


def _doubling(text):
    """``text`` once, twice, and so on, without end."""
    k = 1
    while True:
        yield text * k
        k += 1


def _naturals():
    k = 0
    while True:
        yield k
        k += 1


def _opaque(s, d):
    reverse = opaque(lambda name: name[::-1], "string")
    return nation(s, d).map(lambda e: {"n_nationkey": e.n_nationkey, "reversed": reverse(e.n_name)}).rows.select("n_nationkey", "reversed")


def _generated(s, d):
    ship(s)
    return nation(s, d).flat_map(lambda e: generated(_doubling, ["n_name"], keep=("n_nationkey",)).skip(1).limit(3)).rows.select("n_nationkey", "value")


QUERIES = {
    "generator": lambda s, d: from_generator(s, _naturals, "bigint").filter(lambda e: e.value % 3 == 0).skip(2).limit(5).rows.select("value"),
    "flatmap_generated": _generated,
    "udf": _opaque,
    "filter": lambda s, d: orders(s, d).filter(lambda e: (e.o_orderstatus == "F") & (e.o_totalprice > 1000)).map(lambda e: {"o_orderkey": e.o_orderkey}).rows.select("o_orderkey"),
    "filter_filter": lambda s, d: orders(s, d).filter(lambda e: e.o_orderkey > 100).filter(lambda e: e.o_orderkey % 2 == 0).map(lambda e: {"o_orderkey": e.o_orderkey}).rows.select("o_orderkey"),
    "map_chain": lambda s, d: orders(s, d).map(lambda e: {"x": e.o_orderkey * 2}).map(lambda e: {"y": e.x + e.x}).rows.select("y"),
    "skip": lambda s, d: orders(s, d).map(lambda e: {"o_orderkey": e.o_orderkey}).skip(100).rows.select("o_orderkey"),
    "limit": lambda s, d: orders(s, d).map(lambda e: {"o_orderkey": e.o_orderkey}).limit(37).dataframe(),
    "skip_limit": lambda s, d: orders(s, d).map(lambda e: {"o_orderkey": e.o_orderkey}).skip(50).limit(20).dataframe(),
    "limit0": lambda s, d: orders(s, d).map(lambda e: {"o_orderkey": e.o_orderkey}).limit(0).dataframe(),
    "slice_chain": lambda s, d: orders(s, d).map(lambda e: {"o_orderkey": e.o_orderkey}).skip(1).filter(lambda e: e.o_orderkey % 2 == 0).limit(20).skip(1).dataframe(),
    "flatmap": lambda s, d: load(s, d, "part", ["p_partkey"]).flat_map(lambda e: items(F.array(e.p_size, -e.p_size), keep=("p_partkey",))).rows.select("p_partkey", F.col("__ord1").alias("pos"), "value"),
    "flatmap_inner_slice": lambda s, d: load(s, d, "part", ["p_partkey"]).flat_map(
        lambda e: items(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: e.p_size * 10 + j), keep=("p_partkey",)).skip(1).limit(2)
    ).rows.select("p_partkey", "value"),
    "flatmap_nested": lambda s, d: nation(s, d).flat_map(
        lambda e: items(F.array(e.n_nationkey, e.n_nationkey + 10), keep=("n_nationkey",)).flat_map(lambda m: items(F.array(m, m * 2)).map(lambda x: x + e.n_nationkey))
    ).rows.select("n_nationkey", F.col("__ord1").alias("pos"), "value"),
    "flatmap_repeater": lambda s, d: nation(s, d).flat_map(
        lambda e: items(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.repeat(e.n_name, k)))
    ).limit(20).rows.select("value"),
    "flatmap_outer_limit": lambda s, d: nation(s, d).flat_map(lambda e: items(F.array(e.n_nationkey, e.n_nationkey + 10), keep=("n_nationkey",))).limit(7).dataframe(),
    "limit_before_flatmap": lambda s, d: nation(s, d).limit(3).flat_map(lambda e: items(F.array(e.n_nationkey, e.n_nationkey + 10))).plan(summing()).withColumnRenamed("value", "total"),
    "flatmap_relation_inner_limit": _relation_limit,
    "of": lambda s, d: of(s, "single").dataframe(),
    "to_array": lambda s, d: orders(s, d).parallel().filter(lambda e: e.o_totalprice > 1000).map(lambda e: {"o_orderkey": e.o_orderkey, "price": e.o_totalprice}).plan(to_array()),
    "to_list": lambda s, d: with_positions(nation(s, d).map(lambda e: {"n_name": e.n_name}), "n_name"),
    "to_set": lambda s, d: lineitem(s, d).map(lambda e: {"l_returnflag": e.l_returnflag}).plan(to_set()),
    "find_first": lambda s, d: orders(s, d).filter(lambda e: e.o_totalprice > 50000).map(lambda e: {"o_orderkey": e.o_orderkey}).plan(find_first()),
    "find_first_event": _events_first,
    "find_first_none": lambda s, d: orders(s, d).filter(lambda e: e.o_totalprice < 0).map(lambda e: {"o_orderkey": e.o_orderkey}).plan(find_first()),
    "take_two": lambda s, d: orders(s, d).filter(lambda e: e.o_orderstatus == "O").map(lambda e: {"o_orderkey": e.o_orderkey}).plan(TakeFirst(2)),
    "sum_int_wrap": _wrap_int,
    "sum_long_wrap": _wrap_long,
    "sum_empty": lambda s, d: orders(s, d).filter(lambda e: e.o_orderkey < 0).map(lambda e: e.o_orderkey).plan(summing()).withColumnRenamed("value", "total"),
    "sum_float": lambda s, d: orders(s, d).map(lambda e: (e.o_orderkey % 64).cast("float") / F.lit(2.0).cast("float")).map(lambda e: e.value.cast("float")).plan(summing()).withColumnRenamed("value", "total"),
    "sum_double": lambda s, d: lineitem(s, d).map(lambda e: e.l_extendedprice).plan(summing()).select(F.round("value", 2).alias("total")),
    "min_max": lambda s, d: orders(s, d).map(lambda e: {"o_totalprice": e.o_totalprice}).plan(MinMax()).toDF("lowest", "highest"),
    "to_map": lambda s, d: nation(s, d).map(lambda e: {"n_nationkey": e.n_nationkey, "n_name": e.n_name}).plan(ToMap()),
    "collector": lambda s, d: load(s, d, "region", ["r_regionkey"]).map(lambda e: e.r_name).plan(TotalLength()).withColumnRenamed("value", "total"),
    "collector_join": lambda s, d: load(s, d, "region", ["r_regionkey"]).map(lambda e: e.r_name).plan(StringJoin("|"), runtime_config=RuntimeConfig(1, 1)).withColumnRenamed("value", "joined"),
    "par_collector": lambda s, d: nation(s, d).parallel().map(lambda e: e.n_name).plan(StringJoin("|"), runtime_config=RuntimeConfig(3, 2)).withColumnRenamed("value", "joined"),
    "par_sum": lambda s, d: lineitem(s, d).parallel().filter(lambda e: e.l_quantity < 24).map(lambda e: e.l_extendedprice * e.l_discount).plan(summing()).select(F.round("value", 2).alias("revenue")),
    "par_sum_exact": lambda s, d: orders(s, d).parallel().map(lambda e: e.o_totalprice).plan(summing(exact=True), runtime_config=RuntimeConfig(8, 8)).select(F.round("value", 2).alias("total")),
    "flatmap_related_nested": _related_nested,
    "flatmap_generated_steps": _generated_steps,
    "flatmap_pipeline": _pipeline_inside,
    "short_circuit": _short_circuit,
    "par_list": lambda s, d: nation(s, d).parallel().map(lambda e: e.n_name).plan(ListOf("string"), runtime_config=RuntimeConfig(3, 2)).select(F.array_join("value", "|").alias("joined"), F.size("value").alias("n")),
    "from_array": lambda s, d: from_array(s, [3, 1, 2]).parallel().map(lambda e: e.value * 2).plan(summing()).withColumnRenamed("value", "total"),
    "from_iterable": lambda s, d: with_positions(from_iterable(s, (k * k for k in range(20))).skip(2).limit(5).filter(lambda e: e.value > 4), "value"),
    "from_list": lambda s, d: from_iterable(s, ["c", None, "a"], "string").map(lambda e: F.coalesce(e.value, F.lit("?"))).plan(StringJoin()).withColumnRenamed("value", "joined"),
    "skip_ties": lambda s, d: from_dataframe(s.read.parquet(f"{d}/lineitem.parquet").select("l_shipdate", "l_returnflag"), ["l_shipdate"], unique=False).skip(1000).rows.groupBy("l_shipdate").agg(F.count("*").alias("n")),
    "config": lambda s, d: nation(s, d).parallel().map(lambda e: e.n_nationkey).plan(summing(), CompileConfig(use_unsafe=False, strict_inlining=True), RuntimeConfig(2, 3)).withColumnRenamed("value", "total"),
    "mega_at_once": benchmark_at_once,
    **{name: benchmark(name) for name in BENCHMARK},
}

SQL = {
    "generator": "select i as value from range(100) t(i) where i % 3 = 0 order by 1 limit 5 offset 2",
    "flatmap_generated": "select n_nationkey, repeat(n_name, k::int) as value from nation, range(2, 5) u(k)",
    "udf": "select n_nationkey, reverse(n_name) as reversed from nation",
    "filter": "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 1000",
    "filter_filter": "select o_orderkey from orders where o_orderkey > 100 and o_orderkey % 2 = 0",
    "map_chain": "select o_orderkey * 2 + o_orderkey * 2 as y from orders",
    "skip": "select o_orderkey from orders order by 1 offset 100",
    "limit": "select o_orderkey from orders order by 1 limit 37",
    "skip_limit": "select o_orderkey from orders order by 1 limit 20 offset 50",
    "limit0": "select o_orderkey from orders limit 0",
    "slice_chain": """select o_orderkey from (select o_orderkey from (select o_orderkey from orders order by 1 offset 1)
      where o_orderkey % 2 = 0 order by 1 limit 20) order by 1 offset 1""",
    "flatmap": "select p_partkey, (i - 1)::int as pos, ([p_size, -p_size])[i] as value from part, range(1, 3) u(i)",
    "flatmap_inner_slice": "select p_partkey, (p_size * 10 + i)::int as value from part, range(1, 3) u(i)",
    "flatmap_nested": """select n_nationkey, ((i - 1) * 2 + j - 1)::int as pos,
      (case when j = 1 then m else m * 2 end + n_nationkey)::int as value
      from (select n_nationkey, i, j, n_nationkey + (i - 1) * 10 as m from nation, range(1, 3) a(i), range(1, 3) b(j))""",
    "flatmap_repeater": "select repeat(n_name, k::int) as value from nation, range(1, 5) u(k) order by n_nationkey, k limit 20",
    "flatmap_outer_limit": "select n_nationkey, (n_nationkey + (i - 1) * 10)::int as value from nation, range(1, 3) u(i) order by n_nationkey, i limit 7",
    "limit_before_flatmap": """select coalesce(sum(n_nationkey + (i - 1) * 10), 0)::int as total
      from (select n_nationkey from nation order by 1 limit 3), range(1, 3) u(i)""",
    "flatmap_relation_inner_limit": f"""select l.l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from orders o join
      (select *, row_number() over (partition by l_orderkey order by {', '.join(LINE[1:])}) rn from lineitem) l
      on o.o_orderkey = l.l_orderkey where o_totalprice > 1000 and rn <= 2""",
    "of": "select 'single' as value",
    "to_array": "select o_orderkey, o_totalprice as price from orders where o_totalprice > 1000",
    "to_list": "select (row_number() over (order by n_nationkey) - 1)::int as pos, n_name from nation",
    "to_set": "select distinct l_returnflag from lineitem",
    "find_first": "select o_orderkey from orders where o_totalprice > 50000 order by 1 limit 1",
    "find_first_event": "select event_id, event_type from events where event_type = 'purchase' order by event_id limit 1",
    "find_first_none": "select o_orderkey from orders where o_totalprice < 0 limit 1",
    "take_two": "select o_orderkey from orders where o_orderstatus = 'O' order by 1 limit 2",
    "sum_int_wrap": "select (((sum(2147483647)::hugeint + 2147483648) % 4294967296) - 2147483648)::int as total from range(103)",
    "sum_long_wrap": """select ((((s + 9223372036854775808::hugeint) % w) + w) % w - 9223372036854775808::hugeint)::bigint as total
      from (select count(*)::hugeint * 9223372036854775807::hugeint s, 18446744073709551616::hugeint w from orders)""",
    "sum_empty": "select coalesce(sum(o_orderkey), 0)::bigint as total from orders where o_orderkey < 0",
    "sum_float": "select coalesce(sum((o_orderkey % 64) / 2.0::double), 0)::float as total from orders",
    "sum_double": "select round(coalesce(sum(l_extendedprice), 0), 2) as total from lineitem",
    "min_max": "select min(o_totalprice) as lowest, max(o_totalprice) as highest from orders",
    "to_map": "select n_nationkey, n_name from nation",
    "collector": "select coalesce(sum(length(r_name)), 0)::int as total from region",
    "collector_join": "select coalesce(string_agg(r_name, '|' order by r_regionkey), '') as joined from region",
    "par_collector": "select coalesce(string_agg(n_name, '|' order by n_nationkey), '') as joined from nation",
    "par_sum": "select round(coalesce(sum(l_extendedprice * l_discount), 0), 2) as revenue from lineitem where l_quantity < 24",
    "par_sum_exact": "select round(sum(o_totalprice), 2) as total from orders",
    "flatmap_related_nested": """select r_name, n_name, s_suppkey from (
      select r_name, n_name, s_suppkey, row_number() over (partition by r_regionkey order by n_nationkey, s_suppkey) k
      from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey) where k between 2 and 5""",
    "flatmap_generated_steps": """select n_nationkey, value::int as value from (
      select n_nationkey, v * sign as value, row_number() over (partition by n_nationkey order by v, sign desc) k
      from (select n_nationkey, length(n_name) * i as v from nation, range(1, 9) t(i)) x, (select unnest([1, -1]) sign) u where v % 2 = 0) where k <= 3""",
    "flatmap_pipeline": "select n_nationkey, r_name from nation, (select r_name from region where r_regionkey > 0 order by r_regionkey limit 2)",
    "short_circuit": """select min(k)::int as taken, round(min(upto), 2) as total from (
      select row_number() over (order by o_orderkey) k, sum(o_totalprice) over (order by o_orderkey rows unbounded preceding) upto from orders) where upto > 1000000""",
    "par_list": "select string_agg(n_name, '|' order by n_nationkey) as joined, count(*)::int as n from nation",
    "from_array": "select 12 as total",
    "from_iterable": "select (i - 3)::int as pos, (i * i)::int as value from range(3, 7) t(i)",
    "from_list": "select 'c?a' as joined",
    "skip_ties": """select l_shipdate, count(*) as n from (select l_shipdate, row_number() over (order by l_shipdate) k from lineitem) where k > 1000 group by 1""",
    "config": "select sum(n_nationkey)::int as total from nation",
    "mega_at_once": f"select {', '.join(f'round(coalesce(sum({v}) filter (where {w}), 0), 2) as {n}' for n, (w, v) in BENCHMARK_SQL.items())} from {TRANSACTIONS_SQL}",
    **{n: f"select round(coalesce(sum({v}), 0.0::double), 2) as total from {TRANSACTIONS_SQL} where {w}" for n, (w, v) in BENCHMARK_SQL.items()},
}
