"""Mixing sources to target weights by weighted fair queueing.

Documents of each source are put in a shuffled order.  A document's virtual
finish time is its source's cumulative size up to and with it, divided by the
source's target; a second pass over the source continues the count.  All
documents in the order of virtual finish time, cut at the total budget, are the
mix: every source then has nearly its target.

Inside a source the order is by a hash of the row, so the cut of the mix is one hash
for each source and pass: `mixed` needs these thresholds only, and never moves a text.

Scale: only narrow rows (source number, order key, size) are shuffled, never
texts.  Running sums go through three bucketed windows (`common.running_sum`), so
a source with a third of all rows, or all of them, spreads over many tasks.  The
summary has one row per source.  The driver receives one row: the order key of
the last document that the budget takes.

Nulls and repeats: a null text has size 0; a null source is a source of its own,
last in order; rows with a null or repeated id are rows like others, as the hash is
of id and text, and equal rows are told apart by their number.  Rows without words
are taken with their neighbours in the order.  An empty table gives no rows.  Sources
with no words get target 0, and are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_sum, small_side, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(_bl_src, _bl_s, _bl_total, _bl_target)`` for ``(_bl_src, _bl_size)`` rows.

    ``share`` of all sizes is dealt by weight; a target stops at ``epochs`` times
    its source's size and what is over goes to the others by weight.  With the
    sources in ascending order of cap / weight, those before the first one that
    the rest of the budget leaves below its cap are capped.
    """
    per = sizes.groupBy("_bl_src").agg(F.sum("_bl_size").alias("_bl_total"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_bl_src").asc_nulls_last())
    per = per.withColumn("_bl_s", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("_bl_s") % len(weights)).cast("int") + 1)
    cap = F.col("_bl_total") * epochs
    per = per.withColumn("_bl_w", pick).withColumn("_bl_cap", cap)
    every = Window.partitionBy(F.lit(0))
    level = every.orderBy((F.col("_bl_cap") / F.col("_bl_w")), "_bl_s")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("_bl_total").over(every) - F.coalesce(F.sum("_bl_cap").over(before), F.lit(0))
    weight = F.sum("_bl_w").over(every) - F.coalesce(F.sum("_bl_w").over(before), F.lit(0))
    per = per.withColumn("_bl_level", left / weight)
    # The first source that isn't capped fixes the level for all after it.
    free = F.col("_bl_w") * F.col("_bl_level") < F.col("_bl_cap")
    per = per.withColumn("_bl_open", F.when(free, F.col("_bl_level")))
    first = F.first("_bl_open", ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("_bl_open", first)
    target = F.when(F.col("_bl_open").isNull(), F.col("_bl_cap").cast("double")).otherwise(F.col("_bl_w") * F.col("_bl_open"))
    return per.select("_bl_src", "_bl_s", "_bl_total", target.alias("_bl_target"))


def row_hash(id_col: str, text_col: str, seed: str) -> Column:
    """The shuffled order's key: hexadecimal, of the id and the text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, passes, and ``_bl_h``, ``_bl_k``.

    ``passes`` is how often the mix takes the row: 0 to ``epochs`` times.  ``_bl_h`` is
    the row's hash, ``_bl_k`` its place in its source; they differ for the second and
    further ones of equal rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_bl_id"),
        F.col(source_col).alias("_bl_src"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_bl_size"),
        row_hash(id_col, text_col, seed).alias("_bl_h"),
    )
    # Equal rows are counted first, and then get an order key each: none is a hot key.
    base = cut(base.groupBy("_bl_src", "_bl_h").agg(F.first("_bl_id").alias("_bl_id"), F.first("_bl_size").alias("_bl_size"), F.count("*").alias("_bl_c")))
    sources = cut(source_targets(base.select("_bl_src", (F.col("_bl_size") * F.col("_bl_c")).alias("_bl_size")), weights, share, epochs))
    rows = base.join(sources, base["_bl_src"].eqNullSafe(sources["_bl_src"])).drop(sources["_bl_src"])
    rows = repeated(rows, "_bl_c", "_bl_i", base.agg(F.max("_bl_c")).first()[0])
    key = F.when(F.col("_bl_i") == 0, F.col("_bl_h")).otherwise(F.md5(F.concat_ws(":", "_bl_h", F.col("_bl_i").cast("string"))))
    rows = rows.withColumn("_bl_k", key)
    rows = rows.withColumn("_bl_b", F.conv(F.substring("_bl_k", 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("_bl_c", F.conv(F.substring("_bl_k", 4, 2), 16, 10).cast("int"))
    rows = running_sum(rows, ["_bl_s"], "_bl_b", "_bl_c", ["_bl_k"], "_bl_size", "_bl_cum")
    rows = cut(rows.select("_bl_id", "_bl_src", "_bl_s", "_bl_h", "_bl_k", "_bl_size", "_bl_total", "_bl_target", "_bl_cum"))
    budget = sources.agg(F.sum("_bl_target")).first()[0] or 0.0

    def finish(epoch) -> Column:
        return (F.col("_bl_cum") + F.col("_bl_total") * epoch).cast("double") / F.col("_bl_target")

    # Rows without words move no sum.
    passes = rows.filter("_bl_size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("_bl_e"))
    passes = passes.withColumn("_bl_v", finish(F.col("_bl_e")))
    passes = passes.withColumn("_bl_vb", F.floor(F.col("_bl_v") * 1024))
    passes = passes.withColumn("_bl_vc", F.floor(F.col("_bl_v") * (1 << 20)) % 1024)
    order = ["_bl_v", "_bl_s", "_bl_k", "_bl_e"]
    passes = running_sum(passes, [], "_bl_vb", "_bl_vc", order, "_bl_size", "_bl_all")
    last = passes.filter(F.col("_bl_all") <= F.lit(budget)).agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    if last is None:
        times = F.lit(0)
    else:
        cutoff = F.struct(*(F.lit(last[c]).cast(passes.schema[c].dataType).alias(c) for c in order))
        mine = lambda e: F.struct(finish(e).alias("_bl_v"), "_bl_s", "_bl_k", F.lit(e).alias("_bl_e"))
        times = sum((((F.col("_bl_target") > 0) & (mine(e) <= cutoff)).cast("int") for e in range(epochs)), F.lit(0))
    return rows.select(
        F.col("_bl_id").alias(id_col),
        F.col("_bl_src").alias("source"),
        F.col("_bl_size").alias("size"),
        F.col("_bl_total").alias("source_size"),
        F.col("_bl_target").alias("target"),
        times.alias("passes"),
        "_bl_h",
        "_bl_k",
    )


def repeated(rows: DataFrame, count: str, out: str, most: int | None, chunk: int = 1024) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 0 in ``out``; very many go to several tasks."""
    parts = rows.withColumn("_bl_j", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / chunk))))
    if (most or 0) > chunk:
        parts = parts.repartition(F.xxhash64(*rows.columns, "_bl_j"))
    last = F.least(F.col(count), (F.col("_bl_j") + 1) * chunk) - 1
    return parts.withColumn(out, F.explode(F.sequence(F.col("_bl_j") * chunk, last))).drop("_bl_j")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes from the row, repeats
    counted; ``options`` are those of `plan`.
    """
    rows = plan(docs, id_col, text_col, source_col, **options)
    return rows.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("passes")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", epochs: int = EPOCHS, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as they were.

    A row is taken in a pass up to the last hash that its source gets there: one row
    of thresholds for each source is joined, and texts stay where they are.  Rows
    equal in id, text and source are written from one of them, as often as all are taken.
    """
    rows = cut(plan(docs, id_col, text_col, source_col, seed=seed, epochs=epochs, **options).select("source", "passes", "_bl_h", "_bl_k"))
    ends = [F.max(F.when(F.col("passes") > e, F.col("_bl_k"))).alias(f"_bl_end{e}") for e in range(epochs)]
    ends = rows.groupBy(F.col("source").alias("_bl_src")).agg(*ends)
    many = rows.groupBy(F.col("source").alias("_bl_msrc"), F.col("_bl_h").alias("_bl_mh")).agg(F.count("*").alias("n"), F.sum("passes").alias("_bl_times"))
    many = written(many.filter("n > 1").select("_bl_msrc", "_bl_mh", "_bl_times"), "mix-repeated")
    hashed = docs.withColumn("_bl_h", row_hash(id_col, text_col, seed))
    one = F.col(source_col).eqNullSafe(F.col("_bl_msrc")) & (F.col("_bl_h") == F.col("_bl_mh"))
    often = not many.isEmpty()
    single = hashed.join(small_side(many), one, "left_anti") if often else hashed
    single = single.join(small_side(cut(ends)), F.col(source_col).eqNullSafe(F.col("_bl_src")))
    times = sum((F.coalesce(F.col("_bl_h") <= F.col(f"_bl_end{e}"), F.lit(False)).cast("int") for e in range(epochs)), F.lit(0))
    single = single.withColumn("_bl_times", times).filter("_bl_times > 0")
    single = single.withColumn("_bl_e", F.explode(F.sequence(F.lit(1), "_bl_times"))).select(*docs.columns)
    if not often:
        return single
    equal = hashed.join(small_side(many), one).groupBy("_bl_msrc", "_bl_mh", "_bl_times").agg(F.first(F.struct(*docs.columns)).alias("r"))
    most = many.agg(F.max("_bl_times")).first()[0]
    return single.unionByName(repeated(equal.filter("_bl_times > 0"), "_bl_times", "_bl_i", most).select("r.*"))
