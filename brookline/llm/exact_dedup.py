"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by a hash of a prefix, then by a hash of the
whole text; only rows of groups that survive a step take part in the next, and
the whole text is hashed only for rows of a surviving (length, prefix) group.

Scale: texts are never shuffled.  Each step counts narrow rows of numbers, map-side
first; lengths and groups that survive reach the scan of the texts as a bitmap of
bounded size, so no row is dealt out by its length.  A hot group of copies is pre-aggregated, and the join that tells its rows
of their group is a plain equi-join that adaptive execution may split.

Nulls and repeats: a null text counts as empty; a null id is smaller than any
other, and is kept only if all copies have null ids.  Rows repeated with the
same id are copies like others: ``exact_groups`` marks each row that has the kept
id, ``drop_exact_copies`` leaves one of them.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, bitmap_filter, cut, in_bitmap, small_side, without, written

#: Code points of the prefix that the second step hashes.
PREFIX = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest: str | None = None, tie: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept.

    Of equal texts the row with the largest id stays.  ``digest`` names a further
    column with the lowercase hex SHA-256 of every text (this needs the whole
    text of every row, so it is off by default); ``tie`` asks for ``_bl_tie``, a 64-bit
    hash of every text that tells rows with equal ids apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_bl_id"), text.alias("_bl_t"), F.octet_length(text).alias("_bl_n"))
    lengths = cut(rows.groupBy("_bl_n").count().filter("count > 1").select("_bl_n"))
    bits = bitmap_bits(lengths.count())
    rows = in_bitmap(rows, F.col("_bl_n"), cut(bitmap_filter(lengths, F.col("_bl_n"), bits)), "_bl_long", bits)
    rows = rows.withColumn("_bl_p", F.when(F.col("_bl_long"), F.xxhash64(F.substring("_bl_t", 1, prefix)))).drop("_bl_long")
    key = F.struct("_bl_n", "_bl_p")
    pairs = cut(rows.filter("_bl_p is not null").groupBy("_bl_n", "_bl_p").count().filter("count > 1").select("_bl_n", "_bl_p"))
    bits = bitmap_bits(pairs.count())
    alive = cut(bitmap_filter(pairs, key, bits))
    rows = in_bitmap(rows, key, alive, "_bl_alive", bits)
    full = F.sha2(F.col("_bl_t"), 256)
    rows = rows.select(
        "_bl_id",
        "_bl_n",
        F.xxhash64("_bl_p").alias("_bl_p"),
        F.when(F.col("_bl_alive"), full).alias("_bl_full"),
        *([full.alias("_bl_digest")] if digest else []),
        *([F.xxhash64("_bl_t").alias("_bl_tie")] if tie else []),
    )
    rows = written(rows, "exact")
    groups = (
        rows.filter("_bl_full is not null")
        .groupBy("_bl_n", "_bl_full")
        .agg(F.max("_bl_id").alias("_bl_keep"), F.count("*").alias("_bl_size"))
        .filter("_bl_size > 1")
        .select(F.col("_bl_full").alias("_bl_key"), "_bl_keep", "_bl_size")
    )
    # Rows that are surely unique get a key of their own, so that they spread.
    alone = F.concat_ws("-", F.lit(""), F.col("_bl_n").cast("string"), F.col("_bl_p").cast("string"))
    joined = rows.withColumn("_bl_key", F.coalesce("_bl_full", alone)).join(groups, "_bl_key", "left")
    single = F.col("_bl_size").isNull()
    keep = F.when(single, F.col("_bl_id")).otherwise(F.col("_bl_keep"))
    return joined.select(
        F.col("_bl_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_bl_size", F.lit(1)).alias("group_size"),
        F.col("_bl_id").eqNullSafe(keep).alias("kept"),
        *([F.col("_bl_digest").alias(digest)] if digest else []),
        *(["_bl_tie"] if tie else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each distinct text, and its columns as they were.

    Rows are judged by id and text, so an id that stands on rows with different texts
    is judged row by row; of several rows with the kept id and the same text one stays.
    """
    groups = written(exact_groups(docs, id_col, text_col, tie=True).filter("group_size > 1"), "groups")
    key = [F.col(id_col).alias("_bl_gid"), F.col("_bl_tie").alias("_bl_gtie")]
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plain = without(docs, written(groups.filter("not kept").select(*key).distinct(), "dropped"), id_col, tie)
    again = written(groups.filter("kept").groupBy(id_col, "_bl_tie").count().filter("count > 1").select(*key), "again")
    if again.isEmpty():
        return plain
    same = F.col(id_col).eqNullSafe(F.col("_bl_gid")) & (tie == F.col("_bl_gtie"))
    # Partial aggregation leaves one row of each task, so a row repeated very often is no hot key.
    one = docs.join(small_side(again), same).groupBy("_bl_gid", "_bl_gtie").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return without(plain, again, id_col, tie).unionByName(one)
