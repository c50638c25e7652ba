"""All texts that are alike by five-word shingles: SimHash links first, what they miss by sketches, exact Jaccard.

A text is the set of hashes of its shingles; texts with equal sets are one class.
Classes are linked where the exact Jaccard likeness of two sets is ``least`` or more;
the operator returns the components.  Candidates come from three places:

* The SimHash trie self-join (`simhash.links`) over the classes' fingerprints.  Its
  budget of bits finds nearly equal texts; pairs near 0.8 differ in some ten bits of
  64, and blocks of so wide a budget would each hold a fixed share of all texts.
* Sketches: the ``SKETCH`` smallest hashes of each set.  Hashes that ``LARGE`` or
  more sketches have are set aside; two classes that share enough of the others are
  compared.  Of the smallest hashes of the union of two sets at 0.8, each is in both
  with a chance of four in five, so a pair that shares too few of them is less likely
  than two equal 64-bit hashes.  Groups of a hash are smaller than ``LARGE`` here, so
  pairs grow with the input.
* Crowded classes, those whose sketch has a share of ``CROWDED`` or more of such
  common hashes: members of large groups of near copies, and texts that are mostly
  boilerplate.  Two sets at 0.8 share one of the first ``n - ceil(least * n) + 1`` of
  each in any one order; here rare hashes come first.  Classes connected by shared
  prefixes form clusters, clusters are cut to tiles of ``TILE`` hashes, and each pair of
  tiles is compared in one task, which hands on a spanning forest, never the pairs.

Scale: shuffled are sketches (``SKETCH`` numbers a class), and the whole sets of
candidates and crowded classes only.  Broadcast sides are counted first.

Nulls, short texts, repeats: as in `simhash`; texts without words are alike.  Null ids
are ignored when a component's smallest id is taken.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, ship, small_side, tidy, written
from .components import components

#: Words of a shingle, and the least likeness of texts that are near copies.
SHINGLE, LEAST = 5, 0.8
#: Hashes of a sketch; sketches that make a hash common; the share of those that makes a class crowded.
SKETCH, LARGE, CROWDED = 48, 16, 0.3
#: The share of their other sketched hashes that candidates have in common at least.
SHARED = 0.2
#: Hashes of all sets in a tile, about.
TILE = 1 << 20


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _hashes(docs: DataFrame, text_col: str, words: int, *columns: Column) -> DataFrame:
    found, hashes = simhash.shingle_hashes(F.col("_bl_t"), words)
    rows = docs.select(*columns, _text(text_col).alias("_bl_t")).withColumn("_bl_w", found)
    return rows.select(*(c for c in rows.columns if c not in ("_bl_t", "_bl_w")), hashes.alias("_bl_h"))


def named(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The set of the hashes, ascending, and its name."""
    own = np.unique(values)
    return own, int.from_bytes(hashlib.blake2b(own.astype("<i8").tobytes(), digest_size=8).digest(), "little", signed=True)


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(_bl_id, text_hash, class, n, fingerprint, keys)`` of every row."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            names, sizes, prints, keys = [], [], [], []
            for p, q in zip(offsets.tolist(), offsets[1:].tolist()):
                own, name = named(values[p:q])
                names.append(name)
                sizes.append(len(own))
                prints.append(simhash.majority(own))
                keys.append(own[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), listed(keys)],
                ["_bl_id", "text_hash", "class", "n", "fingerprint", "keys"],
            )

    ship(docs.sparkSession)
    rows = _hashes(docs, text_col, words, F.col(id_col).alias("_bl_id"), F.xxhash64(_text(text_col)).alias("text_hash"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(first), f"_bl_id {kind}, text_hash long, class long, n int, fingerprint long, keys array<long>")


def sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``(class, set)`` of every row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            found = [named(values[p:q]) for p, q in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in found], pa.int64()), listed([x for x, _ in found])], ["class", "set"])

    ship(docs.sparkSession)
    return _hashes(docs, text_col, words).mapInArrow(tidy(whole), "class long, set array<long>")


def trie_pairs(classes: DataFrame, budget: int) -> DataFrame:
    """Pairs ``(a, b)`` of classes that SimHash links; of equal fingerprints each with the first."""
    heads = cut(classes.groupBy("fingerprint").agg(F.min("class").alias("head")))
    edges = simhash.links(heads, "fingerprint", budget)
    far = edges.join(heads.toDF("a", "ha"), "a").join(heads.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    same = classes.select("class", "fingerprint").join(heads, "fingerprint").filter("class <> head")
    return far.unionByName(same.select(F.col("head").alias("a"), F.col("class").alias("b")))


def sketch_pairs(members: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of classes that share enough of the hashes that few sketches have."""
    rare = members.filter(F.col("count") < LARGE).select("key", "class", "n")
    pairs = rare.toDF("key", "a", "na").join(rare.toDF("key", "b", "nb"), "key").filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    few = info.select("class", "rare")
    pairs = pairs.join(few.toDF("a", "ra"), "a").join(few.toDF("b", "rb"), "b")
    return pairs.filter(F.col("c") >= SHARED * F.least("ra", "rb")).select("a", "b")


def alike(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` of classes whose whole sets are alike."""
    both = pairs.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= least * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def forest(owner: np.ndarray, values: np.ndarray, firsts: np.ndarray, side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Edges that connect all sets of a tile that are alike, as few as do.

    ``values`` has the sets one after the other, in one order; ``owner`` the number of the set
    of each; the first ``firsts[i]`` of set i are its prefix.  With ``side`` only sets of
    different sides are compared.
    """
    sizes = np.bincount(owner, minlength=len(firsts))
    start = np.cumsum(sizes) - sizes
    _, ids = np.unique(values, return_inverse=True)
    ahead = np.arange(len(ids)) - start[owner] < firsts[owner]
    order = np.argsort(ids[ahead], kind="stable")
    keys, posted = ids[ahead][order], owner[ahead][order]
    lows = np.searchsorted(keys, np.arange(len(ids) + 1))
    label, mark, edges = np.arange(len(firsts)), np.zeros(len(ids) + 1, bool), []
    for i in range(len(firsts)):
        own = ids[start[i] : start[i] + sizes[i]]
        found = np.unique(np.concatenate([posted[lows[k] : lows[k + 1]] for k in own[: firsts[i]].tolist()]))
        found = found[(found > i) & (label[found] != label[i])]
        found = found[np.minimum(sizes[found], sizes[i]) >= least * np.maximum(sizes[found], sizes[i]) - 1e-9]
        if side is not None:
            found = found[side[found] != side[i]]
        mark[own] = True
        for k in range(0, len(found), 512):
            some = found[k : k + 512]
            flat = np.repeat(start[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(int(sizes[some].sum()))
            shared = np.add.reduceat(mark[ids[flat]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[shared >= least * (sizes[some] + sizes[i] - shared) - 1e-9].tolist():
                if label[j] != label[i]:
                    edges.append((i, j))
                    label[label == label[j]] = label[i]
        mark[own] = False
    return edges


def crowded_links(whole: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that connect the classes of ``whole`` (``class``, ``set``) that are alike."""
    every = whole.select("class", F.size("set").alias("n"), F.explode("set").alias("s"))
    counts = every.groupBy("s").agg(F.count("*").alias("df"))
    ordered = every.join(counts, "s").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))  # one text's set
    first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    ordered = written(ordered.select("class", "n", first.alias("first"), F.transform("o", lambda x: x["s"]).alias("set")), "near-ordered")
    keys = ordered.select("class", F.explode(F.slice("set", F.lit(1), F.col("first"))).alias("key"))
    heads = cut(keys.groupBy("key").agg(F.min("class").alias("head"), F.max("class").alias("last")).filter("head < last").select("key", "head"))
    star = keys.join(small_side(heads), "key").filter("class <> head").select("class", "head").distinct()
    roots = components(star, "class", "head")
    near = ordered.join(small_side(cut(roots)), ordered["class"] == F.col("node")).drop("node")
    parts = cut(near.groupBy("root").agg(F.ceil(F.sum(F.col("n").cast("long")) / tile).cast("int").alias("parts")))
    near = near.join(small_side(parts), "root").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    near = near.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "class", "first", "set")
    near = near.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", F.size("set"), "class")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            part, name, first = (np.array([r[k] for r in held]) for k in (0, 1, 2))
            values = np.concatenate([r[3] for r in held])
            owner = np.repeat(np.arange(len(held)), [len(r[3]) for r in held])
            found = forest(owner, values, first, part if part.min() < part.max() else None, least)
            held.clear()
            a, b = (np.array([e[k] for e in found], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(name[a], pa.int64()), pa.array(name[b], pa.int64())], ["a", "b"])

        at, held = None, []
        for batch in batches:
            root, x, y, part, name, first = (batch.column(k).to_pylist() for k in range(6))
            rows = batch.column(6)
            offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            for i, now in enumerate(zip(root, x, y)):
                if now != at and held:
                    yield done()
                at = now
                held.append((part[i], name[i], first[i], values[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield done()

    ship(whole.sparkSession)
    return near.mapInArrow(tidy(compare), "a long, b long")


def links(rows: DataFrame, docs: DataFrame, text_col: str, words: int, least: float, budget: int) -> DataFrame:
    """Edges ``(a, b)`` of classes; their components are those of all pairs that are alike."""
    classes = rows.groupBy("class").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"))
    classes = written(classes, "near-classes")
    every = classes.select("class", "n", F.explode("keys").alias("key"))
    counts = cut(every.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1"))
    members = written(every.join(small_side(counts), "key"), "near-members")
    common = members.filter(F.col("count") >= LARGE).groupBy("class").agg(F.count("*").alias("common"))
    info = classes.select("class", "text_hash", F.size("keys").alias("k")).join(common, "class", "left")
    info = info.select("class", "text_hash", (F.col("k") - F.coalesce("common", F.lit(0))).alias("rare"), (F.coalesce("common", F.lit(0)) >= F.greatest(F.lit(1), CROWDED * F.col("k"))).alias("crowded"))
    info = cut(info)
    pairs = cut(trie_pairs(classes, budget).unionByName(sketch_pairs(members, info, least)).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(info.filter("crowded").select("class")).distinct()
    texts = cut(info.join(small_side(cut(asked)), "class").select("class", "text_hash", "crowded"))
    some = docs.join(small_side(texts.select("text_hash").distinct().withColumnRenamed("text_hash", "_bl_x")), F.xxhash64(_text(text_col)) == F.col("_bl_x"), "left_semi")
    whole = written(sets(some, text_col, words).groupBy("class").agg(F.first("set").alias("set")), "near-sets")
    dense = whole.join(small_side(texts.filter("crowded").select("class")), "class")
    return cut(alike(pairs, whole, least)).unionByName(cut(crowded_links(dense, least)))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = LEAST, budget: int = simhash.BUDGET) -> DataFrame:
    """``(_bl_id, text_hash, root, component_id)`` for every row: the smallest id that pairs at ``least`` or more reach."""
    rows = written(sketches(docs, id_col, text_col, words), "near-rows")
    roots = components(links(rows, docs, text_col, words, least, budget), "a", "b")
    leaves = cut(rows.groupBy("class").agg(F.min("_bl_id").alias("_bl_min")))
    leaves = leaves.join(roots, leaves["class"] == roots["node"], "left")
    leaves = cut(leaves.select("class", "_bl_min", F.coalesce("root", "class").alias("root")))
    ids = leaves.groupBy("root").agg(F.min("_bl_min").alias("component_id"))
    leaves = leaves.join(ids, "root").select("class", "root", "component_id")
    return rows.select("_bl_id", "text_hash", "class").join(leaves, "class").drop("class")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = LEAST, budget: int = simhash.BUDGET) -> DataFrame:
    """``docs`` with one row of each component, columns as they were; see `simhash.keep_first`."""
    return simhash.keep_first(docs, near_rows(docs, id_col, text_col, words, least, budget), id_col, text_col)
