"""SimHash near-duplicates: fingerprints and a self-join of binary tries.

A fingerprint bit is set if it is set in over half of the hashes of the text's
3-word shingles.  Fingerprints link at up to ``budget`` differing bits; the
operator returns components, so links are kept as a spanning forest.

The self-join: `budget + 1` blocks of bits are cut from the fingerprint; two that
differ in at most `budget` bits agree in one block whole.  Distinct fingerprints
are dealt out by (block, value of the block); in each such group they form a
binary trie in which chains are one edge.  The trie is joined with itself by
going through pairs of nodes: a pair's differing bits above both are counted, the
pair is dropped once they exceed the budget, and otherwise the node that branches
first is replaced by its children.  Pairs whose leaves are in one component
already are dropped too.  Budgets are tried from 1 up, so that a dense group of
near copies is one component before its many pairs at larger distances come up.
A group that more than `HOT` fingerprints are in is dealt out again by blocks of the
other bits, as two of them agree in one of these too.

Scale: rows in shuffles are a fingerprint and an id (16 bytes).  Equal texts and
equal fingerprints are one leaf, so thousands of copies weigh as one.  A task of
the self-join holds a bounded share of the fingerprints, as the number of tasks
follows their count.  Nothing is collected to the driver.

Nulls and short texts: a null text counts as empty.  Fewer words than a shingle
are one shingle; without words the fingerprint is zero, and links like any other.
Repeated rows get equal results; a component whose ids are all null has id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, small_side, tidy, without, written
from .components import components

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, BUDGET = 3, 3
#: Fingerprints that one task of the self-join gets, about; those of a group from which it is split again.
PER_TASK, HOT = 500_000, 200_000
#: Node pairs that are taken one level on at once.
PAIRS = 1 << 20


def shingle_hashes(text: Column, words: int = SHINGLE) -> tuple[Column, Column]:
    """The words of ``text``, and of a column ``_bl_w`` of words the XXH64 (seed 42) of each shingle."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    last = F.size("_bl_w") - words
    hashes = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.array_join(F.slice("_bl_w", i, words), " "))),
    ).when(F.size("_bl_w") > 0, F.array(F.xxhash64(F.array_join("_bl_w", " ")))).otherwise(F.array().cast("array<bigint>"))
    return found, hashes


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        rows = np.ascontiguousarray(hashes[k : k + (1 << 16)], "<i8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, tie: Column | None = None) -> DataFrame:
    """``(id, fingerprint long)`` of every whole text; with ``tie``, ``(_bl_id, text_hash, fingerprint)``."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)  # offsets and values are used where they are
            offsets, values = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
            found = [majority(values[p:q]) for p, q in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names)

    ship(docs.sparkSession)
    found, hashes = shingle_hashes(F.col("_bl_t"), words)
    more = [] if tie is None else [tie.alias("text_hash")]
    rows = docs.select(F.col(id_col).alias("_bl_id"), *more, F.col(text_col).alias("_bl_t"))
    first = rows.columns[:-1]
    rows = rows.select(*first, found.alias("_bl_w")).select(*first, hashes.alias("_bl_h"))
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "fingerprint"] if tie is None else [*first, "fingerprint"]
    return rows.mapInArrow(tidy(bits), f"`{names[0]}` {kind}, {'' if tie is None else 'text_hash long, '}fingerprint long")


class Tries:
    """Path-compressed binary tries over groups of distinct sorted 64-bit values.

    Node i covers leaves ``lo[i] .. hi[i] - 1``, which agree in their first
    ``depth[i]`` bits and branch at the next; leaves have depth 64.
    """

    def __init__(self, values: np.ndarray, firsts: np.ndarray):
        self.values = values
        lo, hi = firsts, np.append(firsts[1:], len(values))
        self.roots = np.arange(len(lo))
        los, his, depths, lefts, self.levels = [], [], [], [], []
        n = 0
        while len(lo):
            differ = values[lo] ^ values[hi - 1]
            for shift in (1, 2, 4, 8, 16, 32):
                differ |= differ >> np.uint64(shift)
            depth = 64 - np.bitwise_count(differ).astype(np.int64)
            inner = np.flatnonzero(depth < 64)
            left = np.full(len(lo), -1)
            left[inner] = n + len(lo) + 2 * np.arange(len(inner))
            los.append(lo)
            his.append(hi)
            depths.append(depth)
            lefts.append(left)
            self.levels.append((n, n + len(lo)))
            n += len(lo)
            # The first leaf with the branching bit, by bisection for all nodes at once.
            a, b, bit = lo[inner], hi[inner] - 1, np.uint64(63) - depth[inner].astype(np.uint64)
            while (open_ := b - a > 1).any():
                mid = (a + b) // 2
                one = (values[mid] >> bit & np.uint64(1)).astype(bool)
                b = np.where(open_ & one, mid, b)
                a = np.where(open_ & ~one, mid, a)
            lo, hi = np.stack([lo[inner], b], 1).ravel(), np.stack([b, hi[inner]], 1).ravel()
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.lo, self.hi, self.depth, self.left = map(cat, (los, his, depths, lefts))

    def spread(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and largest label of the leaves below each node."""
        low, high = np.zeros(len(self.lo), np.int64), np.zeros(len(self.lo), np.int64)
        for a, b in reversed(self.levels):
            left = self.left[a:b]
            leaf = left < 0
            own = label[self.lo[a:b]]
            low[a:b] = np.where(leaf, own, np.minimum(low[left], low[left + 1]))
            high[a:b] = np.where(leaf, own, np.maximum(high[left], high[left + 1]))
        return low, high

    def link(self, budget: int, pairs: int = PAIRS) -> np.ndarray:
        """A label for each leaf: the first leaf of its component at ``budget`` bits."""
        label = np.arange(len(self.values))
        for most in range(1, budget + 1):
            low, high = self.spread(label)
            stack = [(self.roots, self.roots)]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            while stack:
                a, b = stack.pop()
                if len(a) > pairs:
                    stack += [(a[pairs:], b[pairs:])]
                    a, b = a[:pairs], b[:pairs]
                a, b = self._prune(a, b, most, low, high)
                leaf = (self.left[a] < 0) & (self.left[b] < 0)
                if leaf.any():
                    found.append((self.lo[a[leaf]], self.lo[b[leaf]]))
                    held += int(leaf.sum())
                    a, b = a[~leaf], b[~leaf]
                if held > pairs or (not stack and not len(a) and held):
                    label = merged(label, *map(np.concatenate, zip(*found)))
                    low, high = self.spread(label)
                    found, held = [], 0
                if len(a):
                    stack.append(self._next(a, b))
        return label

    def _prune(self, a, b, most, low, high):
        one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~one], b[~one]
        depth = np.minimum(self.depth[a], self.depth[b])
        differ = self.values[self.lo[a]] ^ self.values[self.lo[b]]
        # Shifting by 64 is undefined, so the bits below are dropped in two steps.
        below = (64 - depth).astype(np.uint64)
        differ = differ >> (below // np.uint64(2)) >> (below - below // np.uint64(2))
        ok = np.bitwise_count(differ) <= most
        return a[ok], b[ok]

    def _next(self, a, b):
        same = a == b
        left = self.left[a[same]]
        first = ~same & (self.depth[a] <= self.depth[b])
        second = ~same & ~first
        la, lb = self.left[a[first]], self.left[b[second]]
        return (
            np.concatenate([left, left + 1, left, la, la + 1, a[second], a[second]]),
            np.concatenate([left, left + 1, left + 1, b[first], b[first], lb, lb + 1]),
        )


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after linking leaves ``a`` and ``b``; each label is its component's first leaf."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label = up


def links(values: DataFrame, column: str, budget: int = BUDGET, per_task: int = PER_TASK, hot: int = HOT) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct ``values`` at up to ``budget`` bits.

    A spanning forest of each group of each block: the components of all edges
    are those of all links.  A group of more than ``hot`` values is split again, by
    blocks of the bits that are left.
    """
    spark = values.sparkSession
    ship(spark)
    blocks = budget + 1
    masks = block_masks(range(64), blocks)
    value = F.col(column)
    rows = values.select(F.posexplode(F.array(*(value.bitwiseAND(F.lit(m)) for m in masks))).alias("block", "part"), value.alias("value"))
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(asked, -(-values.count() * blocks // per_task))
    large = cut(rows.groupBy("block", "part").count().filter(F.col("count") > hot).select("block", "part"))
    few = F.xxhash64("block", "part")
    if large.isEmpty():
        rows = rows.select(few.alias("group"), "value")
    else:
        again = {k: block_masks([b for b in range(64) if not bit(masks[k], b)], blocks) for k in range(blocks)}
        sub = lambda k: F.array(*(F.xxhash64("block", "part", F.lit(i), F.col("value").bitwiseAND(F.lit(m))) for i, m in enumerate(again[k])))
        split = F.coalesce(*(F.when(F.col("block") == k, sub(k)) for k in range(blocks)))
        rows = rows.join(small_side(large.withColumn("large", F.lit(True))), ["block", "part"], "left")
        rows = rows.select(F.explode(F.when(F.col("large"), split).otherwise(F.array(few))).alias("group"), "value")
    rows = rows.repartition(tasks, "group")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], []]
        for batch in batches:
            for k in range(2):
                columns[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        if not columns[0]:
            return
        group, own = map(np.concatenate, columns)
        own = own.astype(np.int64).view(np.uint64)
        order = np.lexsort((own, group))
        group, own = group[order], own[order]
        label = Tries(own, np.flatnonzero(np.append(True, group[1:] != group[:-1]))).link(budget)
        at = np.flatnonzero(label != np.arange(len(label)))
        signed = own.view(np.int64)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(signed[some]), pa.array(signed[label[some]])], ["a", "b"])

    return rows.mapInArrow(tidy(join), "a long, b long")


def bit(mask: int, b: int) -> bool:
    return bool(mask >> b & 1)


def block_masks(bits, blocks: int) -> list[int]:
    """``bits`` cut to blocks, each as a signed 64-bit mask."""
    bits = list(bits)
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[a:b_]) for a, b_ in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``(_bl_id, text_hash, fingerprint, root, component_id)`` for every row; ``root`` names the component."""
    rows = written(fingerprints(docs, id_col, text_col, words, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), "simhash")
    leaves = cut(rows.groupBy("fingerprint").agg(F.min("_bl_id").alias("_bl_min")))
    roots = components(links(leaves, "fingerprint", budget), "a", "b")
    leaves = leaves.join(roots, leaves["fingerprint"] == roots["node"], "left")
    leaves = cut(leaves.select("fingerprint", "_bl_min", F.coalesce("root", "fingerprint").alias("root")))
    ids = leaves.groupBy("root").agg(F.min("_bl_min").alias("component_id"))
    leaves = leaves.join(ids, "root").select("fingerprint", "root", "component_id")
    return rows.join(leaves, "fingerprint").select("_bl_id", "text_hash", "fingerprint", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``(id, fingerprint long, component_id)`` for every row: the smallest id that links reach."""
    return near_rows(docs, id_col, text_col, words, budget).select(F.col("_bl_id").alias(id_col), "fingerprint", "component_id")


def hex_fingerprint(column: str = "fingerprint") -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each component, columns as they were; see `keep_first`."""
    return keep_first(docs, near_rows(docs, id_col, text_col, words, budget), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of smallest id of each component, columns as they were.

    ``groups`` has ``(_bl_id, text_hash, root)`` for every row.  Null ids come last; of rows
    with equal ids the one with the smallest text hash stays, of rows equal in both any one.
    Rows are judged by id and text, so an id that also stands on a text of another
    component is judged there for itself.
    """
    rank = F.struct(F.col("_bl_id").isNull().alias("z"), F.col("_bl_id").alias("i"), F.col("text_hash").alias("h"))
    groups = written(groups.select("root", "_bl_id", "text_hash", rank.alias("rank")), "near")
    best = groups.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("count")).filter("count > 1").select("root", "best")
    best = cut(best)
    judged = groups.join(small_side(best), "root")
    gone = written(judged.filter("rank <> best").select(F.col("_bl_id").alias("_bl_gid"), F.col("text_hash").alias("_bl_gtie")).distinct(), "near-gone")
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = without(docs, gone, id_col, text)
    again = judged.filter("rank = best").groupBy("_bl_id", "text_hash").count().filter("count > 1")
    again = written(again.select(F.col("_bl_id").alias("_bl_gid"), F.col("text_hash").alias("_bl_gtie")), "near-again")
    if again.isEmpty():
        return kept
    same = F.col(id_col).eqNullSafe(F.col("_bl_gid")) & (text == F.col("_bl_gtie"))
    # Partial aggregation leaves one row of each task, so a row repeated very often is no hot key.
    one = kept.join(small_side(again), same).groupBy("_bl_gid", "_bl_gtie").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return without(kept, again, id_col, text).unionByName(one)
