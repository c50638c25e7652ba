"""SpotSigs fingerprints: chains of content words that follow common words.

A text's words are lower-cased runs of letters and digits.  Each run of common
words (of four languages) is an anchor; the anchor, and the next ``chain`` words
that aren't common, are one signature, kept as 32 bits of their hash.  The
fingerprint is the set of signatures.  Texts are alike as far as their sets
overlap (Jaccard).  A text without any signature has one, of all its words.

`near_pairs` finds all pairs of different fingerprints at a given likeness: sets
are partitioned by their length, so that only neighbouring partitions can hold
such pairs; a set is looked up by its rarest signatures only, as many as two sets
so alike cannot miss; and the sets' overlap is counted only for the pairs that
their lengths and the places of the shared signature leave possible.

Scale: all of it is DataFrame expressions.  `with_next` moves each text once: it
is dealt by a bucket of its id (`buckets`), and a window in the bucket looks at the following
row.  The first row of each bucket is also sent to the bucket before it; those
are found through a bitmap of fixed size.  Equal fingerprints are one class, so
copies meet only once.

Nulls and ties: a null text counts as empty.  Null ids come last in descending
order; rows with equal ids are in the order of their texts' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_bits, bitmap_filter, cut, in_bitmap, written
from .common_words import COMMON_WORDS

#: Words after the anchor that a signature takes.
CHAIN = 2
#: Rows of a bucket of ids, about, and parts that quantiles cut the ids to.
BUCKET, PARTS = 512, 256
STOP = sorted(set().union(*COMMON_WORDS.values()))


def spots(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with ``out``: the sorted signatures of column ``text``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # Common words are glued to the word that follows them, so that what lies
    # between two blanks is one content word behind its anchor.
    glued = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(*STOP), F.lit("_")).otherwise(F.lit(" ")))), "")
    df = df.withColumn("_bl_g", F.split(F.rtrim(glued), " "))
    # An anchor at the very end has nothing behind it.
    last = F.element_at("_bl_g", -1).endswith("_").cast("int")
    df = df.withColumn("_bl_g", F.slice("_bl_g", F.lit(1), F.size("_bl_g") - last))
    content = lambda k: F.substring_index(F.get("_bl_g", k), "_", -1)
    signature = lambda t, k: F.xxhash64(t, *(content(k + i) for i in range(1, chain))).bitwiseAND(0xFFFFFFFF)
    found = F.transform(
        "_bl_g",
        lambda t, k: F.when(t.contains("_") & (k + chain <= F.size("_bl_g")), signature(t, k)),
    )
    df = df.withColumn("_bl_f", F.array_sort(F.array_distinct(F.array_compact(found))))
    whole = F.array(F.xxhash64(F.lit("whole"), F.array_join("_bl_g", " ")).bitwiseAND(0xFFFFFFFF))
    return df.withColumn(out, F.when(F.size("_bl_f") > 0, F.col("_bl_f")).otherwise(whole)).drop("_bl_g", "_bl_f")


def likeness(a: str, b: str) -> Column:
    """The Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def said(column: str) -> Column:
    """A signature set as a string: its signatures in hexadecimal, ascending, joined by commas."""
    return F.array_join(F.transform(column, lambda x: F.lower(F.hex(x))), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """``(id, signatures array<long>)`` of every whole text."""
    rows = docs.select(F.col(id_col).alias("_bl_id"), F.col(text_col).alias("_bl_t"))
    return spots(rows, "_bl_t", "signatures", chain).select(F.col("_bl_id").alias(id_col), "signatures")


def buckets(ids: DataFrame, size: int, parts: int = PARTS) -> Column:
    """The bucket of a row with ``_bl_id`` and the text's hash ``_bl_h``, of about ``size`` rows, ascending.

    ``parts`` quantiles of the ids cut their range, and each part is cut to equal widths, so
    ids far from the others take no room from these.  An id that fills a part, and null,
    which is below all ids, are cut by the hash.  The driver sees the quantiles only.
    """
    at = [k / parts for k in range(parts + 1)]
    count, nulls, found = ids.agg(F.count("*"), F.count_if(F.col("_bl_id").isNull()), F.percentile_approx("_bl_id", at, 10_000)).first()
    spread = lambda rows: F.least(F.floor((F.col("_bl_h") / 2.0**64 + 0.5) * -(-rows // size)), F.lit(max(0, -(-rows // size) - 1)))
    lowest = F.lit(-(1 << 50)) + spread(nulls)
    if not found:
        return lowest
    ends = sorted(set(found))
    each = -(-(count - nulls) // parts)
    often = [found.count(e) for e in ends]
    bins = max(1, -(-each // size))
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_bl_id")))
    # The smallest id may be below the first quantile found.
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.greatest(part, F.lit(1)))
    steps = [bins / (float(b) - float(a)) for a, b in zip(ends, ends[1:])] + [0.0]
    wide = F.greatest(F.lit(0), F.least(F.floor((F.col("_bl_id").cast("double") - of([float(e) for e in ends])) * of(steps)), F.lit(bins - 1)))
    tops = [max(1, -(-each * n // size)) if n > 1 else 1 for n in often]
    narrow = F.least(F.floor((F.col("_bl_h") / 2.0**64 + 0.5) * of(tops)), of(tops) - 1)
    full = (F.col("_bl_id") == of(ends)) & (of(often) > 1)
    return F.when(F.col("_bl_id").isNull(), lowest).otherwise(part.cast("long") * (1 << 41) + F.when(full, narrow).otherwise(wide + (1 << 40)))


def with_next(docs: DataFrame, id_col: str, text_col: str, chain: int = CHAIN, bucket: int = BUCKET) -> DataFrame:
    """``(_bl_id, _bl_t, _bl_sig, _bl_t2, _bl_sig2)``: each row, and the next by descending id.

    After the last row comes the first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_bl_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_bl_t"))
    place = buckets(rows.select("_bl_id"), bucket)
    rows = rows.withColumn("_bl_h", F.xxhash64("_bl_t")).withColumn("_bl_b", place)
    heads = cut(rows.groupBy("_bl_b").agg(F.max(F.struct("_bl_id", "_bl_h")).alias("_bl_m")))
    # The bucket above each bucket, and for the topmost the lowest: by groups of
    # buckets, and by the groups' own ends.
    heads = heads.withColumn("_bl_hi", F.floor(F.col("_bl_b") / 4096))
    ends = heads.groupBy("_bl_hi").agg(F.min("_bl_b").alias("_bl_lowest"))
    over = Window.partitionBy(F.lit(0)).orderBy("_bl_hi")
    ends = ends.withColumn("_bl_above", F.lead("_bl_lowest").over(over))
    ends = ends.withColumn("_bl_first", F.min("_bl_lowest").over(Window.partitionBy(F.lit(0))))
    heads = heads.withColumn("_bl_up", F.lead("_bl_b").over(Window.partitionBy("_bl_hi").orderBy("_bl_b")))
    heads = heads.join(ends, "_bl_hi").select("_bl_m", F.coalesce("_bl_up", "_bl_above", "_bl_first").alias("_bl_to"))
    heads = cut(heads)
    key = F.struct("_bl_id", "_bl_h")
    bits = bitmap_bits(heads.count())
    guests = in_bitmap(rows, key, cut(bitmap_filter(heads, F.col("_bl_m"), bits)), "_bl_maybe", bits).filter("_bl_maybe")
    match = guests["_bl_id"].eqNullSafe(F.col("_bl_m._bl_id")) & (guests["_bl_h"] == F.col("_bl_m._bl_h"))
    # Of equal rows one is enough; partial aggregation leaves one of each task.
    guests = guests.join(heads, match).groupBy(F.col("_bl_to").alias("_bl_b"), "_bl_id", "_bl_h").agg(F.first("_bl_t").alias("_bl_t"))
    guests = guests.select("_bl_id", "_bl_t", "_bl_h", "_bl_b", F.lit(1).alias("_bl_guest"))
    every = rows.withColumn("_bl_guest", F.lit(0)).unionByName(guests).repartition("_bl_b")
    every = spots(every, "_bl_t", "_bl_sig", chain)
    order = Window.partitionBy("_bl_b").orderBy("_bl_guest", F.col("_bl_id").desc_nulls_last(), F.col("_bl_h").desc())
    every = every.withColumn("_bl_t2", F.lead("_bl_t").over(order)).withColumn("_bl_sig2", F.lead("_bl_sig").over(order))
    return every.filter("_bl_guest = 0").drop("_bl_b", "_bl_h", "_bl_guest")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Fingerprints of each text, of an edit of it, and how alike they are.

    The edit replaces the last third of the text by the beginning of the next one.
    """
    rows = with_next(docs, id_col, text_col, chain)
    n = F.length("_bl_t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_bl_t"), F.lit(1), n - third), F.substring(F.col("_bl_t2"), F.lit(1), third))
    rows = rows.select("_bl_id", n.cast("long").alias("n_chars"), "_bl_sig", "_bl_sig2", edited.alias("_bl_e"))
    rows = spots(rows, "_bl_e", "_bl_sig3", chain)
    return rows.select(
        F.col("_bl_id").alias(id_col),
        "n_chars",
        F.sha2("_bl_e", 256).alias("edited_sha256"),
        said("_bl_sig").alias("fingerprint"),
        said("_bl_sig3").alias("edited_fingerprint"),
        likeness("_bl_sig", "_bl_sig3").alias("near_edited"),
        likeness("_bl_sig", "_bl_sig2").alias("near_next"),
    )


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: classes of equal fingerprints, and all pairs of classes that are alike.

    ``members`` has ``(id, class_id)`` for every row; a class is named by the
    SHA-256 of its fingerprint.  ``pairs`` has ``(a, b, likeness)`` with a < b, once
    each, at a likeness of ``threshold`` or more.
    """
    prints = fingerprints(docs, id_col, text_col, chain)
    prints = written(prints.withColumn("class_id", F.sha2(said("signatures"), 256)), "spots")
    classes = prints.groupBy("class_id").agg(F.first("signatures").alias("signatures"))
    counts = classes.select(F.explode("signatures").alias("s")).groupBy("s").count()
    ranked = classes.select("class_id", F.explode("signatures").alias("s")).join(counts, "s")
    ranked = ranked.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("r"))
    n = F.size("r")
    need = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")  # so many of the rarest
    part = F.floor(F.log(n) / F.log(F.lit(1 / threshold)) + 1e-9)
    ranked = written(ranked.select("class_id", F.transform("r", lambda x: x["s"]).alias("s"), n.alias("n"), need.alias("p"), part.alias("part")), "ranked")
    look = ranked.select("class_id", "n", "part", F.posexplode(F.slice("s", 1, F.col("p"))).alias("at", "key"))
    left = look.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "key", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = look.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "key", "part")
    # The shorter set is on the left; what can still be shared is bounded by the places.
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    most = room + F.least("ia", "ib")
    possible = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (most >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    found = left.join(right, ["key", "part"]).filter(order & possible).select("a", "b").distinct()
    sets = ranked.select("class_id", "s")
    found = found.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("likeness", likeness("sa", "sb"))
    found = found.filter(F.col("likeness") >= threshold - 1e-12)
    return prints.select(id_col, "class_id"), found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
