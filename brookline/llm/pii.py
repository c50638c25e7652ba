"""Personal data by fixed patterns, and by contexts learned from what these find.

Mail addresses, IP addresses, card numbers and phone numbers that the fixed
patterns match are the seeds.  Lexical patterns are read off what stands around them, in
several forms (`forms`): the two words before, a label with its sign, the word before or
the beginning of the line together with the identifier's shape, the words on both sides.
All tokens that look like an identifier, and runs of neighbouring ones with digits
that blanks and brackets join, are instances; patterns and instances
form a graph with an edge for each pair that occurs together.  In every round a
pattern is scored, for each kind, by the share of its instances that are of that kind:
those of another kind, or that fail the kind's check, count in full against it, unknown ones
in part (`UNKNOWN`), and `PRIOR` are added.  It is trusted from ``TRUST`` on if ``SUPPORT``
different instances speak for it.  An instance is scored by its occurrences: the mean of the best
trusted pattern's score of each.  Instances trusted in one round count in the next; rounds
go on until none is added.  Tokens that stand behind a trusted pattern and are trusted
themselves are found too, although no fixed pattern matches them.  Where contexts say
nothing, as between random words, no pattern gets trusted, and nothing is added.

Scale: texts are read once and never shuffled; the work on one text grows with its length
(`chunks`).  What the rounds join are narrow rows for the few tokens with a digit or an at
sign, pre-aggregated: (value, its patterns, count), so a pattern or a value that a third of
all texts have is one edge.  Each round is cut from its lineage by a checkpoint.

Nulls, ties, repeats: a null text counts as empty.  Rows are told apart by a
number that is written with them, so null or repeated ids do no harm.  A pattern's
instances are counted once each, so repeated rows don't weigh more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns.  Against texts that would make them slow, matches are tried
#: at the beginning of a run only, or where the match before ended, and runs are
#: never given back; this matches the same stretches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"
#: Neighbouring tokens of digits, brackets and signs, joined by single blanks: spaced phones and cards.
RUN = r"(?<!\S)[+(]*+[0-9][0-9().+/-]*+(?:\x20[+(]*+[0-9][0-9().+/-]*+)++(?=[\s,;:!?\x22']|$)"
TRUST, SUPPORT, PRIOR, UNKNOWN = 0.8, 3, 2, 0.25
#: What looks like an identifier of a kind as a whole; if it isn't one by the check, it speaks against a pattern.
WHOLE = {"ip": r"^[0-9]+(\.[0-9]+){3}$", "card": r"^[0-9](?:[\x20-]?+[0-9])++$", "phone": r"^\+[0-9][\x20().0-9-]+[0-9]$"}
#: Code points in front of a token, and behind it, that its patterns are read from; those of a chunk.
BEFORE, BEHIND, CHUNK = 80, 32, 256
#: Stands for what a seed or a run covers; no character has this code.
MASK = "\uffff"


def running(sizes: Column, chunk: int = 256) -> Column:
    """The sums of ``sizes`` up to and with each element; chunk by chunk, as arrays are copied."""
    step = lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(acc, -1), F.lit(0)) + x)
    sums = lambda a: F.slice(F.aggregate(a, F.array(F.lit(0)), step), F.lit(2), F.size(a))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  worked out once, not in every call of a function of elements
    count = lambda z: F.ceil(F.size(z) / chunk).cast("int")
    cuts = lambda z: F.transform(F.sequence(F.lit(0), count(z) - 1), lambda k: F.slice(z, k * chunk + 1, F.lit(chunk)))
    starts = lambda c: F.aggregate(c, F.array(F.lit(0)), lambda acc, a: F.array_append(acc, F.element_at(acc, -1) + total(a)))
    joined = lambda c, s: F.flatten(F.zip_with(F.transform(c, sums), F.slice(s, F.lit(1), F.size(c)), lambda a, s0: F.transform(a, lambda x: x + s0)))
    many = lambda z: bind(cuts(z), lambda c: bind(starts(c), lambda s: joined(c, s)))
    return bind(sizes, lambda z: F.when(F.size(z) <= chunk, sums(z)).otherwise(many(z)))


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """``array<struct<start, end, value>>`` of all matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    spans = F.zip_with(running(sizes), found, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))
    some = F.size(found) > 0
    return F.when(text.contains(needs) & some if needs else some, spans).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str):
    """The check of a match of ``kind``, as a function of its struct."""
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")
    if kind == "ip":
        short = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(p, -3, 3).cast("int") <= 255)
        return lambda m: F.forall(F.split(m["value"], r"\."), short)
    if kind == "card":
        return lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "phone":
        return lambda m: F.length(digits(m)).between(8, 15)
    return lambda m: F.lit(True)


def chunks(text: Column) -> Column:
    """``text`` in pieces of `CHUNK` code points, so that a look into a long text doesn't count from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, start: Column, size: Column | int) -> Column:
    """``size`` code points, `CHUNK` at most, from the 0-based ``start`` on; ``start`` may lie before the text."""
    at = F.floor(start / CHUNK).cast("int")
    near = F.concat(*(F.coalesce(F.when(at + k >= 0, F.get(parts, at + k)), F.lit("")) for k in (0, 1)))
    first = F.greatest(start, F.lit(0)) - F.greatest(at, F.lit(0)) * CHUNK
    cut = F.greatest(F.lit(0), -start)  # what of the piece lies before the text
    return F.substring(near, (first + 1).cast("int"), F.greatest(F.lit(0), (size if isinstance(size, Column) else F.lit(size)) - cut).cast("int"))


def masked(text: Column, pattern: str, keep, found: Column) -> Column:
    """``text`` with `MASK` over the matches of ``pattern`` that ``keep`` holds for; as long as before."""
    gaps = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(keep(F.struct(m.alias("value"))), F.repeat(F.lit(MASK), F.length(m))).otherwise(m))
    last = F.element_at(gaps, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.concat(g, m)), ""), last)
    return F.when(F.size(found) > 0, joined).otherwise(text)


def with_forms(parts: Column, found: Column) -> Column:
    """``found``, structs with kind, start, end and value, with the lexical patterns around each: an array ``forms``.

    Words are lower-cased, digits count as 0.  Where the text begins before two words, ``^``
    stands for what is missing.  Opening signs of the identifier itself aren't part of it.
    """
    keep = lambda m: [m[c].alias(c) for c in ("kind", "start", "end", "value")]
    part = lambda c, pattern, group: F.regexp_extract(c, pattern, group)
    tidy = lambda c: F.lower(F.regexp_replace(c, r"\p{N}++", "0"))
    # Step by step, so that each is worked out once.
    around = lambda m: F.struct(
        *keep(m),
        F.concat(F.when(m["start"] <= BEFORE, F.lit("^ ")).otherwise(F.lit("")), F.regexp_replace(piece(parts, m["start"] - BEFORE, BEFORE), r"[(+]++$", "")).alias("before"),
        piece(parts, m["end"], BEHIND).alias("behind"),
    )
    words = lambda m: F.struct(
        *keep(m),
        tidy(part(m["before"], r"((?:\^|[\p{L}\p{N}]++)[^\p{L}\p{N}]++[\p{L}\p{N}]++[^\p{L}\p{N}]*+|\^\x20[^\p{L}\p{N}]*+)$", 1)).alias("two"),
        tidy(part(m["before"], r"([\p{L}\p{N}]++[^\p{L}\p{N}\n|]*+)$", 1)).alias("one"),
        tidy(part(m["before"], r"([\p{L}\p{N}]++\x20?[:=#]\x20?)$", 1)).alias("label"),
        part(m["before"], r"(?:^\^\x20|[\n|])\s*([^\p{L}\p{N}]*+)$", 0).alias("line"),
        tidy(part(m["behind"], r"^([^\p{L}\p{N}\n]*+[\p{L}]++)", 1)).alias("next"),
        F.regexp_replace(F.regexp_replace(m["value"], r"\p{L}++", "a"), r"\p{N}", "0").alias("shape"),
    )
    some = lambda name, ok, *c: F.when(ok, F.concat(F.lit(name), *c))
    named = lambda m: F.struct(
        *keep(m),
        F.array_compact(F.array(
            some("two ", m["two"] != "", m["two"]),
            some("label ", m["label"] != "", m["label"]),
            some("one ", m["one"] != "", m["one"], F.lit(" "), m["shape"]),
            some("line ", m["line"] != "", F.lit(" "), m["shape"]),
            some("both ", (m["one"] != "") & (m["next"] != ""), m["one"], F.lit(" _ "), m["next"]),
        )).alias("forms"),
    )
    return F.transform(F.transform(F.transform(found, around), words), named)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its seeds and its other tokens that look like identifiers.

    ``seeds`` and ``tokens`` are arrays of ``(kind, start, end, value, forms)``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_bl_r"), F.col(id_col).alias("_bl_id"), text.alias("_bl_t"))
    t = F.col("_bl_t")
    rows = rows.select("*", *(F.filter(matches(t, PATTERNS[k], NEEDS[k]), valid(k)).alias(f"_bl_{k}") for k in KINDS), t.alias("_bl_m"))
    # Tokens and runs are looked for in what seeds leave over, tokens in what runs leave over.
    for k in KINDS:
        rows = rows.withColumn("_bl_m", masked(F.col("_bl_m"), PATTERNS[k], valid(k), F.col(f"_bl_{k}")))
    lead = r"^[^\p{L}\p{N}+]*+"
    tail = r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]*+$"
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, lead, ""), tail, "")
    fits = lambda m: (F.length(bare(m["value"])) >= 5) & ~m["value"].contains(MASK)
    rows = rows.withColumn("_bl_runs", F.filter(matches(F.col("_bl_m"), RUN), fits))
    rows = rows.withColumn("_bl_m", masked(F.col("_bl_m"), RUN, fits, F.col("_bl_runs")))
    rows = rows.withColumn("_bl_tokens", F.filter(matches(F.col("_bl_m"), TOKEN), fits))
    some = sum((F.size(c) for c in ("_bl_runs", "_bl_tokens", *(f"_bl_{k}" for k in KINDS))), F.lit(0)) > 0
    rows = rows.withColumn("_bl_c", F.when(some, chunks(t)).otherwise(F.array().cast("array<string>")))
    parts = F.col("_bl_c")

    def plain(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))

    def trimmed(m: Column) -> Column:
        """Without quotes and punctuation around it."""
        a = m["start"] + F.length(F.regexp_extract(m["value"], lead, 0))
        b = m["end"] - F.length(F.regexp_extract(m["value"], tail, 0))
        return F.struct(F.lit(None).cast("string").alias("kind"), a.alias("start"), b.alias("end"), bare(m["value"]).alias("value"))

    def bracketed(m: Column) -> Column:
        """A run with the bracket that opens it, if it closes it too."""
        opened = m["value"].rlike(r"^[^(]*\)") & (piece(parts, m["start"] - 1, 1) == "(")
        value = F.concat(F.when(opened, F.lit("(")).otherwise(F.lit("")), m["value"])
        return F.struct(m["kind"].alias("kind"), (m["start"] - opened.cast("int")).alias("start"), m["end"].alias("end"), value.alias("value"))

    runs = F.transform(F.transform("_bl_runs", trimmed), bracketed)
    every = F.concat(*(F.transform(f"_bl_{k}", plain(k)) for k in KINDS), runs, F.transform("_bl_tokens", trimmed))
    rows = rows.select("_bl_r", "_bl_id", with_forms(parts, every).alias("_bl_x"))
    return rows.select("_bl_r", "_bl_id", F.filter("_bl_x", lambda m: m["kind"].isNotNull()).alias("seeds"), F.filter("_bl_x", lambda m: m["kind"].isNull()).alias("tokens"))


def learn(found: DataFrame, trust: float = TRUST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``(patterns, instances)``: trusted ``(form, kind)`` and ``(value, kind)`` of the graph.

    ``found`` is `extract`'s result.
    """
    one = lambda c: found.select(F.explode(c).alias("x")).select("x.kind", "x.value", "x.forms")
    seen = one("seeds").unionByName(one("tokens")).filter(F.size("forms") > 0)
    places = cut(seen.groupBy("value", "forms").agg(F.count("*").alias("w"), F.max("kind").alias("seed")).withColumn("place", F.xxhash64("value", "forms")))
    edges = cut(places.select("value", "seed", F.explode("forms").alias("form")).groupBy("value", "form").agg(F.max("seed").alias("seed")))
    fails = [F.count_if(F.col("seed").isNull() & F.col("value").rlike(WHOLE[k])) if k in WHOLE else F.lit(0) for k in KINDS]
    of_form = edges.groupBy("form").agg(F.count("*").alias("all"), *(c.alias(f"fails_{k}") for k, c in zip(KINDS, fails)))
    of_form = cut(of_form.filter(F.col("all") >= support))
    of_value = places.groupBy("value").agg(F.sum("w").alias("all"))
    fresh = places.filter("seed is null").select("value", "place", "w", F.explode("forms").alias("form"))
    instances = cut(places.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")).distinct())
    before = instances.count()
    while True:
        good = edges.select("value", "form").join(instances, "value").groupBy("form", "kind").agg(F.sum("trust").alias("good"), F.count("*").alias("support"))
        known = good.groupBy("form").agg(F.sum("support").alias("known"))
        against = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"fails_{k}")) for k in KINDS)) + F.col("known") - F.col("support")
        unknown = F.greatest(F.lit(0), F.col("all") - F.col("support") - against)
        score = F.col("good") / (F.col("support") + against + UNKNOWN * unknown + PRIOR)
        patterns = good.join(known, "form").join(of_form, "form").select("form", "kind", score.alias("score"), "support")
        patterns = cut(patterns.filter((F.col("score") >= trust) & (F.col("support") >= support)))
        best = fresh.join(patterns, "form").groupBy("value", "kind", "place", "w").agg(F.max("score").alias("score"))
        more = best.groupBy("value", "kind").agg(F.sum(F.col("w") * F.col("score")).alias("good")).join(of_value, "value")
        more = more.select("value", "kind", (F.col("good") / F.col("all")).alias("trust")).filter(F.col("trust") >= trust)
        instances = cut(instances.unionByName(more).groupBy("value", "kind").agg(F.max("trust").alias("trust")))
        now = instances.count()
        if now == before:
            return patterns, instances
        before = now


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """``(id, base, spans)`` of every whole text: arrays of ``(kind, start, end)``.

    ``base`` has what the fixed patterns match, ``spans`` that and what contexts
    add; both in the order of `KINDS`, then of their starts.
    """
    found = written(extract(docs, id_col, text_col), "pii")
    patterns, instances = learn(found, trust, support)
    tokens = found.select("_bl_r", F.posexplode("tokens").alias("n", "x")).select("_bl_r", "n", "x.start", "x.end", "x.value", F.explode("x.forms").alias("form"))
    # Of several kinds the one with the best pattern; of equals the first by name.
    more = tokens.join(patterns.select("form", "kind", "score"), "form").join(instances.select("value", "kind"), ["value", "kind"])
    more = more.groupBy("_bl_r", "n", "start", "end").agg(F.min(F.struct(-F.col("score"), "kind")).alias("k"))
    more = more.groupBy("_bl_r").agg(F.collect_list(F.struct("k.kind", "start", "end")).alias("more"))  # tokens of one text
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    ordered = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    base = F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = found.select("_bl_r", "_bl_id", base.alias("base")).join(more, "_bl_r", "left")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return rows.select(F.col("_bl_id").alias(id_col), ordered(F.col("base")).alias("base"), ordered(every).alias("spans"))


def said(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``; counts are of all spans."""
    rows = find(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(id_col, *map(count, KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
