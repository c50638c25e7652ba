"""Secrets in texts: candidates by a wide pattern, false positives removed by a random forest.

Every run of 16 or more characters of keys and codes, with a digit or of mixed
case, is a candidate; it ends at an assignment sign.  So is what is assigned to a
name with a cue word, of any length and punctuation; quoted values may have blanks; and so
is the password in a URL.
A candidate's features are its length, its changes between classes
of characters, how much of it is dictionary words, how it lies in a path, and the
words beside it.  A random forest (Spark ML, inside the JVM) that was trained on
labelled findings of the same features gives the probability of a secret.

Labelled findings are a parameter.  The default is a set that is written out by
rule: credentials of public formats in the places where they leak, and the
checksums, ids, paths and names that look like them.

Scale: texts are scanned once and not shuffled; training sees the labelled
findings only.

Nulls, ties, repeats: a null text has no candidates; a null path counts as empty.
Repeated rows have equal findings each.  Rows with a null label train nothing;
without both labels every candidate is kept, with score null.
"""

from __future__ import annotations

import random
import string

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common_words import COMMON_WORDS
from .pii import chunks, matches, piece

CANDIDATE = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]*+=*+(?<=[A-Za-z0-9+/=_.-]{16}))(?=\S*[0-9A-Z])[A-Za-z0-9+/_.-]++(?:=++(?![^\s\"'`,;)\]}]))?+"
CUES = "secret token password passwd pwd key apikey auth credential credentials private bearer access passphrase login signature".split()
#: A cue word and an assignment sign, and the value behind them.
ASSIGNS = r"(?i)(?:" + "|".join(CUES) + r")[a-z0-9_.-]{0,40}+[\"'`]?\s{0,3}[=:]++>?\s{0,3}"
ASSIGNED = ASSIGNS + r"(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|`[^`\n]++(?=`)|[\"'`]?[^\s\"'`]*[^\s\"'`.,;)\]}])"
#: The user and password of a URL.
IN_URL = r"(?<=://)[^\s/:@]{1,64}+:[^\s/@]++(?=@)"
OTHER = "commit sha sha1 sha256 md5 checksum digest hash uuid guid id revision version file path class image cache etag build object tree".split()
NAMES = "user name config default example test data server client value index module service manager handler controller factory string number object list base main src lib bin usr home var www com org net http https html json yaml docs assets static images style version build release internal application component".split()
#: Code points before and behind a candidate that its neighbouring words are taken from.
NEAR = 48
FEATURES = ["length", "to_digit", "to_letter", "to_upper", "digits", "uppers", "distinct", "words", "slashes", "dots", "dashes", "assigned", "quoted", "cues", "others", "in_path", "in_url", "hexadecimal", "marks", "named"]
TREES, DEPTH, SEED = 40, 8, 17


def features(df: DataFrame, value: str, before: str, behind: str, path: str) -> DataFrame:
    """``df`` with the columns `FEATURES` of a candidate, what surrounds it and its document's path."""
    v, low = F.col(value), F.lower(F.col(before))
    n = F.greatest(F.length(v), F.lit(1))
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    dictionary = sorted(set(NAMES) | set(CUES) | set(OTHER) | {w for w in COMMON_WORDS["en"] if len(w) > 2})
    runs = F.filter(F.regexp_extract_all(F.regexp_replace(v, "([a-z])(?=[A-Z])", "$1 "), F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.lower(w).isin(*dictionary))
    around = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", low, F.lower(F.col(behind))), F.lit("[a-z][a-z0-9]+"), F.lit(0)))
    some = lambda words: F.size(F.filter(around, lambda w: w.isin(*words))).cast("double")
    return df.withColumns({
        "length": n.cast("double"),
        "to_digit": share(r"[A-Za-z](?=[0-9])"),
        "to_letter": share(r"[0-9](?=[A-Za-z])"),
        "to_upper": share(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "words": F.aggregate(runs, F.lit(0), lambda s, w: s + F.length(w)) / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "dashes": share("[-_]"),
        "assigned": low.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "quoted": low.rlike("[\"'`]$").cast("double"),
        "cues": some(CUES) + F.size(F.filter(F.lit(CUES), lambda c: low.rlike(r"[=:]\s*[\"'`]?$") & F.contains(low, c))),
        "others": some(OTHER),
        "in_path": F.lower(F.coalesce(F.col(path), F.lit(""))).rlike(r"test|example|fixture|sample|mock|doc").cast("double"),
        "in_url": low.rlike(r"(://|www\.)\S*$").cast("double"),
        "marks": share("[^A-Za-z0-9+/=_.-]"),
        "named": F.col(behind).rlike(r"^\s*[=:]").cast("double"),
        "hexadecimal": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
    })


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``(_bl_id, _bl_path, start, end, value, before, behind)`` of every candidate of every whole text."""
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_bl_id"), path.alias("_bl_path"), F.coalesce(F.col(text_col), F.lit("")).alias("_bl_t"))
    hits = F.filter(matches(F.col("_bl_t"), CANDIDATE), lambda m: m["value"].rlike("[0-9]|[a-z][A-Z]|[A-Z][a-z]") & ~m["value"].rlike(r"^[0-9.,/=+_-]+$"))
    text = F.col("_bl_t")

    def bare(m: Column) -> Column:
        """The value alone, without its name, sign and opening quote."""
        lead = F.length(F.regexp_extract(m["value"], f"^{ASSIGNS}[\"'`]?", 0))
        value = F.substring(m["value"], lead + 1, F.length(m["value"]) - lead)
        return F.struct((m["start"] + lead).alias("start"), m["end"].alias("end"), value.alias("value"))

    def password(m: Column) -> Column:
        lead = F.length(F.substring_index(m["value"], ":", 1)) + 1
        return F.struct((m["start"] + lead).alias("start"), m["end"].alias("end"), F.regexp_replace(m["value"], r"^[^:]*+:", "").alias("value"))

    given = F.concat(F.transform(matches(text, ASSIGNED), bare), F.transform(matches(text, IN_URL, "://"), password))
    rows = rows.withColumn("_bl_a", F.array_distinct(F.filter(given, lambda m: m["value"] != "")))
    # A run at either end of an assigned value is that value, or a part of it.
    inside = lambda m: F.exists("_bl_a", lambda a: (a["start"] <= m["start"]) & (m["end"] <= a["end"]) & ((a["start"] == m["start"]) | (a["end"] == m["end"])))
    rows = rows.withColumn("_bl_hits", F.array_sort(F.concat("_bl_a", F.filter(hits, lambda m: ~inside(m)))))
    rows = rows.filter(F.size("_bl_hits") > 0).withColumn("_bl_c", chunks(text))
    hits, parts = F.col("_bl_hits"), F.col("_bl_c")

    def near(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
            piece(parts, m["start"] - NEAR, NEAR).alias("before"),
            piece(parts, m["end"], NEAR).alias("behind"),
        )

    return rows.select("_bl_id", "_bl_path", F.transform(hits, near).alias("_bl_m")).select("_bl_id", "_bl_path", F.explode("_bl_m").alias("_bl_m")).select("_bl_id", "_bl_path", "_bl_m.*")


def labelled(spark: SparkSession, each: int = 120, seed: int = SEED) -> DataFrame:
    """``(value, before, behind, path, label)``: findings written out by rule, ``each`` of every kind."""
    rng = random.Random(seed)
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexa, b62, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: rng.choice(NAMES)
    fill = lambda: " ".join(of(string.ascii_lowercase, rng.randint(2, 8)) for _ in range(rng.randint(1, 4)))
    case = lambda s: rng.choice([s, s, s.upper()])
    rows = []
    paths = random.Random(seed + 1)

    def place(label: int) -> str:
        """A path; false findings lie among tests, examples and documentation more often than secrets do."""
        if paths.random() < (0.2 if label else 0.5):
            return paths.choice(["tests/test_{}.py", "src/test/{}.java", "fixtures/{}.json", "examples/{}.yaml", "docs/{}.md", "mocks/{}.js"]).format(paths.choice(NAMES))
        return paths.choice(["src/{}.py", "config/{}.yaml", ".env", "deploy/{}.sh", "lib/{}.js", "settings/{}.ini", ""]).format(paths.choice(NAMES))

    def add(label: int, before: str, value: str, behind: str = "") -> None:
        rows.append((value, f"{fill()} {before}"[-NEAR:], f"{behind} {fill()}"[:NEAR], place(label), label))

    for _ in range(each):
        cue, quote, sign = rng.choice(CUES), rng.choice("\"'"), rng.choice([" = ", "=", ": "])
        add(1, case(f"{cue}{sign}{quote}"), case(of(hexa, rng.choice([32, 40, 64]))), quote)
        add(1, case(f"{rng.choice(['api', 'my', 'db'])}_{cue}{sign}{quote}"), of(b62, rng.randint(20, 48)), quote)
        add(1, f"{word()} {sign}{quote}", "AKIA" + of(upper, 16), quote)
        add(1, f"{cue} ", rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + of(b62, rng.randint(24, 36)))
        add(1, "authorization: bearer ", of(b62, rng.randint(30, 60)))
        add(1, f"{cue}{sign}", of(b62 + "+/", 40))
        sure, marks = rng.choice(CUES[:6]), "!#$%&*@^?~"
        pick = rng.choice([case(sure), f"{word()}_{sure}", f"{word()}_{sure}".upper()])
        short = rng.choice([of(b62 + marks, rng.randint(7, 18)), of(string.ascii_lowercase, rng.randint(3, 7)) + of(string.digits, rng.randint(1, 4)) + of(string.ascii_lowercase + marks, rng.randint(0, 6)), of(string.ascii_letters, 4).capitalize() + of(b62, 4) + of(marks, 1) + of(string.digits, 1)])
        some = rng.choice([quote, ""])
        add(1, f"{pick}{sign}{some}", short, some)
        add(1, f"{word()}_{cue}{sign}".upper(), of(b62 + "+/", 40))
        add(1, f"{word()}://{word()}:", short, f"@{word()}.{rng.choice(['host', 'com', 'local'])}:5432/{word()}")
        add(0, f"{word()}://{word()}:", rng.choice(["password", "pass", "xxxx", "****", f"<{word()}>", "${" + word().upper() + "}", "changeme"]), f"@{word()}.com/")
        plain = rng.choice([of(string.ascii_lowercase, rng.randint(1, 12)), word(), word().capitalize(), f"{word()}()", "${" + word().upper() + "}", f"<{word()}-{cue}>", "****", str(rng.randint(0, 99))])
        add(0, f"{rng.choice([cue, pick])}{sign}{some}", plain, some)
        add(0, "", f"{word()}_{word()}_{cue}_{word()}".upper(), rng.choice(["=", " = ", ": "]) + of(b62, 30))
        add(0, f"{rng.choice(OTHER)} ", of(hexa, rng.choice([32, 40, 64])))
        add(0, f"{rng.choice(['md5', 'sha1', 'sha256', 'etag', 'checksum'])}{sign}{quote}", case(of(hexa, rng.choice([32, 40, 64]))), quote)
        add(0, f"{rng.choice(['id', 'uuid', word()])}{sign}{quote}", "-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)), quote)
        add(0, rng.choice(["", "see ", quote]), "/".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["", ".html", "2.json"]))
        add(0, "https://", f"{word()}.{word()}.com/{word()}/{word()}-{rng.randint(1, 9999)}")
        add(0, rng.choice(["new ", "", "class "]), "".join(w.capitalize() for w in (word(), word(), word())) + str(rng.randint(1, 9)))
        add(0, "", "_".join(word() for _ in range(3)) + f"_{rng.randint(1, 99)}")
        add(0, f"{word()}{sign}", of(string.ascii_lowercase, rng.randint(16, 30)).capitalize())
        add(0, f"{word()} ", "-" * rng.randint(16, 40) + of(string.ascii_uppercase, 2))
    return spark.createDataFrame(rows, "value string, before string, behind string, path string, label int").coalesce(1)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel | None:
    """The forest for labelled findings; None unless both labels occur."""
    known = findings.filter("label is not null and value is not null")
    if known.select("label").distinct().count() < 2:
        return None
    rows = features(known, "value", "before", "behind", "path").select(*FEATURES, F.col("label").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="_bl_v", labelCol="label", probabilityCol="_bl_p", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_bl_v"), forest]).fit(rows)


def scan(docs: DataFrame, model: PipelineModel | None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, least: float = 0.5) -> DataFrame:
    """``(id, start, end, value_sha256, score, secret)`` of every candidate; its text is not repeated."""
    rows = features(candidates(docs, id_col, text_col, path_col), "value", "before", "behind", "_bl_path")
    keep = [F.col("_bl_id").alias(id_col), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2("value", 256).alias("value_sha256")]
    if model is None:
        return rows.select(*keep, F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    score = vector_to_array("_bl_p")[1]
    return model.transform(rows).select(*keep, score.alias("score"), (score >= least).alias("secret"))
