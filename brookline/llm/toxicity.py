"""Toxicity by a convolutional network over hashed words.

Words (runs of letters, lower-cased) are hashed to buckets in Spark; filters over
one, two and three words, the maximum of each over the whole text, and a softmax
give a log-odds.  Embeddings, filters and output are trained together in numpy on the
driver, on the whole texts of a bounded sample of labelled rows.  A bucket that fewer than ``RARE`` of these texts have is unknown,
so that a text can't be learned by heart.  A third of the sample is set aside to
calibrate a threshold for each language; a text's language is read off its common
words, never given.  The score is shifted so that its language's threshold lies
at ``CUT``.

Scale: the driver sees the sample only (``sample`` rows of each label, and some
``most`` words in all: fewer rows where texts are long), which does not grow.  The label side of the join is that sample and
is broadcast.  Scoring is one narrow pass without a shuffle over whole texts.

Nulls and short texts: a null text counts as empty, and an empty text is scored
like any other.  Rows with a null label or id train nothing; of several labels of
an id the largest counts.  Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, release, ship, tidy
from .common_words import COMMON_WORDS
from .convnet import ConvNet
from .langid import held_out

BUCKETS = 1 << 20
#: Labelled rows of each label that training uses at most, and words in all, about.
SAMPLE, MOST = 4000, 8_000_000
RARE = 3
CUT = 0.3
WIDTHS, FILTERS, EMBED = (1, 2, 3), 16, 12
#: The size that embeddings begin with, the step of training, and texts that it goes through in all.
SCALE, RATE, VISITS = 0.01, 0.1, 40_000
#: The share of words that training hides, and the cases that all languages' threshold weighs as in a language's own.
HIDE, SHRINK = 0.5, 20


def buckets(text: Column) -> Column:
    """The bucket of each word: 1 to ``BUCKETS - 1``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(BUCKETS - 1)) + 1).cast("int"))


class Scorer:
    """The network, its vocabulary, and a threshold for each language."""

    def __init__(self, row_of: np.ndarray, net: ConvNet, cues: np.ndarray):
        self.row_of, self.net, self.cues = row_of, net, cues
        self.threshold = np.zeros(len(COMMON_WORDS) + 1)

    def language(self, words: np.ndarray) -> int:
        """The language whose common words the text has most; after the last if it has none."""
        counts = np.bincount(self.cues[words], minlength=len(COMMON_WORDS) + 1)[1:]
        return int(counts.argmax()) if counts.max() > 0 else len(COMMON_WORDS)

    def odds(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(texts))
        group, size = [], 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t) + 4
            if size > 1 << 18 or i + 1 == len(texts):
                z = self.net.logits(*self.net.join([self.row_of[texts[j]] for j in group]))
                out[group] = z[:, 1] - z[:, 0]
                group, size = [], 0
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        over = self.odds(texts) - self.threshold[[self.language(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(over + shift, -50, 50)))


def best_threshold(odds: np.ndarray, labels: np.ndarray, default: float) -> float:
    """The log-odds with the best F1, in the middle of the gap below it; ``default`` with few cases."""
    if labels.sum() < 5 or len(labels) - labels.sum() < 5:
        return default
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(f1.argmax())
    above = odds[order[k]]
    below = odds[order[k + 1]] if k + 1 < len(order) else above - 1
    return float((above + below) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = MOST) -> Scorer | None:
    """A scorer from labelled rows that aren't held out; None without both labels."""
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_bl_id")).agg((F.max(label_col) > 0).cast("int").alias("_bl_y"))
    pick = [bounded_sample(known.filter(f"_bl_y = {y}"), "_bl_id", sample) for y in (0, 1)]
    few = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("_bl_id"), F.col(text_col).alias("_bl_t")).join(few, "_bl_id")
    rows = cut(rows.select("_bl_id", "_bl_y", buckets(F.col("_bl_t")).alias("w")))
    words = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    if words > most:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("words"), "_bl_id"), F.lit(1 << 40)) < F.lit(int(most / words * (1 << 40))))
    # As strings the sample has some eight bytes a word in Python; lists take five times that.
    rows = rows.select("_bl_id", "_bl_y", F.array_join(F.col("w").cast("array<string>"), ",").alias("w"))
    rows = rows.orderBy(F.xxhash64("_bl_id"), "_bl_id", "w").limit(2 * sample).select("_bl_y", "w").collect()
    y = np.array([r["_bl_y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    texts = [np.fromstring(r["w"], np.int32, sep=",") if r["w"] else np.zeros(0, np.int32) for r in rows]
    del rows
    third = np.array([i % 3 == 2 for i in range(len(y))])
    if len(y) < 30:
        third[:] = False
    spread = np.zeros(BUCKETS, np.int64)
    for i in np.flatnonzero(~third):
        spread[np.unique(texts[i])] += 1
    row_of = np.ones(BUCKETS, np.int32)
    often = np.flatnonzero(spread >= RARE)
    row_of[often] = 2 + np.arange(len(often))
    row_of[0] = 0
    # Common words of one language only; 1 for the first language.
    words = [(k, w) for k, ws in enumerate(COMMON_WORDS.values()) for w in ws if sum(w in x for x in COMMON_WORDS.values()) == 1]
    hashed = spark.createDataFrame([(k, w) for k, w in words], "k int, w string").select("k", (F.pmod(F.xxhash64("w"), F.lit(BUCKETS - 1)) + 1).alias("b"))
    cues = np.zeros(BUCKETS, np.int8)
    for r in hashed.collect():
        cues[r["b"]] = r["k"] + 1
    net = ConvNet(2 + len(often), 2, EMBED, WIDTHS, FILTERS, scale=SCALE)
    scorer = Scorer(row_of, net, cues)
    own = np.flatnonzero(~third)
    # Both labels weigh alike: the rarer one is repeated.
    rare = own[y[own] == (y[own].mean() < 0.5)]
    more = np.concatenate([own, *[rare] * max(0, min(8, round((len(own) - len(rare)) / max(1, len(rare))) - 1))])
    epochs = max(5, min(30, VISITS // len(more)))
    net.fit([row_of[texts[i]] for i in more], y[more], epochs=epochs, batch=32, rate=RATE, hide=HIDE)
    release()
    at = np.flatnonzero(third) if third.any() else own
    held = [texts[i] for i in at]
    odds, langs = scorer.odds(held), np.array([scorer.language(t) for t in held])
    default = best_threshold(odds, y[at], 0.0)
    for k in range(len(scorer.threshold)):
        own = y[at][langs == k]
        cases = min(own.sum(), len(own) - own.sum())
        scorer.threshold[k] = (cases * best_threshold(odds[langs == k], own, default) + SHRINK * default) / (cases + SHRINK)
    return scorer


def score_column(scorer: Scorer | None):
    """A function of a column of `buckets`: the score of each text."""
    packed = pickle.dumps(scorer)

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = pickle.loads(packed)
        for rows in batches:
            if known is None:
                yield pd.Series(np.zeros(len(rows)))
            else:
                yield pd.Series(known.scores(rows.tolist()))

    return score


def score(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score_column(scorer)(buckets(F.col(text_col))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are scored toxic, columns as they were."""
    ship(docs.sparkSession)
    return docs.filter(score_column(scorer)(buckets(F.col(text_col))) < CUT)
