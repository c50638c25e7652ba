"""Language identification by a convolutional network over bytes.

The network sees windows of 256 UTF-8 bytes, has filters of several widths with a
maximum over the window and a softmax over the learned languages, and is trained
in numpy on the driver, on all windows of the texts of a bounded sample of labelled
rows, of each language as many as of any other, if it has them.
Prediction cuts every whole text into such windows, one after the other, and
averages their log-probabilities by length.

Scale: the sample (``sample`` rows, some ``most`` bytes in all: fewer rows where texts
are long) is the only data that the driver sees, beside a count for each language,
and does not grow.  The model (some 20 KB) travels with the
function; prediction is one narrow Arrow pass without a shuffle.

Nulls and short texts: a null text, and one without a letter, is ``und`` with
score 0; so is every text if there is no labelled row.  Rows with a null id train
nothing and are not held out.  Repeated rows get equal results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy
from .convnet import ConvNet, softmax

WINDOW = 256
#: Labelled rows that training uses at most, and bytes in all, about.
SAMPLE, MOST = 2000, 4_000_000
#: Windows that training goes through in all, about.
VISITS = 60_000
WIDTHS, FILTERS, EMBED = (3, 4, 5), 16, 8


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id's digits leaves 2, divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[list[np.ndarray], np.ndarray]:
    """All windows of all texts, and the text of each; the last of a text may be shorter."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        for k in range(0, max(1, len(b)), size):
            parts.append(b[k : k + size])
            owner.append(i)
    return parts, np.array(owner)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST) -> tuple[list[str], ConvNet] | None:
    """Learned languages and network, from rows that aren't held out; None without such rows.

    The sample has the rows with the smallest hashes of their ids, language by language,
    so it depends on the table only.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: (r["n"], r["b"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = min(sample / len(langs), most / sum(b / n for n, b in counts.values()))
    order = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40))
    # So much of the hash range holds about ``each`` rows of a language, and at least one as a rule.
    share = lambda n: min(1.0, (each + 2 * each**0.5 + 2) / n)
    ends = known.sparkSession.createDataFrame([(k, int(share(n) * (1 << 40))) for k, (n, _) in counts.items()], "lang string, end long")
    found = known.join(F.broadcast(ends), "lang").filter(order <= F.col("end")).orderBy(order, "id", "text").limit(2 * sample + 4 * len(langs))
    texts, labels = [], []
    for r in found.select("lang", "text").collect():
        parts, _ = windows([r["text"].encode()])
        texts += parts
        labels += [langs.index(r["lang"])] * len(parts)
    net = ConvNet(256, len(langs), EMBED, WIDTHS, FILTERS)
    return langs, net.fit(texts, np.array(labels), epochs=max(2, min(40, VISITS // len(texts))))


def predict(docs: DataFrame, model: tuple[list[str], ConvNet] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every whole text."""
    ship(docs.sparkSession)
    packed = pickle.dumps(model)

    @F.pandas_udf("lang string, score double")
    @tidy
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(packed)
        for texts in batches:
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t is not None]
            if known is not None:
                names, net = known
                group, size = [], 0
                for k, i in enumerate(at):  # bounded memory, whatever a batch holds
                    group.append(i)
                    size += len(texts.iloc[i])
                    if size > 1 << 22 or k + 1 == len(at):
                        parts, owner = windows([texts.iloc[j] for j in group])
                        logp = np.log(softmax(net.logits(*net.join(parts)).astype(np.float64)) + 1e-9)
                        weight = np.array([max(1, len(p)) for p in parts], np.float64)
                        first = np.searchsorted(owner, np.arange(len(group)))
                        mean = np.add.reduceat(logp * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                        p = softmax(mean)
                        langs[group] = np.array(names, object)[p.argmax(1)]
                        scores[group] = p.max(1)
                        group, size = [], 0
            yield pd.DataFrame({"lang": langs, "score": scores})

    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col).cast("binary"))
    rows = docs.select(F.col(id_col), held_out(id_col).alias("_bl_out"), guess(text).alias("_bl_g"))
    return rows.select(F.col(id_col), F.col("_bl_out").alias("held_out"), F.col("_bl_g.lang").alias("lang_pred"), "_bl_g.score")
