"""Token ids in files: Simple-8b words with per-block offsets.

An id sequence is cut into blocks of 256 ids.  A block is coded in 64-bit words:
the low 4 bits of a word select how many ids it holds and in how many bits each,
the other 60 hold them.  The widest packing that takes the next ids is chosen.  An
id of more than 60 bits is escaped: selector 0, and the id in the word after it.
An offset per block says where its words begin, so that all blocks are coded, and
all words of one selector decoded, at once in numpy.

A record is one such sequence with the documents it holds:

    "S8B2", documents, ids, blocks, words       4 bytes, 4 x uint64
    document ids, ids per document              int64, uint64 each
    which document ids are null                 a bit for each, to whole bytes
    offsets of blocks in words                  uint64, blocks + 1 of them
    words                                       uint64

all little-endian.  Records
are kept in ascending order in a binary column of Parquet files, the one kind of
file that Spark writes to and reads from any store; a record's place is the
number of its part and its number in the part.

Scale: texts are shuffled once, by ranges of the document id and a hash of the text
(so that equal ids, or nulls, are more than one range), and encoded after
it, so that ids are never shuffled.  Parts are independent; what joins them is one
row per part (the ids before it), bounded by the number of tasks.

Nulls, ties, repeats: a null text counts as empty and gets just the end id; null
document ids come first; equal document ids are in the order of their texts' hashes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import own_dir, ship, tidy

BLOCK = 256
#: Selectors: ids per word, bits per id (fixed values of the format).  0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTH = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
#: From the fewest ids per word to the most.
ORDER = [14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 15]
HEAD = struct.Struct("<4s4Q")
#: Rows of a batch that are Python objects at once.
ROWS = 1000
#: Ids that end a record; a document is never split.
RECORD_IDS = 1 << 17


def widths(ids: np.ndarray) -> np.ndarray:
    """The bits that each id needs."""
    if len(ids) and int(ids.max()) >> 52 == 0:
        return np.frexp(ids.astype(np.float64))[1]  # a float holds these exactly
    ids = ids.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ids |= ids >> np.uint64(shift)
    return np.bitwise_count(ids)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, offsets)`` of an id sequence."""
    n, most = len(ids), int(COUNT.max())
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK + most, np.uint64)
    flat[:n] = ids
    bits = np.zeros((blocks, BLOCK + most), np.uint8)
    bits[:, :BLOCK] = widths(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)
    # The widest packing that fits at each position, by its place in `ORDER`; a
    # window's largest width comes from windows of powers of two.
    powers = {1: bits}
    best = np.zeros((blocks, BLOCK), np.uint8)
    for place, k in enumerate(ORDER, 1):
        c, p = int(COUNT[k]), 1
        while p * 2 <= c:
            if p * 2 not in powers:
                x = powers[p].copy()
                np.maximum(x[:, :-p], powers[p][:, p:], out=x[:, :-p])
                powers[p * 2] = x
            p *= 2
        x = powers[p]
        widest = x[:, :BLOCK] if p == c else np.maximum(x[:, :BLOCK], x[:, c - p : c - p + BLOCK])
        np.maximum(best, (widest <= WIDTH[k]).view(np.uint8) * np.uint8(place), out=best)
    select = np.array([0, *ORDER], np.int64)[best.reshape(-1)]
    # All blocks step from word to word together.
    first = np.zeros(len(select), bool)
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    step = COUNT[select]
    while len(at):
        first[at] = True
        at = at + step[at]
        on = at < end
        at, end = at[on], end[on]
    at = np.flatnonzero(first)
    kinds = select[at]
    place = np.cumsum(1 + (kinds == 0)) - (1 + (kinds == 0))  # an escape has two words
    total = len(at) + int((kinds == 0).sum())
    words = np.zeros(total, np.uint64)
    for k in np.unique(kinds):
        own = np.flatnonzero(kinds == k)
        if k == 0:
            words[place[own] + 1] = flat[at[own]]
            continue
        # Room behind a block's last id may get bits of the next block's; it is never read.
        word, start = np.full(len(own), k, np.uint64), at[own]
        for i in range(int(COUNT[k]) if WIDTH[k] else 0):
            word |= flat[start + i] << np.uint64(4 + i * int(WIDTH[k]))
        words[place[own]] = word
    offsets = np.append(place[np.searchsorted(at, np.arange(blocks) * BLOCK)], total) if blocks else np.zeros(1, np.int64)
    return words, offsets.astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``words``."""
    kinds = (words & np.uint64(15)).astype(np.int64)
    heads = np.ones(len(words), bool)
    # The word after an escape is an id, whatever its low bits; runs of such go in turn.
    for i in np.flatnonzero(kinds == 0):
        if heads[i]:
            heads[i + 1] = False
    at = np.flatnonzero(heads)
    kinds = kinds[at]
    count = COUNT[kinds]
    bounds = np.append(0, np.cumsum(heads))[offsets.astype(np.int64)]  # of each block, in heads
    block = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    before = np.append(0, np.cumsum(count))
    start = before[:-1] - before[bounds[:-1]][block] + block * BLOCK
    # A block's last word may have room for more ids than are left.
    used = np.minimum(count, np.minimum((block + 1) * BLOCK, n) - start)
    out = np.zeros(n, np.uint64)
    for k in np.unique(kinds):
        own = np.flatnonzero(kinds == k)
        if k == 0:
            out[start[own]] = words[at[own] + 1]
            continue
        if not WIDTH[k]:
            continue
        mask, some, first, left = np.uint64((1 << int(WIDTH[k])) - 1), words[at[own]], start[own], used[own]
        for i in range(int(COUNT[k])):
            if i and (left <= i).any():
                keep = left > i
                some, first, left = some[keep], first[keep], left[keep]
            out[first + i] = some >> np.uint64(4 + i * int(WIDTH[k])) & mask
    return out


def record(docs: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    head = HEAD.pack(b"S8B2", len(docs), len(ids), len(offsets) - 1, len(words))
    return b"".join([head, docs.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), np.packbits(nulls).tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(document ids, which of them are null, ids per document, ids)`` of a record."""
    magic, docs, n, blocks, words = HEAD.unpack_from(data)
    if magic != b"S8B2":
        raise ValueError("not a token record")
    at, parts = HEAD.size, []
    for size, kind in ((docs, "<i8"), (docs, "<u8"), (-(-docs // 8), "u1"), (blocks + 1, "<u8"), (words, "<u8")):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    nulls = np.unpackbits(parts[2], count=docs).astype(bool)
    return parts[0], nulls, parts[1].astype(np.int64), unpack(parts[4], parts[3], n)


def write_tokens(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, record_ids: int = RECORD_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes records to ``path``."""
    ship(docs.sparkSession)
    source = bpe.vocabulary(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(source, bpe.Library)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs, counts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, size
            ids = np.concatenate(held)
            keys = np.array([d or 0 for d in docs], np.int64)
            data = record(keys, np.array([d is None for d in docs]), np.array(counts, np.int64), ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["part", "record", "before", "n_ids", "data"],
            )
            block, before, size = block + 1, before + len(ids), 0
            docs.clear(), counts.clear(), held.clear()
            return out

        parts = (batch.slice(k, ROWS) for batch in batches for k in range(0, batch.num_rows, ROWS))
        for part_rows in parts:
            for key, ids in zip(part_rows.column(0).to_pylist(), own.encode_texts(part_rows.column(1).to_pylist())):
                docs.append(key)
                counts.append(len(ids) + 1)
                held.append(ids)
                held.append(end)
                size += counts[-1]
                if size >= record_ids:
                    yield flush()
        if docs:
            yield flush()

    rows.mapInArrow(tidy(encode), "part int, record long, before long, n_ids long, data binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids array<long>)`` of each document in the files.

    With ``digest`` instead of the ids ``ids_crc32``, the unsigned CRC-32 of the
    ids as little-endian unsigned 32-bit integers.
    """
    ship(spark)
    records = spark.read.parquet(path)
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    # One row of 12 bytes per writing task, whatever the data.
    rows = records.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("start"), "data")
    kind = pa.int64() if digest else pa.list_(pa.int64())
    name = "ids_crc32" if digest else "ids"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, nulls, counts, ids = parse(data.as_py())
                ends = np.cumsum(counts)
                starts = ends - counts
                if digest:
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    values = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                else:
                    values = [ids[a:b].astype(np.int64) for a, b in zip(starts.tolist(), ends.tolist())]
                keys = pa.array(docs, pa.int64(), mask=nulls)
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts + start), pa.array(counts), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name])

    return rows.mapInArrow(tidy(decode), f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'array<long>'}")


def token_digests(docs: DataFrame, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the token files, to the shared folder unless ``path`` is given, and reads them back."""
    spark = docs.sparkSession
    path = path or f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, end_id, id_col, text_col, vocabulary)
    return read_tokens(spark, path, digest=True)
