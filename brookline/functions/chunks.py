"""Chunks of an indexed sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RuntimeConfig


def chunk_count(size: int, config: RuntimeConfig) -> int:
    """Chunks that ``size`` elements are reduced in: none, one for one worker, else all that fit."""
    if size == 0:
        return 0
    if config.worker_count == 1:
        return 1
    return min(size, config.worker_count * config.chunks_per_worker)


def _quotient(whole, by: int, size: int, chunks: int) -> Column:
    """``whole(cast)`` div ``by``; in longs if they hold size * chunks, else in 38-digit decimals."""
    if size * chunks < 1 << 63:
        return F.call_function("div", whole(lambda x: x.cast("long")), F.lit(by).cast("long"))
    wide = lambda x: x.cast("decimal(20,0)")
    top = whole(wide)
    return ((top - top % wide(F.lit(by))) / wide(F.lit(by))).cast("long")


def chunk_of(index: Column, size: int, chunks: int) -> Column:
    """The chunk of a 0-based index: chunk c begins at floor(c * size / chunks).  Exact for any size."""
    return _quotient(lambda cast: (cast(index) + 1) * cast(F.lit(chunks)) - 1, size, size, chunks)


def start_of(chunk: Column, size: int, chunks: int) -> Column:
    """The index that a chunk begins at."""
    return _quotient(lambda cast: cast(chunk) * cast(F.lit(size)), chunks, size, chunks)
