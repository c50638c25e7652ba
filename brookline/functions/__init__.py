"""Column functions with the semantics of fixed-width numbers and ordered chunks."""

from .chunks import chunk_count, chunk_of
from .sums import typed_sum
from .udf import opaque

__all__ = ["chunk_count", "chunk_of", "opaque", "typed_sum"]
