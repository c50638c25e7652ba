"""Ordered collection pipelines on Spark DataFrames.

    from brookline import from_rows, summing
    from_rows(spark, [1, 2, 3]).filter(lambda e: e.value > 1).map(lambda e: e.value * 2).collect(summing())
"""

from .config import CompileConfig, RuntimeConfig
from .operators.collectors import (
    Collector,
    Found,
    ListOf,
    MinMax,
    ParallelCollector,
    ShortCircuitingCollector,
    StringJoin,
    TakeFirst,
    ToMap,
    collector,
    find_first,
    summing,
    to_array,
    to_list,
    to_set,
)
from .operators.inner import generated, items, related, whole
from .plans.pipeline import ParallelPipeline, SequentialPipeline, SplittableSource
from .sources import from_array, from_dataframe, from_generator, from_iterable, from_parquet, from_range, from_rows, from_table, of

__all__ = [
    "Collector", "CompileConfig", "Found", "ListOf", "MinMax", "ParallelCollector", "ParallelPipeline", "RuntimeConfig", "SequentialPipeline",
    "ShortCircuitingCollector", "SplittableSource", "StringJoin", "TakeFirst", "ToMap", "collector", "find_first", "from_array",
    "from_dataframe", "from_generator", "from_iterable", "from_parquet", "from_range", "from_rows", "from_table", "generated", "items",
    "of", "related", "summing", "to_array", "to_list", "to_set", "whole",
]
