"""A data source that pulls from a Python generator, which need not end.

One partition, in order, with the index of each element.  Rows come in batches as
they are asked for, so a limit behind it ends the generator.
"""

from __future__ import annotations

import base64

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader


class GeneratorSource(DataSource):
    """Options: ``function``, a pickled function that returns an iterator; ``schema``, of its items."""

    @classmethod
    def name(cls) -> str:
        return "brookline_generator"

    def schema(self) -> str:
        return f"__ord0 bigint, value {self.options['schema']}"

    def reader(self, schema) -> DataSourceReader:
        return GeneratorReader(self.options["function"])


class GeneratorReader(DataSourceReader):
    def __init__(self, function: str):
        self.function = function

    def read(self, partition):
        yield from enumerate(iter(cloudpickle.loads(base64.b64decode(self.function))()))


def packed(function) -> str:
    return base64.b64encode(cloudpickle.dumps(function)).decode()
