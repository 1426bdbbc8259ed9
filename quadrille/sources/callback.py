"""A user's function as a Spark data source, for reading and for writing.

``register`` makes ``spark.read.format(name).load()`` call ``read(partition, partitions)`` in as
many tasks as asked for, each of which yields (id, xlo, ylo, xhi, yhi) rows, and
``df.write.format(name).save()`` hand each task's rows to ``write(rows)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id long, xlo double, ylo double, xhi double, yhi double"
Read = Callable[[int, int], Iterable[tuple]]
Write = Callable[[Iterator], object]


def register(spark: SparkSession, name: str, read: Read | None = None, write: Write | None = None, partitions: int = 1, schema: str = SCHEMA) -> None:
    source_name, source_schema = name, schema

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition):
            yield from read(partition.value, partitions)

    class Writer(DataSourceWriter):
        def write(self, rows):
            write(rows)
            return WriterCommitMessage()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return source_schema

        def reader(self, schema):
            if read is None:
                raise NotImplementedError(f"{source_name} can't be read")
            return Reader()

        def writer(self, schema, overwrite):
            if write is None:
                raise NotImplementedError(f"{source_name} can't be written")
            return Writer()

    spark.dataSource.register(Source)
