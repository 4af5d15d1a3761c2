"""Arrow IPC files as a Spark data source: one partition a record batch, only the columns that are asked for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

#: Where a row stands: its batch in the file, and its place in the batch.
BATCH, ROW = "__batch", "__row"


@contextmanager
def _opened(path: str, columns: list[str] | None = None) -> Iterator[pa.ipc.RecordBatchFileReader]:
    """The file's reader; local files are mapped, others are read by ranges. Of `columns`, only the bodies are read."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    source = pa.memory_map(inside, "r") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inside)
    with source:
        reader = pa.ipc.open_file(source)
        if columns is not None:
            at = [reader.schema.get_field_index(c) for c in columns] or [0]
            source.seek(0)
            reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=at, use_threads=False))
        yield reader


class ArrowFile(DataSource):
    """Options: path, and `columns` (names with a line feed between; all if not given, none if empty)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def columns(self) -> list[str] | None:
        given = self.options.get("columns")
        return None if given is None else [c for c in given.split("\n") if c]

    def schema(self) -> StructType:
        with _opened(self.options["path"]) as file:
            found = from_arrow_schema(file.schema)
        wanted = self.columns()
        fields = list(found) if wanted is None else [found[c] for c in wanted]
        return StructType(fields).add(BATCH, LongType(), False).add(ROW, LongType(), False)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"], [f.name for f in schema][:-2])


class _BatchReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.names = path, columns

    def partitions(self) -> list[InputPartition]:
        """From the file's footer alone."""
        with _opened(self.path) as file:
            return [InputPartition(k) for k in range(file.num_record_batches)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so if there are no partitions
            return
        with _opened(self.path, self.names) as file:
            batch = file.get_batch(partition.value)
            n = batch.num_rows
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in self.names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([partition.value] * n, pa.int64()), pa.array(range(n), pa.int64())], names=[*self.names, BATCH, ROW])


def arrow_batches(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The file's rows with __batch and __row. Executors open the file, so it must be where all reach it."""
    spark.dataSource.register(ArrowFile)
    reader = spark.read.format("arrow_file").option("path", str(path))
    return (reader if columns is None else reader.option("columns", "\n".join(columns))).load()
