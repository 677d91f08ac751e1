"""Binary files and text columns as blobs and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.numbers import ceil_div
from .files import find, open_file

#: Default bytes of a chunk.
CHUNK_SIZE = 512 * 512


def read_blobs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(blob_id, n_bytes, data) of whole files; ``pattern`` such as ``*.tar`` picks by name."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        F.col("path").alias("blob_id"), F.col("length").alias("n_bytes"), F.col("content").alias("data")
    )


def text_blobs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blobs from a text column, as UTF-8."""
    data = F.col(text_col).cast("binary")
    return df.select(F.col(id_col).alias("blob_id"), F.octet_length(data).cast("long").alias("n_bytes"), data.alias("data"))


def chunks(blobs: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """(blob_id, n_bytes, chunk_id, byte_start, data) of blobs that are already rows; empty blobs give none."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least 1")
    count = ceil_div(F.octet_length("data"), chunk_size)
    numbered = blobs.where(F.octet_length("data") > 0).select(
        "blob_id", F.octet_length("data").cast("long").alias("n_bytes"), "data", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("chunk_id")
    )
    start = F.col("chunk_id") * chunk_size
    return numbered.select(
        "blob_id", "n_bytes", "chunk_id", start.alias("byte_start"), F.substr("data", (start + 1).cast("int"), F.lit(chunk_size)).alias("data")
    )


def chain(*sources: DataFrame) -> DataFrame:
    """All rows of all sources, by column name."""
    if not sources:
        raise ValueError("nothing to chain")
    return reduce(DataFrame.unionByName, sources)


class ChunkPartition(InputPartition):
    def __init__(self, path: str, total: int, first: int, last: int):
        self.path, self.total, self.first, self.last = path, total, first, last


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("chunk_size", CHUNK_SIZE))
        self.per_task = int(options.get("chunks_per_task", 256))

    def partitions(self) -> list[ChunkPartition]:
        out = []
        for path, total in find(self.path):
            count = -(-total // self.size)
            out += [ChunkPartition(path, total, k, min(k + self.per_task, count)) for k in range(0, count, self.per_task)]
        return out

    def read(self, partition: ChunkPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a source without files
            return
        with open_file(partition.path) as file:
            file.seek(partition.first * self.size)
            for k in range(partition.first, partition.last):
                data = file.read(self.size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.path], pa.string()),
                        pa.array([partition.total], pa.int64()),
                        pa.array([k], pa.int64()),
                        pa.array([k * self.size], pa.int64()),
                        pa.array([data], pa.binary()),
                    ],
                    names=["blob_id", "n_bytes", "chunk_id", "byte_start", "data"],
                )


class ChunkSource(DataSource):
    """Files on a shared mount or in an object store, a task for each range of chunks.

    One very large file is read by many tasks, and no task holds more than one chunk.
    """

    @classmethod
    def name(cls) -> str:
        return "blob_chunks"

    def schema(self) -> str:
        return "blob_id string, n_bytes long, chunk_id long, byte_start long, data binary"

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, path: str, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    spark.dataSource.register(ChunkSource)
    return spark.read.format("blob_chunks").option("chunk_size", chunk_size).load(path)
