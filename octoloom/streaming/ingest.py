"""Orders that arrive as files: each content is answered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.orders import content_hash


def order_stream(spark: SparkSession, path: str, pattern: str = "*.y*ml", files_per_trigger: int = 100) -> DataFrame:
    """(order_id, body, sa_hash, arrived) of files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    body = F.decode("content", "UTF-8")
    return files.select(
        F.col("path").alias("order_id"),
        body.alias("body"),
        content_hash(body).alias("sa_hash"),
        F.col("modificationTime").alias("arrived"),
    )


def first_seen(orders: DataFrame, within: str = "7 days") -> DataFrame:
    """Orders whose hash has not been seen ``within`` the watermark; state is dropped after it."""
    return orders.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["sa_hash"])


def run(
    orders: DataFrame, answer: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Hand each micro-batch to ``answer``; with an idempotent sink, each order counts exactly once."""
    writer = orders.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
