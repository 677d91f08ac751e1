"""Orders that arrive again: each is answered, and equal ones are judged once.

State is keyed by the content hash and holds the report with a time to live.  A repeat within that time
gets the stored report, also one that comes late, in the same micro-batch or after a restart; later ones
are judged anew.  The state lives in RocksDB below the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What an answered order is.
ANSWER = "order_id string, sa_hash string, stix_report string, repeated boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StoredAnswers(StatefulProcessor):
    """Answers orders of one hash from state; ``judge`` makes the report of a body that has none."""

    def __init__(self, judge: Callable[[str], str], keep_ms: int | None):
        self.judge, self.keep_ms = judge, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.report = handle.getValueState("report", "stix_report string", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.report.get() if self.report.exists() else None
        for row in rows:
            repeated = held is not None
            if not repeated:
                held = (self.judge(row["body"]),)
                self.report.update(held)
            yield Row(order_id=row["order_id"], sa_hash=key[0], stix_report=held[0], repeated=repeated)

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, which the processor needs, and start no batch only to drop what has expired.

    State with a time to live asks for a batch after every batch, so a run over what is available would
    never end; what has expired is dropped by the next batch that has orders, and never answers before.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def answered(orders: DataFrame, judge: Callable[[str], str], keep_ms: int | None = 7 * 24 * 3_600_000) -> DataFrame:
    """(order_id, sa_hash, stix_report, repeated) of every order of a stream (order_id, body, sa_hash).

    ``judge`` runs in the tasks, once for each hash within ``keep_ms`` of processing time (None: for ever), on the
    body of whichever order comes first.  Bodies of one hash differ in white space around them at most.
    """
    use_state(orders.sparkSession)
    wanted = orders.select("order_id", "body", "sa_hash")
    return wanted.groupBy("sa_hash").transformWithState(
        statefulProcessor=StoredAnswers(judge, keep_ms), outputStructType=ANSWER, outputMode="Update", timeMode="ProcessingTime"
    )


def run(answers: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append answers to a Parquet table; the sink's log makes each batch count exactly once."""
    writer = answers.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
