"""Arrow batches of bounded bytes for the Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch.  A worker holds a batch of rows and of results, each as Arrow and as Python objects, and a task has a
#: worker for each function of a chain, so Spark's own 64 MB are several hundred MB a worker.  A longer row is a batch alone.
BATCH_BYTES = 4 << 20
_NAME, _OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(spark: SparkSession) -> None:
    """Sets the session's bound to ``BATCH_BYTES`` where it is Spark's own; a bound that somebody chose stays."""
    if spark.conf.get(_NAME) == _OWN:
        spark.conf.set(_NAME, str(BATCH_BYTES))
