"""Shared plumbing of the corpus operators: tables, stage cuts, free names and components.

Nothing here collects rows of a corpus to the driver.  Lineage is cut by writing a Parquet
table below ``spark.checkpoint.dir`` (a folder every executor sees), so a lost executor costs
only the tasks that ran on it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only on a local master whose session names no checkpoint folder, as in tests.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/octoloom"

_LOCAL = re.compile(r"local(\[.*\])?")

#: The words of the quality, mixing and near-duplicate contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the one set on the context.

    Executors of a cluster do not see a local default, so without either it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not _LOCAL.fullmatch(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = DEFAULT_CHECKPOINT_DIR
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: The folder, below the application's, of cuts that ``settled`` deletes.
_scope: ContextVar[str] = ContextVar("scope", default="")


def _cuts(spark: SparkSession) -> str:
    """The folder of this application's cuts."""
    return f"{checkpoint_dir(spark)}/octoloom/{spark.sparkContext.applicationId}"


def new_cut(spark: SparkSession) -> str:
    """A path for one more cut."""
    return f"{_cuts(spark)}{_scope.get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Operators return frames that read such tables, so they stay until ``settled`` or ``clear_cuts``.
    """
    spark = df.sparkSession
    path = new_cut(spark)
    df.write.parquet(path)
    out = spark.read.schema(_nullable(df.schema)).parquet(path)
    out._octoloom_path = path
    return out


_TABLE = "cut_table_"


def bucketed_cut(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """A cut whose files are bucketed by ``column``: joins on it leave these rows where they are."""
    spark = df.sparkSession
    folder, _, name = new_cut(spark).rpartition("/")
    path, name = f"{folder}/{_TABLE}{name}", f"{_TABLE}{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    out = spark.table(name)
    out._octoloom_path = path
    return out


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a cut, and every cut it needed on the way deleted."""
    inner = f"{_scope.get()}/{uuid.uuid4().hex}"
    token = _scope.set(inner)
    try:
        made = make()
    finally:
        _scope.reset(token)
    out = cut(made)
    _delete(spark, f"{_cuts(spark)}{inner}")
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing will read again."""
    path = getattr(df, "_octoloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete every cut of this application, once the results that read them are written."""
    _delete(spark, _cuts(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        inside = [status.getPath().getName() for status in files.listStatus(target)]
        for name in (target.getName(), *inside):
            if name.startswith(_TABLE):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        files.delete(target, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (``big``, ``small``; big > small, any repeats).

    ``root`` is the smallest node of the component.  Alternates the large-star and small-star
    contractions on the edge list until it is a set of stars.  Both are joins of edges with a
    one-row-per-node table of minima, pre-aggregated map side, so that a node with very many
    neighbours is a skewed join side (which adaptive execution splits), never a group held in
    one task.  Every round is cut to the shared folder.
    """
    stars = cut(edges.where("big > small").distinct())
    before = None
    while True:
        minima = stars.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        wide = stars.join(minima, F.col("small") == F.col("node"), "left").select(
            "big", F.coalesce("low", "small").alias("small")
        )
        large = cut(wide.distinct())
        drop_cut(stars)
        minima = large.groupBy(F.col("big").alias("node")).agg(F.min("small").alias("low"))
        inner = large.join(minima, F.col("big") == F.col("node")).where("small != low")
        stars = cut(
            inner.select(F.col("small").alias("big"), F.col("low").alias("small"))
            .unionByName(minima.select(F.col("node").alias("big"), F.col("low").alias("small")))
            .distinct()
        )
        drop_cut(large)
        state = stars.agg(
            F.count("*"), F.bit_xor(F.xxhash64("big", "small")), F.sum(F.hash("big", "small").cast("long"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = stars.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
    return stars.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)
