"""Shards by proportional stratified interleaving.

Rows of each source are ranked in seeded hash order, the rank becomes a fraction of the source
(from a starting point of the source's own),
and the order of those fractions is cut into equal runs: every run of the order holds each source
in its share of the corpus.  No rank is computed over a whole source or the whole table in one
task.  A rank is the count of rows in lower buckets plus a row number inside the own bucket:
hash prefixes for the rank in a source (so a hot source has many buckets), and equal steps of
the fraction for the rank in the order (evenly filled by construction).
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 8
SEED = "shard-1"
#: Rows meant for one bucket, and buckets there are at least.
BUCKET_ROWS, LEAST_BUCKETS = 16_384, 256


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def row_key(doc_id: Column, text_crc32: Column, size: Column, seed: str = SEED) -> Column:
    """32 hex digits in seeded order; a null id hashes as the empty text.

    CRC and size take part so that rows with one id, or none, do not meet in one bucket.
    """
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), text_crc32.cast("string"), size.cast("string")]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def source_phase(source: Column, seed: str = SEED) -> Column:
    """Where in its steps of the order a source stands, between 0 and 1.

    Sources of equal size would otherwise meet at the same fractions and crowd out the others there.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _offsets(rows: DataFrame, group: list[str], bucket: str, count: Column) -> DataFrame:
    """Rows in lower buckets of the same group, for each bucket (one row a bucket, pre-aggregated)."""
    counts = rows.groupBy(*group, bucket).agg(count.alias("n"))
    lower = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return counts.select(
        *[F.col(c).alias(f"_{c}") for c in [*group, bucket]],
        F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("lower"),
        F.sum("n").over(whole).alias("whole"),
    )


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """One row a document: doc_id, source, size, text_crc32, shard, slot.

    Shard sizes differ by one row at most; slots count from 0 in each shard, in the interleaved
    order.  Null texts have size 1 and the CRC of the empty text; null sources are one source; very long
    texts are read whole.  Null or repeated ids are told apart by CRC and size.  Rows equal in all of
    these are interchangeable: they are ranked as one row with a count, so no number of them meets
    in a task, and take neighbouring ranks.  An empty table gives no rows.  Columns other than the
    three named are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        row_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    kinds = cut(rows.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("n")))
    total, most = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, ceil(total / BUCKET_ROWS))

    keyed = kinds.withColumn("key", row_key(F.col("doc_id"), F.col("text_crc32"), F.col("size"), seed))
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("bucket", F.floor(prefix * buckets / (1 << 32)).cast("long"))
    below = _offsets(keyed, ["source"], "bucket", F.sum("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = keyed.withColumn("first", upto - F.col("n")).join(
        below, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    )
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "key", "whole", "n", (F.col("lower") + F.col("first")).alias("first"))
    if most > BUCKET_ROWS:  # the copies of one row are made by several tasks
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BUCKET_ROWS).cast("long")))
        ranked = ranked.select("*", runs.alias("run")).repartition("key", "run")
        ranked = ranked.withColumn("first", F.col("first") + F.col("run")).withColumn(
            "n", F.least(F.col("n") - F.col("run"), F.lit(BUCKET_ROWS))
        )
    copies = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank")
    fraction = (F.col("rank") + source_phase(F.col("source"), seed)) / F.col("whole")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "key", "whole", copies)
    ranked = cut(
        ranked.select("doc_id", "source", "size", "text_crc32", "key", fraction.alias("fraction")).withColumn(
            "bucket", F.floor(F.col("fraction") * buckets).cast("long")
        )
    )
    below = _offsets(ranked, [], "bucket", F.count("*"))
    inside = Window.partitionBy("bucket").orderBy("fraction", "source", "key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("row", F.row_number().over(inside)).join(below, F.col("bucket") == F.col("_bucket"))
    place = (F.col("lower") + F.col("row") - 1).alias("place")
    placed = placed.select("doc_id", "source", "size", "text_crc32", "whole", place)
    shard = F.expr(f"place * {shards} div whole")
    first = F.expr(f"(shard * whole + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"),
    )
