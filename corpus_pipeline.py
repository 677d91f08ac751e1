"""From raw documents to shards: quality rules, near-dedup, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Stages run over everything that
the stage before kept; each is written as Parquet and read again.  Columns of ``docs`` may have any
names besides those that a stage reads, names that a stage uses inside itself too; an empty table
stays empty with its columns.  Texts of any length are read whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from octoloom.functions.batches import bounded
from octoloom.llm import decontam, mixing, quality, sharding, simhash
from octoloom.llm.common import drop_cut, fresh, settled, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier.

    Null and empty texts fail the base rules; repeated rows are judged alike; a probability of just
    ``KEEP_FROM`` is kept.  Without labels of both classes the base rules decide alone.
    """
    bounded(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "quality")
    return quality.with_quality(docs, model, name).where(quality.kept(name)).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id.

    Null ids come last; of rows tied in everything any one stays.  Null and wordless texts are one group.
    """
    bounded(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages that make up a twentieth of their words; just that much is too much.

    Null and empty texts have no words and stay; repeated rows are judged alike; null and empty items
    hit nothing.
    """
    bounded(spark)
    name = fresh(docs, "hits")
    hits = decontam.find_hits(docs, table(spark, sf_dir, "benchmark"), keep=True, name=name)
    return hits.where(~decontam.contaminated(name)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: never, once or twice.

    Null and empty texts have no words and cost nothing; null sources are one source; rows equal in id
    and text are taken together.
    """
    return mixing.resample(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of the mixture.

    Null and empty texts have size 1; null sources are one source; equal rows are interchangeable.
    """
    return sharding.interleave(docs).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_distinct),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("stratified_shards", cut_shards),
]

#: The fitted classifier and XXH64 fingerprints have no DuckDB form; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before wrote is deleted as soon as it has been read."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, settled(spark, partial(stage, spark, docs, sf_dir))
        drop_cut(before)
    return docs
