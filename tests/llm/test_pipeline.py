"""Each stage of the pipeline against the operator's own report on the same input."""

import corpus_pipeline
import pytest

from octoloom.llm import decontam, mixing, quality, simhash
from octoloom.llm.common import cut


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, small))
        out[name] = before, docs
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows.select("doc_id").collect())


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "stratified_shards",
    ]


def test_quality_stage(spark, small, stages):
    before, after = stages["quality_rules"]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert ids(after) == ids(quality.report(before, labels).where("kept"))
    assert after.columns == before.columns


def test_dedup_stage_keeps_the_smallest_of_each_group(stages):
    before, after = stages["simhash_near_dedup"]
    assert ids(after) == sorted({r[0] for r in simhash.near_duplicates(before).select("component_id").collect()})
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before.join(after.select("doc_id"), "doc_id", "left_semi").collect()))


def test_decontamination_stage(spark, small, stages):
    before, after = stages["benchmark_decontamination"]
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids(after) == ids(decontam.report(before, benchmark).where("not contaminated"))


def test_mixing_stage_repeats_rows(stages):
    before, after = stages["source_mix"]
    expected = sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["passes"]))
    assert ids(after) == expected


def test_run_shards_all_that_was_mixed(spark, small, stages):
    mixed, _ = stages["source_mix"][1], None
    rows = corpus_pipeline.run(spark, small).toPandas()
    assert sorted(rows["doc_id"]) == ids(mixed)
    counts = rows.groupby("shard").size()
    assert counts.max() - counts.min() <= 1
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
