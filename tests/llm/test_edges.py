"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns, everywhere."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from octoloom.llm import decontam, fixity, licenses, mixing, pii, quality, sharding, simhash, toxicity, urlfilter

CLASH = (
    "fingerprint fp row_key root size hash of bound times bucket key shard slot quality hits found gaps pseudonyms best "
    "host taken label licenses spans place"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
LONG = " ".join(random.Random(1).choice("abcdefghij") * 3 for _ in range(200_000))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, *["x"] * len(CLASH)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    plain = "Some ordinary words that fill a line of text until there are well over twenty of them so that the base rules do not drop it at all."
    rows = [
        (1, None, "a"),
        (2, "", None),
        (3, " \n\t ", "a"),
        (None, plain, "b"),
        (None, plain, "b"),
        (5, plain, "b"),
        (5, plain, "b"),
        (6, LONG, "c"),
        (7, "word", "c"),
        (8, "two words", None),
    ]
    return make(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word"), (None, "two words"), (3, "word")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


DOC_OPERATORS = {
    "simhash": lambda d, b, lab: simhash.near_duplicates(d),
    "decontam": lambda d, b, lab: decontam.report(d, b),
    "licenses": lambda d, b, lab: licenses.report(d),
    "quality": lambda d, b, lab: quality.report(d, lab),
    "sharding": lambda d, b, lab: sharding.interleave(d),
    "mixing": lambda d, b, lab: mixing.mix(d),
    "toxicity": lambda d, b, lab: toxicity.report(d, lab),
    "pii": lambda d, b, lab: pii.with_pseudonyms(d),
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_odd_rows_each_give_a_row(name, odd, benchmark, labels):
    got = DOC_OPERATORS[name](odd, benchmark, labels)
    ids = sorted(str(r["doc_id"]) for r in got.select("doc_id").collect())
    assert ids == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_empty_tables_give_no_rows(name, none, benchmark, labels):
    assert DOC_OPERATORS[name](none, benchmark.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns_of_documents(spark, stage, odd, none, benchmark, labels, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd, str(tmp_path))
    rows = got.collect()
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == odd.columns
        assert run(spark, none, str(tmp_path)).columns == odd.columns
        assert {r["quality"] for r in rows} <= {"x"}
    assert run(spark, none, str(tmp_path)).count() == 0


def test_keep_one_of_repeated_and_null_ids(odd):
    rows = simhash.keep_one(odd).orderBy("doc_id").collect()
    # 1, 2 and 3 have no words; the four plain texts are one group; its smallest id is 5
    assert [r["doc_id"] for r in rows] == [1, 5, 6, 7, 8]


def test_null_and_empty_texts_are_defined(odd, benchmark, labels):
    by = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect() if r["doc_id"] in (1, 2, 3, 5)}
    assert {by[k]["fingerprint"] for k in (1, 2, 3)} == {"0" * 16}
    assert {by[k]["component_id"] for k in (1, 2, 3)} == {1}
    assert by[5]["component_id"] == 5
    hits = {r["doc_id"]: r for r in decontam.report(odd, benchmark).collect()}
    assert (hits[1]["n_words"], hits[1]["n_hit"], hits[1]["contaminated"]) == (0, 0, False)
    assert (hits[7]["n_hit"], hits[7]["n_items"]) == (1, 1)
    assert (hits[8]["n_hit"], hits[8]["n_items"], hits[8]["contaminated"]) == (2, 1, True)
    counted = {r["doc_id"]: r for r in quality.report(odd, labels).collect()}
    assert counted[1]["n_words"] == 0 and counted[1]["base_failed"]
    assert counted[6]["n_words"] == 200_000
    sized = {r["doc_id"]: r for r in sharding.interleave(odd).collect()}
    assert sized[1]["size"] == 1 and sized[1]["text_crc32"] == 0
    assert {r["size"] for r in mixing.mix(odd).where("doc_id in (1, 2, 3)").collect()} == {0}
    changed = {r["doc_id"]: r for r in pii.with_pseudonyms(odd).collect()}
    assert changed[1]["text"] is None and changed[2]["text"] == ""


def test_pages_with_nulls_repeats_and_clashes(spark):
    schema = "page_id long, url string, html string, host string, path string, verdict string, best string, record string"
    rows = [(1, None, None), (None, "x", ""), (3, "http://A.com/en/1", "a"), (3, "http://A.com/en/1", "a"), (4, "", "b" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    got = urlfilter.judge(pages).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "3", "3", "4", "None"]
    assert {(r["host"], r["rule"], r["verdict"]) for r in got} == {("", None, "allow"), ("a.com", "com/en/", "block")}
    assert urlfilter.judge(pages.limit(0)).count() == 0
    laid_out = fixity.lay_out(fixity.warc_records(pages))
    assert laid_out.count() == 5
    leaves = laid_out.select("file", "offset", "length", "sha256")
    assert fixity.audit(leaves, leaves).count() == 0
    empty = fixity.lay_out(fixity.warc_records(pages.limit(0)))
    assert fixity.audit(empty, empty).count() == 0
    lost = fixity.audit(laid_out, empty).select("status", F.col("length")).collect()
    assert len(lost) == 5 and {r["status"] for r in lost} == {"missing"}
