"""Batches that go to Python stay below their bound."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from octoloom.functions.batches import BATCH_BYTES, bounded
from octoloom.operators import entropy, patches, sampling
from octoloom.plans import catalog
from octoloom.sources.blobs import chunks

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@F.arrow_udf(T.LongType())
def batch_bytes(data: pa.Array) -> pa.Array:
    return pa.array([data.nbytes] * len(data), pa.int64())


@pytest.fixture
def unbound(spark):
    before = spark.conf.get(NAME)
    spark.conf.unset(NAME)
    yield spark
    spark.conf.set(NAME, before)


def _largest(spark, rows=400, size=100_000):
    texts = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), size).alias("text"))
    return texts.select(batch_bytes("text").alias("n")).agg(F.max("n")).first()[0]


def test_batches_are_bounded_and_a_bound_that_was_chosen_stays(unbound):
    bounded(unbound)
    assert 100_000 <= _largest(unbound) <= BATCH_BYTES + 200_000
    assert _largest(unbound, 3, 3 * BATCH_BYTES) <= 3 * BATCH_BYTES + 1_000
    unbound.conf.set(NAME, "1000000")
    bounded(unbound)
    assert unbound.conf.get(NAME) == "1000000"


def test_stages_of_the_pipeline_bound_their_batches(unbound, small):
    corpus_pipeline.keep_distinct(unbound, unbound.read.parquet(f"{small}/documents.parquet"), str(small))
    assert _largest(unbound) <= BATCH_BYTES + 200_000


@pytest.mark.parametrize("name", ["chunk_structure", "entropy_colours", "training_patches"])
def test_catalog_queries_bound_their_batches(unbound, small, name):
    catalog.QUERIES[name](unbound, str(small))
    assert _largest(unbound) <= BATCH_BYTES + 200_000


def _python_steps(df):
    return len(re.findall(r"(?m)^[ :+-]*(?:\*\(\d+\) )?(?:\w*EvalPython|\w+InArrow|\w+InPandas)\b", df._jdf.queryExecution().sparkPlan().toString()))


def test_entropies_take_one_worker_a_task(spark, small):
    """Samples and entropies come of one function, which no filter repeats; of chunks, each side of the shuffle has one."""
    assert _python_steps(catalog.QUERIES["entropy_colours"](spark, str(small))) == 1
    assert _python_steps(catalog.QUERIES["window_entropy"](spark, str(small))) == 1
    assert _python_steps(catalog.QUERIES["chunk_entropy"](spark, str(small))) == 2


def test_patches_and_labels_take_one_worker_a_task(spark):
    """Masks were cut by one function and looked at by another above it, in the same task."""
    masks = spark.createDataFrame([("a", 5, 4, bytes(24) + b"\x01" + bytes(35)), ("b", 4, 4, bytes(48)), ("c", 1, 1, b"abc")], "image_name string, width int, height int, data binary")
    labels = patches.mask_labels(masks, 2, 2)
    assert _python_steps(labels) == 1 and dict(labels.dtypes)["label"] == "int"
    marked = {(r["image_name"], r["patch_id"]) for r in patches.cut_patches(masks, 2, 2).collect() if any(r["patch"])}
    got = {(r["image_name"], r["patch_id"]): r["label"] for r in labels.collect()}
    assert len(got) == 8 and {k for k, v in got.items() if v} == marked and len(marked) == 1


def test_images_are_drawn_only_where_they_are_looked_at(spark, small):
    """Sides that need names and labels alone do not draw: one drawing of images, one of masks, two cuts."""
    assert _python_steps(catalog.QUERIES["training_patches"](spark, str(small))) == 4


@pytest.mark.parametrize("pixels", [1, 50, 64, 1_000])
def test_pixels_are_handed_on_in_small_batches(spark, monkeypatch, pixels):
    monkeypatch.setattr(entropy, "BATCH_PIXELS", pixels)
    blobs = spark.createDataFrame([("a", b"abcabc" * 30), ("b", b"z"), ("c", b""), (None, bytes(range(256)))], "blob_id string, data binary")
    for layout in ("square", "unrolled", "unrolled_n"):
        found = entropy.blob_entropy(blobs, 8, layout).collect()
        expected = sampling.grid(blobs, 8, layout).collect()
        assert sorted(map(str, expected)) == sorted(str(r)[: str(r).index(", entropy")] + ")" for r in found)


@pytest.mark.parametrize("layout", ["square", "unrolled", "unrolled_n"])
def test_windows_in_short_stretches_equal_the_grid(spark, monkeypatch, layout):
    monkeypatch.setattr(sampling, "RUN_PIXELS", 3)
    texts = [b"", b"a", bytes(range(256)) * 3, b"xyz" * 40]
    blobs = spark.createDataFrame(list(enumerate(texts)), "blob_id int, data binary")
    for curve in ("hilbert", "zigzag"):
        all_pixels = sampling.place(sampling.grid(blobs, 8, layout), 8, curve).where("b is not null")
        expected = sorted(map(tuple, all_pixels.where("x between 2 and 7 and y between 3 and 11").collect()))
        for given in (blobs, chunks(blobs, 50)):
            got = sampling.window(given, 8, 2, 3, 6, 9, curve, layout)
            assert got.columns == all_pixels.columns and sorted(map(tuple, got.collect())) == expected
