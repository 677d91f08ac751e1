"""PNG files there and back, training patches, evaluation files."""

import numpy as np
import pytest

from octoloom.operators import patches
from octoloom.plans import imaging
from octoloom.sources import evaluation, images

SCHEMA = "image_name string, width int, height int, data binary"


def test_png_round_trip_through_sparks_reader(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"i{k}", 7, 5, rng.integers(0, 256, 105, np.uint8).tobytes()) for k in range(3)]
    assert images.write_pngs(spark.createDataFrame(rows, SCHEMA), str(tmp_path)) == 3
    got = images.read_images(spark, str(tmp_path)).select("image_name", "width", "height", "data").collect()
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in got) == rows


def test_rendered_quads_can_be_written(spark, tmp_path):
    blobs = spark.createDataFrame([("b", bytes(range(256)))], "blob_id string, data binary")
    quads = imaging.render_quads(blobs, 8).selectExpr("concat(blob_id, '-', quad) AS image_name", "8 AS width", "8 AS height", "image AS data")
    assert images.write_pngs(quads, str(tmp_path)) == 4
    assert images.read_images(spark, str(tmp_path)).count() == 4


def test_checksums_of_runs_are_combined():
    import zlib

    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (7, 0), (1, 1), (70_000, 66_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert images.adler_of_both(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


def test_images_written_by_quads_are_read_by_any_reader(spark, tmp_path):
    rng = np.random.default_rng(4)
    shapes = {"one": 1, "five": 5, "sub/deep": 2}
    rows = [(n, k, rng.integers(0, 256, 8 * 8 * 3, np.uint8).tobytes()) for n, count in shapes.items() for k in range(count)]
    quads = spark.createDataFrame(rows, "image_name string, quad long, image binary").repartition(5)
    images.write_quads(quads, 8, str(tmp_path))
    got = {r["path"].split(str(tmp_path) + "/")[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {f"{n}.png" for n in shapes}
    for name, count in shapes.items():
        r = got[f"{name}.png"]
        assert (r["width"], r["height"]) == (8, 8 * count)
        assert bytes(r["data"]) == b"".join(d for n, _, d in rows if n == name)
    assert not list(tmp_path.glob(".staged*"))
    images.write_quads(quads.limit(0), 8, str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    good = [(f"i{k}", 0, bytes(192)) for k in range(4)]
    quads = spark.createDataFrame([*good, ("bad", 0, bytes(192)), ("bad", 1, bytes(5))], "image_name string, quad long, image binary")
    with pytest.raises(Exception, match="reshape"):
        images.write_quads(quads, 8, str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    images.write_quads(quads.where(F.col("image_name") != "bad"), 8, str(tmp_path))
    assert sorted(p.name for p in tmp_path.glob("*.png")) == [f"i{k}.png" for k in range(4)]


def test_training_patches(spark):
    plain, mark = bytes(4 * 4 * 3), np.zeros((4, 4, 3), np.uint8)
    mark[3, 0] = 255
    shown = spark.createDataFrame([("good", 4, 4, plain, 0), ("bad", 4, 4, plain, 1), ("bare", 4, 4, plain, 1)], SCHEMA + ", label int")
    masks = spark.createDataFrame([("good", 4, 4, mark.tobytes()), ("bad", 4, 4, mark.tobytes())], SCHEMA)
    got = {(r["image_name"], r["patch_id"]): r["label"] for r in patches.training_patches(shown, masks, 2, 2).collect()}
    assert [got["good", k] for k in range(4)] == [0] * 4
    assert [got["bad", k] for k in range(4)] == [0, 0, 1, 0]
    assert [got["bare", k] for k in range(4)] == [1] * 4


def test_evaluation_files(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 1, 0, 0.25), ("c", 0, 0, 0.5)], evaluation.SCHEMA)
    base = str(tmp_path / "eval.csv")
    assert evaluation.write_evaluation(rows, base, "test").endswith("eval_test.csv")
    got = evaluation.read_evaluation(spark, base, "test").orderBy("image_name").collect()
    assert [tuple(r) for r in got] == [("a,b", 1, 0, 0.25), ("c", 0, 0, 0.5)]


def test_shuffle_is_seeded(spark):
    rows = spark.range(50)
    first, again, other = (
        [r[0] for r in patches.shuffled(rows, s).collect()] for s in (1, 1, 2)
    )
    assert first == again != other and sorted(first) == list(range(50))


@pytest.mark.parametrize("buffer", [1, 7, 100, 5_000])
def test_buffered_shuffle(spark, buffer):
    """Each row once, one order a seed whatever the batches, no exchange, and no row far ahead of its place."""
    rows = spark.range(0, 1_003, 1, 3).selectExpr("id", "cast(id as string) AS text")

    def order(seed):
        return [r["id"] for r in patches.buffered(rows, seed, buffer).collect()]

    first = order(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        again = order(1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert first == again and sorted(first) == list(range(1_003))
    if buffer > 1:
        assert first != list(range(1_003)) and first != order(2)
    third = 1_003 // 3
    for part in range(3):
        own = [i for i in first if part * third <= i < (part + 1) * third]
        assert all(i - part * third - at < 2 * buffer for at, i in enumerate(own))
    plan = patches.buffered(rows, 1, buffer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert patches.buffered(rows.limit(0), 1, buffer).count() == 0
    with pytest.raises(ValueError, match="buffer"):
        patches.buffered(rows, 1, 0)


def test_normalise(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(patches.normalised(F.lit(255), 0.5, 0.25)).first()[0] == pytest.approx(2)


def test_sources_of_patches_hold_the_same_patches(spark):
    data = [bytes(range(48)), bytes(range(48, 96))]
    shown = spark.createDataFrame([(f"i{k}", 4, 4, d, k) for k, d in enumerate(data)], f"{SCHEMA}, label int")
    masks = spark.createDataFrame([("i1", 4, 4, bytes(12) + bytes([1] * 36))], SCHEMA)
    train = [tuple(r) for r in patches.training_source(shown, masks, 2, 2, 7).collect()]
    again = [tuple(r) for r in patches.training_source(shown, masks, 2, 2, 7).collect()]
    valid = [tuple(r) for r in patches.validation_source(shown, masks, 2, 2).collect()]
    infer = [tuple(r) for r in patches.inference_source(shown, 2, 2).collect()]
    mixed = [tuple(r) for r in patches.training_source(shown, masks, 2, 2, 7, buffer=3).collect()]
    assert sorted(train) == sorted(again) == sorted(valid) == sorted(mixed) and len(valid) == 8
    assert sorted(r[:3] for r in valid) == sorted(infer)
    planes = spark.createDataFrame([(bytes([1, 2, 3, 4, 5, 6]),), (b"",), (None,)], "p binary").select(patches.planes("p")).collect()
    assert [r[0] for r in planes] == [[1, 4, 2, 5, 3, 6], [], None]
