"""Colours and curves by their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from octoloom.functions import bytes as B
from octoloom.operators import colours, layout
from octoloom.sources.blobs import chunks


def expected_class(b):
    return 0 if b == 0 else 255 if b == 255 else 55 if 9 <= b <= 13 or 32 <= b <= 126 else 228


INPUTS = [bytes(range(32)), bytes(range(64)), bytes(range(256)), b"abcdefgh"]


@pytest.mark.parametrize("data", INPUTS, ids=len)
def test_both_grains_follow_the_class_rule(spark, data):
    df = spark.createDataFrame([(data,)], "data binary")
    rows = df.select(F.posexplode(F.sequence(F.lit(0), F.lit(len(data) - 1))).alias("p", "i"), "data")
    b = B.byte_at(F.col("data"), F.col("i"))
    got = rows.select("i", b.alias("b"), B.class_grey(b).alias("grey"), B.class_rgb(b).alias("rgb")).orderBy("i").collect()
    assert [r["b"] for r in got] == list(data)
    assert [r["grey"] for r in got] == [expected_class(v) for v in data]
    palette = dict(zip(B.CLASS_GREY, B.CLASS_RGB, strict=True))
    assert [tuple(r["rgb"]) for r in got] == [palette[expected_class(v)] for v in data]
    for kind, rule in (("class", expected_class), ("magnitude", int)):
        assert list(df.select(B.chunk_colours(F.col("data"), kind)).first()[0]) == [rule(v) for v in data]
    counted = df.select(B.class_counts("data")).first()[0]
    assert [counted[k] for k in ("zero", "full", "text", "other")] == [sum(expected_class(v) == c for v in data) for c in B.CLASS_GREY]


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024])
def test_chunk_colours_keep_the_length(spark, n):
    data = bytes(i % 256 for i in range(n))
    df = spark.createDataFrame([(data,)], "data binary")
    assert len(df.select(B.chunk_colours(F.col("data"), "class")).first()[0]) == n


def test_byte_past_the_end_is_null(spark):
    assert spark.createDataFrame([(b"a",)], "data binary").select(B.byte_at(F.col("data"), F.lit(1))).first()[0] is None


def test_unknown_names_are_errors():
    with pytest.raises(NotImplementedError):
        colours.grey("hilbert", None)
    with pytest.raises(NotImplementedError):
        layout.positions("peano", 4)
    with pytest.raises(ValueError):
        layout.positions("hilbert", 6)
    with pytest.raises(ValueError):
        layout.check_size(0)
    with pytest.raises(ValueError):
        colours.mix([])


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16, 32])
def test_hilbert_walks_the_square_in_unit_steps(size):
    at = layout.positions("hilbert", size)
    assert len({tuple(p) for p in at}) == size * size and at.min() == 0 and at.max() == size - 1
    assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


def test_hilbert_starts_as_published():
    assert layout.positions("hilbert", 8)[:4].tolist() == [[0, 0], [1, 0], [1, 1], [0, 1]]
    assert layout.positions("hilbert", 4)[:4].tolist() == [[0, 0], [0, 1], [1, 1], [1, 0]]


@pytest.mark.parametrize(("name", "size"), [("hilbert", 8), ("hilbert", 16), ("zigzag", 8), ("zigzag", 5)])
def test_table_and_kernel_agree(spark, name, size):
    table = layout.layout_table(spark, name, size).orderBy("d").collect()
    assert [[r["x"], r["y"]] for r in table] == layout.positions(name, size).tolist()


def test_mixer(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    a, b, c, d = (F.col(k) for k in "abcd")
    mixes = [[a], [a, b], [a, b, c], [a, b, c, d]]
    got = df.select(*[colours.mix(m).alias(str(k)) for k, m in enumerate(mixes)]).first()
    assert [tuple(x) for x in got] == [(1, 1, 1), (1, 2, 0), (1, 2, 3), (1, 2, 3)]


def test_lengths_must_match(spark):
    df = spark.createDataFrame([(b"ab", b"cd", b"e")], "a binary, b binary, c binary")
    assert df.select(colours.same_length(F.col("a"), F.col("b"))).first()[0]
    with pytest.raises(Exception, match="differ in length"):
        df.select(colours.same_length(F.col("a"), F.col("c"))).collect()


@pytest.mark.parametrize(("spec", "rgb"), [("ff0080", (1, 0, 128 / 255)), ("xyz", (1, 0, 0)), (None, (1, 0, 0))])
def test_hex_colours(spark, spec, rgb):
    got = spark.createDataFrame([(spec,)], "s string").select(B.hex_colour(F.col("s"))).first()[0]
    assert tuple(got) == pytest.approx(rgb)


def test_entropy_curve(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double").select(B.entropy_curve(F.col("v"))).collect()
    assert [r[0] for r in got] == [0, 1, 0]


def test_chunks_join_to_the_blob(spark):
    data = bytes(i % 251 for i in range(1000))
    blobs = spark.createDataFrame([("a", data), ("b", b""), ("c", b"x" * 256)], "blob_id string, data binary")
    rows = chunks(blobs, 256).orderBy("blob_id", "chunk_id").collect()
    assert b"".join(bytes(r["data"]) for r in rows if r["blob_id"] == "a") == data
    assert [r["byte_start"] for r in rows if r["blob_id"] == "a"] == [0, 256, 512, 768]
    assert [r["blob_id"] for r in rows] == ["a"] * 4 + ["c"]


@pytest.mark.parametrize("size", [1, 2, 8, 32])
def test_hilbert_index_undoes_the_curve(spark, size):
    rows = layout.layout_table(spark, "hilbert", size)
    back = rows.select("d", layout.hilbert_index(F.col("x"), F.col("y"), size).alias("back"))
    assert back.where("d != back").count() == 0 and rows.count() == size * size


@pytest.mark.parametrize("name", ["hilbert", "zigzag"])
def test_windows_are_few_runs_of_the_curve(name):
    size, at = 64, {}
    for d, (x, y) in enumerate(layout.positions(name, 64).tolist()):
        at[d] = (x, y)
    for x, y, w, h in [(0, 0, 64, 64), (0, 0, 1, 1), (63, 63, 1, 1), (5, 7, 20, 31), (32, 0, 32, 32), (-4, -4, 9, 9), (60, 60, 9, 9), (9, 9, 0, 3), (70, 0, 3, 3)]:
        runs = layout.window_ranges(name, size, x, y, w, h)
        covered = [d for a, b in runs for d in range(a, b)]
        assert covered == sorted(d for d, (p, q) in at.items() if x <= p < x + w and y <= q < y + h)
        assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False)) or name == "zigzag"
    assert len(layout.window_ranges("hilbert", 1024, 256, 512, 256, 256)) == 1
    assert len(layout.window_ranges("hilbert", 1024, 100, 100, 500, 500)) < 4 * 500
