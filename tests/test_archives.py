"""Tar members, structure colours, spans and masks, and the file sources."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from octoloom.operators import spans
from octoloom.plans import imaging
from octoloom.sources import blobs as B
from octoloom.sources import tars


def build(entries, fmt=tarfile.PAX_FORMAT, **options):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt, **options) as archive:
        for name, kind, data in entries:
            info = tarfile.TarInfo(name)
            info.type, info.size = kind, len(data)
            info.linkname = "a.txt" if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE) else ""
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


ARCHIVES = {
    "one": build([("a.txt", tarfile.REGTYPE, b"hello")]),
    "kinds": build(
        [
            ("a.txt", tarfile.REGTYPE, b"x" * 700),
            ("dir", tarfile.DIRTYPE, b""),
            ("link", tarfile.SYMTYPE, b""),
            ("hard", tarfile.LNKTYPE, b""),
            ("/b.bin", tarfile.REGTYPE, b"\0" * 512),
            ("c", tarfile.REGTYPE, b""),
        ],
        fmt=tarfile.USTAR_FORMAT,
    ),
    "long": build([("p/" + "n" * 150, tarfile.REGTYPE, b"z" * 10), ("q", tarfile.REGTYPE, b"zz")]),
    "global": build([("a.txt", tarfile.REGTYPE, b"hello")], pax_headers={"comment": "about all"}),
    "empty": build([]),
}


@pytest.fixture(scope="module")
def archives(spark):
    return spark.createDataFrame(list(ARCHIVES.items()), "blob_id string, data binary").cache()


def plain_structure(data):
    out = [0] * len(data)
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        for k, m in enumerate(archive.getmembers()):
            header = {"0": 155, "1": 140, "2": 125, "5": 75}[m.type.decode()]
            out[m.offset : m.offset_data] = [header] * (m.offset_data - m.offset)
            size = m.size if m.isreg() else 0
            out[m.offset_data : m.offset_data + size] = [(255, 230, 205, 180)[k % 4]] * size
    return out


def test_members_are_those_of_the_archive(archives):
    for r in tars.members(archives).collect():
        with tarfile.open(fileobj=io.BytesIO(ARCHIVES[r["blob_id"]])) as archive:
            m = archive.getmembers()[r["member_idx"]]
        assert (r["name"], r["type"], r["offset"], r["offset_data"]) == (m.name, m.type.decode(), m.offset, m.offset_data)


def test_a_text_is_no_archive(spark):
    df = spark.createDataFrame([(1, b"plain text"), (2, ARCHIVES["one"])], "blob_id int, data binary")
    assert [r[0] for r in df.orderBy("blob_id").select(tars.is_tar("data")).collect()] == [False, True]
    with pytest.raises(Exception, match="not a tar archive"):
        tars.members(df).collect()


@pytest.mark.parametrize("block", [512, 65_536])
def test_structure_colours_every_byte(archives, block):
    points = archives.select("blob_id", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("byte_idx"))
    got = {}
    for r in spans.structure(points, tars.members(archives), block).collect():
        got.setdefault(r["blob_id"], {})[r["byte_idx"]] = r["structure"]
    for name, data in ARCHIVES.items():
        assert [got[name][i] for i in range(len(data))] == plain_structure(data)


def test_structure_as_a_channel(archives):
    rows = imaging.render(archives.where("blob_id = 'kinds'"), 64, ("class", "magnitude", "structure"), members=tars.members(archives), layout_type="unrolled_n")
    expected = plain_structure(ARCHIVES["kinds"])
    got = {r["quad"] * 4096 + r["j"]: r["b"] for r in rows.collect()}
    assert [got[i] for i in range(len(expected))] == expected


def test_masks_take_any_spans(spark):
    blobs = spark.createDataFrame([("a", bytes(300)), ("b", bytes(100))], "blob_id string, data binary")
    marked = [("a", 250, 300), ("a", 10, 20), ("a", 15, 40), ("a", 40, 41), ("a", 60, 60), ("b", 0, 100)]
    spanned = spark.createDataFrame(marked, "blob_id string, span_start long, span_end long")
    points = blobs.select("blob_id", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("data").cast("long") - 1)).alias("byte_idx"))
    for block in (16, 65_536):
        rows = spans.mask(points, spanned, block).collect()
        assert len(rows) == 400
        for r in rows:
            inside = any(b == r["blob_id"] and s <= r["byte_idx"] < e for b, s, e in marked)
            assert r["mask"] == (255 if inside else 0)
    merged = sorted(tuple(r) for r in spans.merge_spans(spanned).collect())
    assert merged == [("a", 10, 41), ("a", 250, 300), ("b", 0, 100)]
    assert spans.mask(points, spanned.limit(0)).agg(F.max("mask")).first()[0] == 0


@pytest.mark.parametrize("block", [1, 16, 65_536])
def test_ranges_of_any_length_overlapping_at_terabytes(spark, block):
    """Lengths from one byte to terabytes, nested and overlapping, with points at every edge; a range is filed twice at most."""
    rng = random.Random(block)
    top = 1 << 45
    members = []
    for k in range(60):
        offset = rng.choice([0, 5, 65_536, top - 100_000, rng.randrange(top)])
        size = rng.choice([0, 1, 17, 65_535, 65_536, 65_537, 1 << 20, (1 << 30) + 3, 100 << 30, rng.randrange(top)])
        members.append((rng.choice("ab"), k, rng.choice("05x"), offset, offset + 512, size))
    frame = spark.createDataFrame(members, "blob_id string, member_idx int, type string, offset long, offset_data long, size long")
    edges = {e + d for _, _, _, o, a, n in members for e in (o, a, a + n) for d in (-1, 0, 1) if e + d >= 0}
    points = [(b, i) for b in "abc" for i in sorted(edges | {rng.randrange(top) for _ in range(200)})]
    colours = {"0": 155, "5": 75, "x": 15}

    def plain(blob, i):
        held = [
            (k, start, c)
            for b, k, t, o, a, n in members
            for start, end, c in ((o, a, colours[t]), (a, a + n, (255, 230, 205, 180)[k % 4]))
            if b == blob and start <= i < end
        ]
        return max(held)[2] if held else 0

    at = spark.createDataFrame(points, "blob_id string, byte_idx long")
    found = {tuple(r)[:2]: r["structure"] for r in spans.structure(at, frame, block).collect()}
    assert found == {p: plain(*p) for p in points}
    marked = frame.select("blob_id", F.col("offset").alias("span_start"), (F.col("offset_data") + F.col("size")).alias("span_end"))
    masked = {tuple(r)[:2]: r["mask"] for r in spans.mask(at, marked, block).collect()}
    assert masked == {p: 255 if plain(*p) else 0 for p in points}
    ranges = spans.structure_ranges(frame)
    filed = spans.file_ranges(ranges, "range_start", "range_end", block)
    assert filed.count() <= 2 * ranges.count()
    assert filed.select("_level").distinct().count() <= 13


def test_levels_by_length(spark):
    lengths = [1, 16, 17, 256, 257, 1 << 40, (1 << 62) + 1]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    assert [r[0] for r in df.select(spans.level_of(F.col("n"), 16)).collect()] == [4, 4, 8, 8, 12, 40, 62]
    with pytest.raises(ValueError, match="power of two"):
        spans.level_of(F.col("n"), 100)


@pytest.mark.parametrize("bad", [(0, 101), (-1, 5), (9, 3)])
def test_spans_outside_the_blob_are_errors(spark, bad):
    blobs = spark.createDataFrame([("a", bytes(100))], "blob_id string, data binary")
    with pytest.raises(Exception, match="span outside"):
        imaging.render_mask(blobs, spark.createDataFrame([("a", *bad)], "blob_id string, span_start long, span_end long"), 8).collect()


def test_metadata_to_spans(spark, archives, tmp_path):
    records = [
        {"name": "1", "path": "kinds", "label": "malevolent", "diffs": {"Adds": [{"Name": "/b.bin", "Size": 1}], "Dels": [{"Name": "/c", "Size": 1}], "Mods": None}},
        {"name": "2", "path": "one", "label": "failed", "diffs": {"Adds": [{"Name": "/a.txt", "Size": 1}], "Dels": None, "Mods": None}},
        {"name": "3", "path": "long", "label": None, "diffs": None},
    ]
    for r in records:
        (tmp_path / f"{r['name']}.json").write_text(json.dumps(r, indent=1))
    usable = spans.usable(tars.read_metadata(spark, str(tmp_path)))
    assert sorted(r["name"] for r in usable.collect()) == ["1", "3"]
    files = spans.changed_files(usable).withColumnRenamed("path", "blob_id")
    found = spans.spans_of_files(tars.members(archives), files).collect()
    with tarfile.open(fileobj=io.BytesIO(ARCHIVES["kinds"])) as archive:
        m = archive.getmember("/b.bin") if "/b.bin" in archive.getnames() else archive.getmember("b.bin")
    assert [tuple(r) for r in found] == [("kinds", m.offset, m.offset_data + 512)]


def test_file_sources(spark, tmp_path):
    data = bytes(i % 251 for i in range(5000))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.tar").write_bytes(ARCHIVES["one"])
    (tmp_path / "empty").write_bytes(b"")
    assert [r["n_bytes"] for r in B.read_blobs(spark, str(tmp_path), "*.tar").collect()] == [len(ARCHIVES["one"])]
    rows = B.read_chunks(spark, str(tmp_path), 512).orderBy("blob_id", "chunk_id").collect()
    assert b"".join(bytes(r["data"]) for r in rows if r["blob_id"].endswith("a.bin")) == data
    assert all(r["byte_start"] == r["chunk_id"] * 512 for r in rows)
    whole = B.chunks(B.read_blobs(spark, str(tmp_path), "a.bin"), 512).orderBy("chunk_id").collect()
    assert [bytes(r["data"]) for r in whole] == [bytes(r["data"]) for r in rows if r["blob_id"].endswith("a.bin")]


def test_shards_by_split(spark, tmp_path):
    for split in ("train", "test"):
        for k in range(2):
            samples = [(f"{split}{k}-{n}{part}", tarfile.REGTYPE, body) for n in range(2) for part, body in ((".png", b"p"), (".mask.png", b"m"), (".json", json.dumps({"name": f"i{n}", "label": "benign"}).encode()))]
            (tmp_path / f"{split}-{k}.tar").write_bytes(build([*samples, (f"{split}-odd.png", tarfile.REGTYPE, b"p")]))
    assert tars.read_shards(spark, str(tmp_path)).count() == 8
    rows = tars.read_shards(spark, str(tmp_path), "train").collect()
    assert {r["shard"] for r in rows} == {"train-0.tar", "train-1.tar"} and len(rows) == 4
    named = tars.read_shards(spark, str(tmp_path)).where("shard like '%test%'")
    assert named.count() == 4 and named.where("shard = 'test-1.tar'").count() == 2
    assert {(bytes(r["png"]), bytes(r["mask"]), r["label"]) for r in rows} == {(b"p", b"m", "benign")}
    orders = {seed: [r["shard"] for r in tars.read_shards(spark, str(tmp_path), seed=seed).collect()] for seed in range(8)}
    assert len({tuple(o) for o in orders.values()}) > 1 and all(sorted(o) == sorted(orders[0]) for o in orders.values())
    assert orders[3] == [r["shard"] for r in tars.read_shards(spark, str(tmp_path), seed=3).collect()]


def test_json_split_and_image_folder(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps([{"name": "x", "label": "benign"}, {"name": "y", "label": "bad"}]))
    rows = tars.read_split(spark, str(tmp_path / "split.json"), "/img/").orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("/img/x.png", 0), ("/img/y.png", 1)]
    for folder in ("benign", "other"):
        (tmp_path / "img" / folder).mkdir(parents=True)
        (tmp_path / "img" / folder / "a.png").write_bytes(b"1")
        (tmp_path / "img" / folder / "a.mask.png").write_bytes(b"2")
    got = tars.read_image_dir(spark, str(tmp_path / "img")).collect()
    assert sorted(r["label"] for r in got) == [0, 1]


def test_members_are_read_by_their_headers(spark, tmp_path):
    path = tmp_path / "a.tar"
    sizes = [0, 1, 512, 70_000]
    with tarfile.open(path, "w") as archive:
        for k, size in enumerate(sizes):
            info = tarfile.TarInfo("n" * 150 + str(k) if k == 2 else f"f{k}")
            info.size = size
            archive.addfile(info, io.BytesIO(bytes(size)))
    (tmp_path / "b.txt").write_text("no archive")
    rows = tars.read_members(spark, str(tmp_path)).orderBy("member_idx").collect()
    whole = tars.members(B.read_blobs(spark, str(tmp_path), "*.tar")).orderBy("member_idx").collect()
    assert [r["size"] for r in rows] == sizes and all(r["blob_id"].endswith("a.tar") for r in rows)
    assert [tuple(r)[1:] for r in rows] == [tuple(r)[1:] for r in whole]
