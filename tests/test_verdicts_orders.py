"""Verdicts by hand-computed cases; orders from text to stored report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from octoloom.operators import orders, patches, report, scoring, verdict
from octoloom.plans import attest
from octoloom.sources import orders as order_source
from octoloom.sources.store import ResultStore
from octoloom.streaming import ingest

@pytest.fixture
def stamp(spark):
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


def scores(spark, rows):
    return spark.createDataFrame(rows, "image_name string, patch_id int, p_benign double, p_malevolent double, label int")


def test_inference_and_evaluation_differ(spark):
    s = scores(
        spark,
        [("at", 0, 0.2, 0.75, 0), ("at", 1, 0.6, 0.1, 1), ("bad", 0, 0.1, 0.9, 0), ("bad", 1, 0.1, 0.95, 0), ("tie", 0, 0.5, 0.5, 0)],
    )
    got = {r["image_name"]: (r["class"], r["probability"]) for r in verdict.infer_verdict(s).collect()}
    assert got == {"at": ("benign", pytest.approx(0.4)), "bad": ("malevolent", 0.95), "tie": ("benign", 0.5)}
    rows = verdict.eval_rows(s)
    assert {r["image_name"]: tuple(r)[1:] for r in rows.collect()} == {"at": (1, 1, 0.75), "bad": (0, 1, 0.95), "tie": (0, 0, 0.5)}
    assert verdict.accuracy(rows).first()[0] == pytest.approx(2 / 3)
    m = verdict.metrics(rows).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 0, 1) and m["f1"] == pytest.approx(2 / 3)
    assert verdict.metrics(rows.limit(0)).first()["f1"] == 0


def test_losses_and_weights(spark):
    df = spark.createDataFrame([(0.3, 1.0, 2.0), (-800.0, 1.0, 1.0), (800.0, 0.0, 1.0)], "z double, y double, w double")
    got = [r[0] for r in df.select(verdict.bce_with_logits(F.col("z"), F.col("y"), F.col("w"))).collect()]
    assert got == pytest.approx([2 * np.log1p(np.exp(-0.3)), 800, 800])
    rows = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert tuple(verdict.class_weights(rows).first()) == (1, 3)
    assert tuple(verdict.class_weights(rows.where("label = 0")).first()) == (1, None)
    batches = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 3.0)], "i int, loss double")
    assert verdict.running_loss(batches).first()[0] == pytest.approx(2.5)


def test_scorers_are_pluggable(spark):
    rows = [("i", k, bytes([v]) * 12) for k, v in enumerate((0, 255))]
    df = spark.createDataFrame(rows, "image_name string, patch_id int, patch binary")
    got = scoring.score(df, 2, 2).orderBy("patch_id").collect()
    assert got[0]["p_benign"] > 0.5 > got[0]["p_malevolent"] and got[1]["p_malevolent"] > 0.75
    own = scoring.score(df, 2, 2, lambda p: np.zeros((len(p), 2))).collect()
    assert {r["p_benign"] for r in own} == {0.5}


def test_patch_helpers(spark):
    df = spark.createDataFrame([("a/benign/x.png",)], "p string")
    got = df.select(patches.mask_path(F.col("p")), patches.stem(F.col("p")), patches.label_from_path(F.col("p")), patches.one_hot(F.lit(1))).first()
    assert tuple(got) == ("a/benign/x.mask.png", "x", 0, [0.0, 1.0])
    seven = spark.range(7).select(*patches.split_bounds(F.lit(17), 7, F.col("id"))).collect()
    assert [tuple(r) for r in seven] == [(0, 3), (3, 6), (6, 9), (9, 11), (11, 13), (13, 15), (15, 17)]


COMPOSE = """
services:
  web: {image: "nginx:1.2"}
  db: {image: postgres}
"""
CHART = """
a: {image: {repository: r/a, tag: 1.5}}
b: {image: "r/b:2"}
c: {image: "r/c"}
d: {image: {repository: r/d}}
e: text
"""


def test_orders_are_parsed():
    assert order_source.compose_services(COMPOSE) == [
        {"container_name": "web", "image": "nginx", "tag": "1.2"},
        {"container_name": "db", "image": "postgres", "tag": "latest"},
    ]
    assert [(s["container_name"], s["image"], s["tag"]) for s in order_source.chart_services(CHART)] == [("a", "r/a", "1.5"), ("b", "r/b", "2")]
    assert order_source.compose_services("") == order_source.compose_services("x: 1") == order_source.chart_services(None) == []
    with pytest.raises(ValueError, match="more than one colon"):
        order_source.compose_services('services: {a: {image: "host:5000/a:1"}}')
    with pytest.raises(KeyError):
        order_source.compose_services("services: {a: {build: .}}")
    with pytest.raises(NotImplementedError):
        order_source.parse_services("ini")


def test_a_bad_order_fails_alone(spark, world, stamp):
    archives, stored = world
    bodies = {
        "good": "services: {y: {image: postgres}}",
        "port": 'services: {a: {image: "host:5000/a:1"}}',
        "none": "services: {a: {build: .}}",
        "yaml": "a: [1, {",
        "list": "- a\n- b",
        "text": "just words",
        "empty": "x: 1",
    }
    requests = spark.createDataFrame(list(bodies.items()), "order_id string, body string")
    read = {r["order_id"]: r for r in orders.parsed(requests).collect()}
    assert {k for k, r in read.items() if r["error"]} == {"port", "none", "yaml", "list", "text"}
    assert "more than one colon" in read["port"]["error"] and read["none"]["error"].startswith("KeyError")
    assert orders.services(requests).count() == 1
    hashed = {r["order_id"]: r["h"] for r in requests.select("order_id", orders.content_hash(F.col("body")).alias("h")).collect()}
    made = {r["sa_hash"]: r for r in attest.attest(requests, archives, stored, stamp, **IMAGING).collect()}
    assert {k for k, h in hashed.items() if made[h]["status"] == "completed"} == {"good", "empty"}
    assert {k for k, h in hashed.items() if made[h]["stix_report"]} == {"good", "empty"}


def test_requests_are_checked():
    assert attest.check_request(1, "application/x-yaml", b" a: 1 ") == "a: 1"
    for bad in ((0, "application/yaml", b"a"), (1, "text/html", b"a"), (1, "application/yaml", b" \n")):
        with pytest.raises(ValueError):
            attest.check_request(*bad)


@pytest.fixture(scope="module")
def world(spark):
    bright, dark = bytes([255]) * 4096, bytes(4096)
    archives = spark.createDataFrame(
        [("nginx", "1.2", "n.tar", "h1", bright), ("postgres", "latest", "p.tar", "h2", dark)],
        "image string, tag string, path_to_tar string, hash string, data binary",
    )
    stored = spark.createDataFrame([], "id long, sa_hash string, stix_report string")
    return archives, stored


IMAGING = {"size": 16, "step": None, "patch": 8, "color_map": ("magnitude",)}


def test_attestation_end_to_end(spark, world, stamp, tmp_path):
    archives, stored = world
    gone = "services: {x: {image: nowhere}, y: {image: postgres}}"
    requests = spark.createDataFrame([("o1", COMPOSE), ("o2", f"\n{COMPOSE}  "), ("o3", gone), ("o4", "services: {y: {image: postgres}}")], "order_id string, body string")
    results = attest.attest(requests, archives, stored, stamp, **IMAGING)
    rows = results.collect()
    assert len(rows) == 3
    status = sorted(r["status"] for r in rows)
    assert status == ["completed", "completed", "failed"]
    labels = {}
    for r in rows:
        bundle = json.loads(r["stix_report"])
        ids = {o["id"] for o in bundle["objects"]}
        top = bundle["objects"][0]
        assert bundle["type"] == "bundle" and top["type"] == "report" and set(top["object_refs"]) <= ids
        for o in bundle["objects"]:
            assert set(o.get("object_refs", [])) <= ids and set(o.get("sample_refs", [])) <= ids
        kinds = [o["type"] for o in bundle["objects"]]
        labels[top["labels"][0]] = kinds
        assert kinds.count("file") == kinds.count("observed-data") == kinds.count("grouping")
    assert labels["malevolent"].count("malware") == 1 and labels["malevolent"].count("file") == 2
    assert "malware" not in labels["benign"]
    store = ResultStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert attest.append_results(results, store) == 1
        kept = store.read()
        assert kept.count() == kept.select("id").distinct().count() == 3
    hits = orders.hits(requests.withColumn("sa_hash", orders.content_hash(F.col("body"))), kept)
    assert hits.count() == 4
    assert attest.attest(requests, archives, kept, stamp, **IMAGING).count() == 0
    assert attest.listing(kept).first()[0] == 3
    with pytest.raises(ValueError):
        attest.attest(requests, archives, stored, stamp, area=9)


def test_malware_threshold_is_strict(spark, stamp):
    rows = [("o", f"c{k}", "i", "t", "p", "h", c, p) for k, (c, p) in enumerate([("malevolent", 0.5), ("malevolent", 0.51), ("benign", 0.9)])]
    judged = spark.createDataFrame(rows, "order_id string, container_name string, image string, tag string, path_to_tar string, hash string, class string, probability double")
    got = {r["container_name"]: r["is_malware"] for r in report.service_objects(judged, stamp).collect()}
    assert got == {"c0": False, "c1": True, "c2": False}
    found = [json.loads(x) for r in report.service_objects(judged, stamp).collect() for x in r["objects"]]
    assert [o["confidence"] for o in found if o["type"] == "malware"] == [51]


def test_an_order_without_services_is_benign(spark):
    rows = spark.createDataFrame([("a", "benign"), ("a", "malevolent"), ("b", "benign"), ("c", None)], "order_id string, class string")
    assert {tuple(r) for r in orders.order_label(rows).collect()} == {("a", "malevolent"), ("b", "benign"), ("c", "benign")}


def test_links(spark):
    got = spark.range(1).select(orders.links("http://h/", F.lit(7))).first()[0]
    assert [(x["rel"], x["href"]) for x in got] == [
        ("self", "http://h/attestation/7"),
        ("report", "http://h/attestation/7/report"),
        ("status", "http://h/attestation/7/status"),
    ]


def test_stream_answers_each_order_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in (("a.yaml", COMPOSE), ("b.yml", COMPOSE), ("c.yaml", "services: {}"), ("d.txt", "no")):
        (folder / name).write_text(body)
    seen = []

    def answer(batch, number):
        seen.extend(r["sa_hash"] for r in batch.collect())

    def go():
        stream = ingest.first_seen(ingest.order_stream(spark, str(folder)))
        ingest.run(stream, answer, str(tmp_path / "checkpoint")).awaitTermination(120)

    go()
    assert len(seen) == len(set(seen)) == 2
    (folder / "e.yaml").write_text(COMPOSE)
    (folder / "f.yaml").write_text("services: {q: {image: q}}")
    go()
    assert len(seen) == len(set(seen)) == 3
