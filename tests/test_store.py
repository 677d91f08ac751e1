"""Results committed by several writers."""

import threading

import pytest
from pyspark.sql import functions as F

from octoloom.operators import orders
from octoloom.sources.store import ResultStore


def results(spark, names, by="w"):
    rows = spark.createDataFrame([(n,) for n in names], "sa_hash string")
    return rows.select(
        "sa_hash", F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.concat(F.lit(by), "sa_hash").alias("stix_report"),
        F.lit(1).alias("application_area"), F.lit("completed").alias("status"),
    )


def test_one_row_a_hash_and_growing_ids(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    assert store.version() == 0 and store.read().count() == 0
    assert store.append(results(spark, ["a", "b", "b"])) == 1
    assert store.append(results(spark, ["b", "c"], "x")) == 2
    assert store.append(results(spark, ["a", "c"])) == 2
    rows = store.read().collect()
    assert sorted(r["sa_hash"] for r in rows) == ["a", "b", "c"] and len({r["id"] for r in rows}) == 3
    ids = {r["sa_hash"]: r["id"] for r in rows}
    assert ids["c"] > max(ids["a"], ids["b"]) > 0
    assert {r["sa_hash"] for r in store.read(1).collect()} == {"a", "b"}
    assert orders.result_by_hash(store.read(), "c").first()["stix_report"] == "xc"
    assert ResultStore(spark, str(tmp_path)).version() == 2


def test_two_writers_at_once(spark, tmp_path):
    """Each writer has hashes of its own and shares others; every hash is stored once, every id once."""
    store = ResultStore(spark, str(tmp_path))
    barrier, failed = threading.Barrier(3), []

    def write(k):
        try:
            own = ResultStore(spark, str(tmp_path))
            barrier.wait()
            for turn in range(2):
                own.append(results(spark, [f"shared{turn}", f"own{k}{turn}"], str(k)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(200)
    assert not failed
    rows = store.read().collect()
    assert sorted(r["sa_hash"] for r in rows) == sorted(["shared0", "shared1", *(f"own{k}{t}" for k in range(3) for t in range(2))])
    assert len({r["id"] for r in rows}) == len(rows) == 8


def test_a_lost_race_drops_what_the_winner_stored(spark, tmp_path, monkeypatch):
    first, second = ResultStore(spark, str(tmp_path)), ResultStore(spark, str(tmp_path))
    stage = second._stage

    def slow(rows):
        staged = stage(rows)
        if first.version() == 0:
            first.append(results(spark, ["a", "b"], "first"))
        return staged

    monkeypatch.setattr(second, "_stage", slow)
    assert second.append(results(spark, ["b", "c"], "second")) == 2
    assert {r["sa_hash"]: r["stix_report"] for r in first.read().collect()} == {"a": "firsta", "b": "firstb", "c": "secondc"}


def test_a_writer_that_fails_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, str(tmp_path))
    store.append(results(spark, ["a"]))
    monkeypatch.setattr(store, "_try_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        store.append(results(spark, ["b"]))
    assert [r["sa_hash"] for r in ResultStore(spark, str(tmp_path)).read().collect()] == ["a"]


def test_compaction_keeps_rows_ids_and_versions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    for names in (["a"], ["b", "c"], ["d"]):
        store.append(results(spark, names))
    before = sorted(map(tuple, store.read().collect()))
    assert store.compact() == 4 and len(store.commits()) == 1
    assert sorted(map(tuple, store.read().collect())) == before
    assert store.read(2).count() == 3
    store.append(results(spark, ["a", "e"]))
    after = store.read()
    assert after.count() == 5 and after.agg(F.max_by("sa_hash", "id")).first()[0] == "e"
    assert store.compact() == 6 and store.compact() == 6
