"""Linked vectors against all pairs in numpy."""

import math

import numpy as np
import pytest

from octoloom.llm import embeddings, registry

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, node string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA)


def plain(rows, cosine=0.9):
    """{position: (links, smallest id reachable)} by comparing all pairs."""
    units = [embeddings.unit(v) for _, v in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for size in {len(u) for u in units if u is not None}:
        at = [i for i in range(n) if units[i] is not None and len(units[i]) == size]
        matrix = np.stack([units[i] for i in at])
        linked[np.ix_(at, at)] = matrix @ matrix.T >= cosine
    np.fill_diagonal(linked, False)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in np.flatnonzero(linked[i]))])
            if low < root[i]:
                root[i], changed = low, True
    firsts = {}
    for i, (vec_id, _) in enumerate(rows):
        ids = [x for x in (firsts.get(root[i]), vec_id) if x is not None]
        firsts[root[i]] = min(ids, default=None)
    return [(rows[i][0], int(linked[i].sum()), firsts[root[i]], rows[i][0] == firsts[root[i]]) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def around(rng, centre, degrees, n):
    """Unit vectors at about this angle from the centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    a = math.radians(degrees)
    return math.cos(a) * centre + math.sin(a) * noise


def test_query_against_all_pairs(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got(registry.op11_embedding_near_dedup(spark, small)) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("crowd", [64, 4])
def test_groups_of_every_density(spark, crowd):
    """Tight, loose and overlapping groups, copies, scaled copies and strangers; clusters or not, the same rows."""
    rng = np.random.default_rng(3)
    centres = [c / np.linalg.norm(c) for c in rng.standard_normal((6, 48))]
    beside = around(rng, centres[0], 24, 1)[0]
    vectors = [
        *around(rng, centres[0], 4, 120),
        *around(rng, beside, 5, 60),
        *around(rng, centres[1], 11, 40),
        *around(rng, centres[2], 17, 30),
        *([centres[3]] * 90),
        *(3.5 * around(rng, centres[3], 10, 10)),
        *rng.standard_normal((150, 48)),
    ]
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    expected = plain(rows)
    found = got(embeddings.near_duplicates(frame(spark, rows), recall=1 - 1e-9, crowd=crowd))
    assert found == sorted(expected, key=str)
    assert sum(r[1] for r in expected) > 20_000


def test_recall_at_the_least_cosine(spark):
    """Pairs at 0.9 to 0.91: more than 0.95 are found with the parameters of the query, and none below 0.9."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        cosine = rng.uniform(0.9, 0.91) if k % 2 else rng.uniform(0.88, 0.8999)
        rows += [(2 * k, centre.tolist()), (2 * k + 1, around(rng, centre, math.degrees(math.acos(cosine)), 1)[0].tolist())]
    expected = {r[0]: r[1] for r in plain(rows)}
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert all(found[i] <= expected[i] for i in found)
    assert sum(found.values()) >= 0.95 * sum(expected.values()) > 500


def test_odd_vectors_have_a_defined_row(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None),
        (2, []),
        (3, [0.0, 0.0]),
        (4, [1.0, None]),
        (5, [nan, 1.0]),
        (6, [inf, 1.0]),
        (7, [1.0, 2.0]),
        (8, [1.0, 2.0]),
        (8, [1.0, 2.0]),
        (None, [2.0, 4.0]),
        (9, [1.0, 2.0, 0.0]),
        (10, [1e300, 2e300]),
        (11, [-1e-300, -2e-300]),
        (12, [-0.0, 1.0]),
        (13, [0.0, 1.0]),
        (None, [3.0, -1.0, 5.0]),
    ]
    assert got(embeddings.near_duplicates(frame(spark, rows))) == sorted(plain(rows), key=str)
    assert embeddings.near_duplicates(frame(spark, [])).count() == 0
    assert got(embeddings.near_duplicates(frame(spark, rows[:3]))) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_a_very_long_vector(spark):
    rng = np.random.default_rng(5)
    long = rng.standard_normal(20_000)
    rows = [(1, long.tolist()), (2, (long + 0.1 * rng.standard_normal(20_000)).tolist()), (3, rng.standard_normal(20_000).tolist())]
    assert got(embeddings.near_duplicates(frame(spark, rows))) == sorted(plain(rows), key=str)


def test_a_pair_at_just_the_least_cosine_is_linked(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0])]
    assert got(embeddings.near_duplicates(frame(spark, rows), cosine=0.6, recall=1 - 1e-9)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_tables_reach_the_recall():
    for bits in (8, 14, 24):
        same = (1 - math.acos(0.9) / math.pi) ** bits
        tables = embeddings.tables_for(bits, 0.9, 0.99)
        assert 1 - (1 - same) ** tables >= 0.99 > 1 - (1 - same) ** (tables - 1)
    assert [embeddings.bits_for(n) for n in (0, 1_000, 1_000_000)] == [8, 8, 18]
