"""Near-duplicates against a brute-force version."""

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octoloom.llm import registry, simhash
from octoloom.llm.common import connected_components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), seed=42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{doc: smallest doc reachable} by comparing all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(prints)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉé ß\t\n\x0b\x1c ", max_size=60))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    words = spark.createDataFrame([("ab cd éf",)], "t string")
    assert words.select(F.xxhash64("t")).first()[0] == simhash.fingerprint("ab cd éf".encode())


def test_query_against_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    expected = plain_components(prints)
    got = registry.op1_simhash_near_dedup(spark, small).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {
        d: (f"{prints[d]:016x}", expected[d]) for d in docs
    }


@pytest.mark.parametrize("limit", [512, 2])
def test_links_are_all_pairs_within_two_bits(spark, limit):
    """Clusters, chains and shared halves; with full buckets looked up exactly as well."""
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)}
        values |= {centre & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(5)}
    values |= {0, 1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = {
        (max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2
    }
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket_limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(1, 60)] + [(k, 100) for k in range(101, 400)] + [(500, 499), (500, 498)]
    got = connected_components(spark.createDataFrame(edges, "big long, small long"))
    roots = {r["node"]: r["root"] for r in got.collect()}
    assert all(roots[i] == 1 for i in range(1, 61))
    assert all(roots[k] == 100 for k in range(100, 400))
    assert roots[500] == roots[499] == roots[498] == 498
    assert connected_components(spark.createDataFrame([], "big long, small long")).count() == 0


def test_keep_one_keeps_one_of_each_component(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    firsts = {r[0] for r in registry.op1_simhash_near_dedup(spark, small).select("component_id").collect()}
    assert sorted(r[0] for r in simhash.keep_one(docs).select("doc_id").collect()) == sorted(firsts)
