"""Counts against plain versions; classifiers by held-out accuracy."""

import itertools
import math
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octoloom.llm import quality, registry, toxicity

ROOMY = "/root/testdata/sf0.1"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:k] for k, x in enumerate(lines)),
        "n_repeat_words": len(again),
    }


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x1f ", max_size=120))
def test_counts_of_any_text(text):
    assert quality.counts(quality.Text(text.encode())) == plain_counts(text)


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality, "_MIX", np.uint64(0))
    words = b"a b c d e f g h a b c d e f g h j i b h f g e h"
    assert quality.repeat_words(quality.Text(words)) == 16


@pytest.mark.parametrize("text", ["", "a", " b ", "ab  ba\tab\n", "\x1f x \x85 y", "caf\u00e9 \u738b \u738b", "x" * 3000 + " " + "x" * 2999])
def test_words_have_one_hash_each(text):
    words, hashes = text.encode().split(), quality.Text(text.encode()).hashes.tolist()
    assert len(words) == len(hashes)
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))


def plain_probability(model, text):
    """The classifier's rule, an n-gram at a time."""

    def word(w):
        power, total = 1, 0
        for k, byte in enumerate(w):
            power = power * 0x9E3779B97F4A7C15 % 2**64 if k < 256 else power
            total += byte * power
        return ((total + len(w)) * 0x9E3779B97F4A7C15 % 2**64) >> 32

    def joined(parts):
        out = 0
        for p in parts:
            out = (out * 0x85EBCA6B + p) % 2**32
        return out

    words = [word(w) for w in text.encode().split()]
    chars = [ord(c) for c in text]
    grams = [[(w,) for w in words], list(zip(words, words[1:]))]
    grams += [[tuple(chars[i : i + n]) for i in range(len(chars) - n + 1)] for n in (3, 5)]
    score = model.bias
    for k, family in enumerate(grams):
        if family:
            columns = [(joined(g) * 0x9E3779B1 % 2**32 >> 16) + (k << 16) for g in family]
            score += sum(float(model.weights[c]) for c in columns) / len(family)
    return 1 / (1 + math.exp(-(model.slope * score + model.offset)))


def test_verdicts_equal_the_plain_rule(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registry.op4_quality_rules(spark, small).collect():
        p = plain_probability(model, texts[r["doc_id"]])
        assert r["p_good"] == pytest.approx(p, abs=1e-6)
        expected = plain_counts(texts[r["doc_id"]])
        failed = expected["n_words"] < 20 or 100 * expected["n_repeat_words"] > 30 * expected["n_words"]
        assert r["kept"] == (not failed and p >= quality.KEEP_FROM)


def test_scores_equal_the_sum_over_all_pairs(spark, small):
    """The machine with an explicit sum over pairs of terms, for every document."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in docs.collect()}
    for r in registry.op7_toxicity(spark, small).collect():
        words = {w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r["doc_id"]])}
        keys = words | {w[:n] + b"*" for w in words for n in (4, 6) if len(w) > n}
        slots = [int(model.columns[c]) for c in {crc32(k) % 2**18 for k in keys}]
        slots = [s for s in slots if s >= 0]
        raw = model.bias + sum(float(model.weights[s]) for s in slots)
        for a, b in itertools.combinations(slots, 2):
            raw += float(model.factors[a] @ model.factors[b])
        score = 1 / (1 + math.exp(-(model.slope * raw + model.offset)))
        assert r["score"] == pytest.approx(score, abs=1e-4)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_quality_query_counts_and_verdicts(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in registry.op4_quality_rules(spark, small).collect():
        expected = plain_counts(texts[r["doc_id"]])
        assert {k: r[k] for k in expected} == expected
        failed = expected["n_words"] < 20 or 100 * expected["n_repeat_words"] > 30 * expected["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["p_good"] >= quality.KEEP_FROM)


def test_quality_on_rows_that_the_fit_did_not_see(spark):
    docs, labels = (spark.read.parquet(f"{ROOMY}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 4 <> 1")
    judged = quality.report(docs, seen).join(labels.where("doc_id % 4 = 1"), "doc_id").toPandas()
    judged = judged[~judged["base_failed"]]
    good = judged["quality"] == 1
    assert (judged["kept"][good]).mean() > 0.99
    assert (~judged["kept"][~good]).mean() > 0.9
    # calibrated: the mean probability is near the share of good rows
    assert judged["p_good"].mean() == pytest.approx(good.mean(), abs=0.03)


def test_toxicity_on_held_out_rows(spark):
    rows = registry.op7_toxicity(spark, ROOMY)
    labels = spark.read.parquet(f"{ROOMY}/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").toPandas()
    assert all(crc32(str(d).encode()) % 4 == 2 for d in held["doc_id"])
    toxic = held["toxic"] == 1
    assert held["score"].between(0, 1).all()
    assert (held["predicted"][toxic] == 1).mean() > 0.85
    assert (held["predicted"][~toxic] == 0).mean() > 0.98


def test_held_out_labels_are_not_learned(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.selectExpr("doc_id", "quality", "IF(pmod(crc32(CAST(doc_id AS STRING)), 4) = 2, 1 - toxic, toxic) AS toxic")
    first, second = (sorted(map(tuple, toxicity.report(docs, x).collect())) for x in (labels, lied))
    assert first == second


def test_factor_pairs_learn_what_weights_cannot():
    """Toxic only where both terms meet."""
    rng = np.random.default_rng(3)
    has = rng.random((600, 2)) < 0.5
    labels = (has.all(1)).astype(float)
    rows = [np.array(sorted([k + 1 for k in range(2) if h[k]] + [10 + i % 5])) for i, h in enumerate(has)]
    model = toxicity.fit_rows(rows, labels, np.arange(600) % 5 == 0, steps=400)
    p = np.array([model.probability(r) for r in rows])
    assert ((p >= 0.5) == (labels > 0)).mean() > 0.99
    slots = model.columns[[1, 2]]
    assert float(model.factors[slots[0]] @ model.factors[slots[1]]) > 0.5


def test_pairs_are_found_where_neither_term_tells_alone():
    """Toxic where both terms or neither are there: each alone is as frequent in both classes."""
    rng = np.random.default_rng(4)
    has = rng.permutation(np.repeat([[0, 0], [0, 1], [1, 0], [1, 1]], 300, axis=0)).astype(bool)
    labels = (has[:, 0] == has[:, 1]).astype(float)
    rows = [np.array(sorted([k + 1 for k in range(2) if h[k]] + [10 + i % 5])) for i, h in enumerate(has)]
    apart = np.arange(len(rows)) % 5 == 0
    assert {1, 2} <= set(toxicity.telling_columns(rows, labels).tolist())
    model = toxicity.fit_rows(rows, labels, apart, steps=600)
    p = np.array([model.probability(r) for r in rows])
    assert ((p >= 0.5) == (labels > 0)).mean() > 0.99


def test_fits_take_one_row_an_id_and_stop_at_their_bounds(spark):
    docs = spark.range(2000).selectExpr("7 AS doc_id", "concat('same words here ', id) AS text")
    docs = docs.unionByName(spark.range(40).selectExpr("100 + id AS doc_id", "concat('other ', id % 2) AS text"))
    labels = spark.range(40).selectExpr("100 + id AS doc_id", "CAST(id % 2 AS INT) AS quality").unionByName(
        spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    )
    rows = quality.sample(docs, labels, "quality", 50, F.col("text")).collect()
    assert len(rows) == 41 and len({r["doc_id"] for r in rows}) == 41
    assert quality.fit(docs, labels) is not None
    one = (np.array([1], np.int32), np.array([1.0], np.float32))
    assert quality.fit_rows([(k, k % 2, one) for k in range(10)], most=1) is None
    assert toxicity.fit_sample([(k, k % 2, one[0]) for k in range(10)], most=1) is None
