"""Phrases against a plain count of all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octoloom.functions.batches import BATCH_BYTES
from octoloom.llm import collocations, registry

SCHEMA = "doc_id long, text string, lang string, phrase string, bucket string, n string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "x", "x", "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


def plain(rows, least=30, longest=4, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= 80 * counts[lang, w[i : i + m]]:
                    dropped.add((lang, w[i : i + m]))
    by_lang = {}
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]], k) for k in range(1, len(w))]
            score, k, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_against_plain_counts(spark, small):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("text", "lang").collect()]
    expected = plain(rows)
    assert expected and got(registry.op12_phrase_collocations(spark, small)) == expected


def invented(seed, n):
    """Few words in many arrangements, with marks, breaks, capitals, letters beyond ASCII and odd control characters."""
    rng = random.Random(seed)
    words = ["a", "B", "cc", "É", "ß", "x\x01", "ü", "the", "The", "d-e", "\x1c"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", "? "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("least, top, bits", [(5, 2000, 26), (3, 7, 26), (4, 2000, 16), (1, 2000, 16)])
def test_any_text_and_any_number_of_buckets(spark, least, top, bits):
    """Bitmaps of 2^16 bits have collisions, which must not matter."""
    rows = invented(least, 150)
    found = got(collocations.collocations(frame(spark, rows), least=least, top=top, bits=bits))
    assert found == plain(rows, least=least, top=top)


def test_slices_do_not_matter():
    rows = invented(9, 80)
    lang, texts = "en", [(t or "").encode() for t, _ in rows]
    whole, cut = Counter(), Counter()
    for phrases, _, counts in collocations.count_slice(texts, lang, 1, 4, 20, None, None):
        whole.update(dict(zip(phrases, counts.tolist(), strict=True)) if phrases[0] is not None else {})
    for text in texts:
        for phrases, _, counts in collocations.count_slice([text], lang, 1, 4, 20, None, None):
            if phrases[0] is not None:
                cut.update(dict(zip(phrases, counts.tolist(), strict=True)))
    assert whole == cut


def test_buckets_of_the_next_length_bound_its_counts():
    """PCY's promise: a bucket's count is at least that of each phrase in it."""
    texts = [b"a b a b c. a b", b"c a b"]
    bits = 16
    found = list(collocations.count_slice(texts, "en", 1, 4, bits, None, None))
    by_bucket = dict(zip(found[1][1].tolist(), found[1][2].tolist(), strict=True))
    everything = np.full(1 << (bits - 3), 255, np.uint8)
    phrases, buckets, counts = next(collocations.count_slice(texts, "en", 2, 4, bits, everything, everything))
    assert dict(zip(phrases, counts.tolist(), strict=True)) == {"a b": 4, "b a": 1, "b c": 1, "c a": 1}
    assert all(by_bucket[b] >= n for b, n in zip(buckets.tolist(), counts.tolist(), strict=True))
    nothing = np.zeros(1 << (bits - 3), np.uint8)
    assert not list(collocations.count_slice(texts, "en", 2, 4, bits, everything, nothing))
    assert not list(collocations.count_slice(texts, "en", 2, 4, bits, nothing, everything))


def test_held_counts_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_BUCKETS", 10)
    rng = np.random.default_rng(1)
    for top in (4, 1_000):
        held, expected, found = collocations.BucketCounts(), Counter(), Counter()
        for _ in range(30):
            values, counts = np.unique(rng.integers(0, top, 7).astype(np.int32), return_counts=True)
            expected.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
            for more in held.add(values, counts):
                found.update(dict(zip(more[0].tolist(), more[1].tolist(), strict=True)))
        if held.parts:
            more = held.merged()
            found.update(dict(zip(more[0].tolist(), more[1].tolist(), strict=True)))
        assert found == expected


def test_edges(spark):
    assert got(collocations.collocations(frame(spark, []))) == []
    assert got(collocations.collocations(frame(spark, [(None, "en"), ("", None)]))) == []
    rows = [("new york " * 200_000, "en"), ("new york", "en"), ("one two", None)]
    assert got(collocations.collocations(frame(spark, rows))) == plain(rows)


def test_scores_past_64_bits(spark, monkeypatch):
    """Counts whose products do not fit 64 bits are scored exactly."""
    big = 4 * 10**15
    counts = [("en", "", 0, 9 * 10**15), ("en", "p", 1, big + 1), ("en", "q", 1, big), ("en", "p q", 2, big - 7)]
    made = spark.createDataFrame(counts, "lang string, phrase string, words int, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: made)
    row = collocations.collocations(made).first()
    assert row["score"] == 2_000_000 * (big - 7) // (2 * big + 1) and row["n"] == 9 * 10**15


@pytest.mark.parametrize("least", [1, 30, 300])
def test_buckets_travel_packed(spark, least):
    """A row for each block of buckets, not one for each bucket; sums are exact where they are compared."""
    rng = np.random.default_rng(least)
    sums, rows = Counter(), []
    for _ in range(6):
        values, counts = np.unique((rng.integers(0, 900, 4_000) ** 2 % 99_991).astype(np.int32), return_counts=True)
        counts = counts * rng.integers(1, 90, len(counts))
        for _ in range(2):  # equal rows count twice
            sums.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
            batch = collocations._packed_rows(values, counts, least)
            assert batch.num_rows == len(np.unique(values >> 15)) <= 4
            rows += batch.to_pylist()
    packed = spark.createDataFrame([(r["bucket"], bytes(r["packed"])) for r in rows], "bucket int, packed binary")
    bitmap = collocations._bitmap(collocations._full(packed.groupBy("bucket", "packed").agg(F.count("*").alias("n")), least), 17)
    found = np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).tolist()
    assert found == sorted(b for b, n in sums.items() if n >= least)


def test_a_pass_hands_on_few_rows_for_pairs_met_once(spark):
    """100,000 pairs of words, each met once: before, a row each in Spark's aggregation."""
    texts = [" ".join(f"w{(i * 7919 + k * k) % 400}" for k in range(i, i + 250)) for i in range(400)]
    docs = spark.createDataFrame([("en", t.encode()) for t in texts], "lang string, text binary").coalesce(1)
    found = collocations._pass(docs, 1, 4, 30, 26, None).where("phrase IS NULL")
    assert 0 < found.count() <= 2 * 2**11


def test_texts_wait_in_bounded_bytes_for_their_slices(monkeypatch):
    """Small batches and many languages make neither many slices nor much to hold."""
    monkeypatch.setattr(collocations, "SLICE_BYTES", 100)
    monkeypatch.setattr(collocations, "WAIT_BYTES", 300)
    rows = [(f"l{i % 7}" if i % 2 else "en", b"x" * (i % 23)) for i in range(500)] + [("en", b"y" * 1_000), ("de", None)]
    batches = [pa.RecordBatch.from_pylist([{"lang": n, "text": t}]) for n, t in rows]
    slices = list(collocations._slices(iter(batches)))
    assert sorted((n, t) for n, texts in slices for t in texts) == sorted((n, t or b"") for n, t in rows)
    assert len(slices) < 90 and max(sum(map(len, texts)) for _, texts in slices) < 1_200


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    collocations.collocations(frame(spark, [("a b", "en")]))
    assert int(spark.conf.get(name)) == BATCH_BYTES
    spark.conf.set(name, before)
