"""Filter interactions against applying the filters one by one in every order."""

import random
import re
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octoloom.llm import filter_audit, registry

DOCS = "doc_id long, text string, lang string, part string, digest string, mask string, n string"
LABELS = "doc_id long, quality int, toxic int, n string"
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f
        for f, failed in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", re.search(r"[#$%&*|]", text) is not None),
        )
        if failed
    }


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    parts = {}
    for i, text, lang in docs:
        failed = fails(text or "")
        if i is not None and i > firsts[text or ""]:
            failed.add("E")
        parts.setdefault(lang or "", []).append((i, failed))
    out = []
    for part, rows in parts.items():
        steps, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(removed)
                steps.append(
                    (
                        "".join(order),
                        step,
                        len(left),
                        len(removed),
                        sum(f in r[1] for r in rows) - len(removed),
                        sum(r[1] == {f} for r in rows),
                        sum(r[0] in good for r in removed),
                        sum(r[0] in toxic for r in removed),
                    )
                )
        out += [(part, *s, sums[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_against_every_order(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(registry.op13_filter_interactions(spark, small)) == plain(docs, labels)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    """Null ids, texts and languages, repeated ids and rows, several labels for an id, clashing names."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "A", "a # b", "word " * 250, "W" * 10, " ".join(f"w{i}é" for i in range(200)), "x " * 400_000]
    docs = [(rng.choice([None, *range(12)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(14)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(20)]
    given_docs = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in docs], DOCS)
    given_labels = spark.createDataFrame([(*d, "x") for d in labels], LABELS)
    assert got(filter_audit.audit(given_docs, given_labels)) == plain(docs, labels)
    assert got(filter_audit.audit(given_docs, given_labels.limit(0))) == plain(docs, [])
    assert filter_audit.audit(given_docs.limit(0), given_labels).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA É\t\n\x0b\x1c#|", max_size=60))
def test_masks_of_any_text(text):
    mask = filter_audit.text_mask(text.encode())
    assert {f for i, f in enumerate("ABCD") if mask >> i & 1} == fails(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**18), min_size=32, max_size=32))
def test_polynomial(counts):
    """Corners count what a set removes; the integral is the mean marginal over all orders, exactly."""
    polynomial = filter_audit.removal_polynomial(counts)
    removed = [sum(c for m, c in enumerate(counts) if m & s) for s in range(32)]
    assert [filter_audit.at_corner(polynomial, s) for s in range(32)] == removed
    for i in range(5):
        marginals = 0
        for order in permutations(range(5)):
            before = sum(1 << k for k in order[: order.index(i)])
            marginals += removed[before | 1 << i] - removed[before]
        assert filter_audit.shapley(polynomial, i) == Fraction(marginals, 120)
