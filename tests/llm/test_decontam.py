"""Wu-Manber search against plain window matching, and the query against its SQL."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from octoloom.llm import decontam, registry


def plain_hits(words, items, window):
    hit, found = set(), set()
    for item, data in items:
        own = decontam.words_of(data)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return hit, found


words = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 5))
def test_search_finds_every_occurrence(text, patterns, window):
    items = [(str(k), b" ".join(p)) for k, p in enumerate(patterns)]
    spans, found = decontam.scan(text, decontam.build(items, window))
    assert ({i for a, b in spans for i in range(a, b)}, found) == plain_hits(text, items, window)


def test_words_are_letters_digits_and_all_beyond_ascii():
    assert decontam.words_of("A-b_c É9\x7f\x00d@E[`{".encode()) == [b"a", b"b", b"c", "É9".encode(), b"d", b"e"]


def test_query_equals_sql(same_as_sql):
    same_as_sql(registry.op2_benchmark_decontamination, registry.OP2_SQL)


def test_blocks_of_the_benchmark_give_the_same(spark, small):
    docs, benchmark = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, parts = (
        sorted(map(tuple, decontam.report(docs, benchmark, block_bytes=n).collect())) for n in (decontam.BLOCK_BYTES, 3_000)
    )
    assert whole == parts and any(r[-1] for r in whole)


def test_a_twentieth_of_the_words_contaminates(spark):
    rng = random.Random(2)
    passage = " ".join(f"item{k}" for k in range(13))
    other = [" ".join(f"w{rng.random()}".replace(".", "x") for _ in range(n)) for n in (13 * 19, 13 * 19 + 1)]
    docs = spark.createDataFrame([(k, f"{t} {passage.upper()}") for k, t in enumerate(other)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, items).collect()}
    assert [got[k]["n_hit"] for k in (0, 1)] == [13, 13]
    assert [got[k]["contaminated"] for k in (0, 1)] == [True, False]


def test_tables_of_a_full_block_are_small():
    """8 MB of benchmark, random words of a vocabulary of 50,000: below 100 MB when loaded, and soon built."""
    import pickle
    import time
    import tracemalloc

    rng = random.Random(6)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    items, held = [], 0
    while held < decontam.BLOCK_BYTES:
        text = " ".join(rng.choices(vocabulary, k=400)).encode()
        items.append((f"i{len(items)}", text))
        held += len(text)
    began = time.process_time()
    packed = pickle.dumps(decontam.build(items))
    assert time.process_time() - began < 15
    assert len(packed) < 100 << 20
    tracemalloc.start()
    searches = pickle.loads(packed)
    assert tracemalloc.get_traced_memory()[0] < 100 << 20
    tracemalloc.stop()
    words = decontam.words_of(items[7][1])
    spans, found = decontam.scan([b"x"] * 50 + words[3:40] + [b"y"], searches)
    assert (spans, found) == ([[50, 87]], {"i7"})


def test_an_item_that_repeats_itself_is_held_once():
    searches = decontam.build([("a", b"x " * 5_000), ("b", b"x " * 13)])
    assert len(searches[0].keys) == 2
    assert decontam.scan([b"x"] * 14, searches) == ([[0, 14]], {"a", "b"})


def test_one_token_of_a_megabyte(spark):
    long = "z" * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, f"a {long} b")], "doc_id long, text string")
    items = spark.createDataFrame([(5, long), (6, None), (7, "")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.report(docs, items).collect()}
    assert got == {1: (1, 1, 1), 2: (3, 1, 1)}
    assert {r["n_hit"] for r in decontam.report(docs, items.limit(0)).collect()} == {0}
