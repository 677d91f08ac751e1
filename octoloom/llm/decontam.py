"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols of the search are words.  Patterns of one length form one search: with ``m`` words a
pattern, the block of the last two words of the current window gives a shift.  Blocks that occur
in no pattern shift by ``m - 1``; otherwise by the distance to the block's last place in any
pattern.  Shift zero selects, in a sorted array, the patterns that end in this block and begin with
the window's first two words, and the rest is compared directly.  Patterns of one word have no
two-word block, so their block is the word itself.

Tables hold no words: blocks are 64-bit hashes, shifts a byte each in a table indexed by hash (blocks that meet
there get the lesser shift, which only costs a look), and a pattern is a place in the benchmark's own text.  8 MB of
benchmark are some 60 MB.

The benchmark is the stated query set.  Its texts are cut into groups of at most ``block_bytes``, each with
tables of that bound, broadcast.  Documents are read once, in Arrow batches, and never shuffled or
rewritten: a batch is searched for one group after the other, and where there are several a task holds the
tables of one at a time.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of benchmark text whose tables one pass holds.
BLOCK_BYTES = 8 << 20
#: Contaminated from one hit word in so many.
HIT_SHARE = 20

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: A-Z to a-z, other bytes outside words to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


class Search:
    """Shift and pattern tables for patterns of ``m`` words; plain values, to broadcast.

    ``keys`` has, in order, the halves of the hashes of each pattern's last and first block, ``starts`` and
    ``ends`` its place in ``text``, ``owners`` its item's place in ``names``.
    """

    def __init__(self, m: int, text: bytes, names: list[str]):
        self.m, self.text, self.names = m, text, names
        self.step = max(1, m - 1)
        self.shift, self.mask = b"", 0
        self.keys, self.starts, self.ends, self.owners = array("Q"), array("Q"), array("Q"), array("I")

    def fill(self, rows: list[tuple[np.ndarray, ...]]) -> None:
        """``rows``: for each item the hashes of its blocks, where its words start and end, and its owner's number."""
        m, b = self.m, min(2, self.m)
        blocks = sum(len(hashes) for hashes, *_ in rows)
        bits = max(10, (8 * blocks).bit_length())
        self.mask = (1 << bits) - 1
        shift = np.full(1 << bits, self.step, np.uint8 if m < 256 else np.uint32)
        parts = []
        for hashes, starts, ends, owner in rows:
            # the block that ends in word k ends some pattern, or stands before the end of the item's first one
            distance = np.maximum(0, m - b - np.arange(len(hashes)))
            np.minimum.at(shift, (hashes & np.uint64(self.mask)).astype(np.int64), distance.astype(shift.dtype))
            n = len(starts) - m + 1
            last, first = hashes[m - b : m - b + n], hashes[:n]
            keys = (last >> np.uint64(32) << np.uint64(32)) | (first >> np.uint64(32))
            parts.append((keys, starts[:n], ends[m - 1 :], np.full(n, owner, np.uint32)))
        self.shift = shift.tobytes() if m < 256 else shift.tolist()
        keys, starts, ends, owners = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((owners, keys))
        keys, starts, ends, owners = keys[order], starts[order], ends[order], owners[order]
        keep = np.ones(len(keys), bool)
        again = np.flatnonzero((keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1])) + 1
        for k in again.tolist():  # an item's repeats of one pattern
            keep[k] = self.text[starts[k] : ends[k]] != self.text[starts[k - 1] : ends[k - 1]]
        self.keys, self.starts, self.ends = (array("Q", c[keep].tobytes()) for c in (keys, starts, ends))
        self.owners = array("I", owners[keep].tobytes())


_hash = xxhash.xxh64_intdigest


def build(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[Search]:
    """A search for each pattern length among the windows of ``items``."""
    numbers: dict[str, int] = {}
    texts, held = [], 0
    by_length: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for item, data in items:
        words = words_of(data)
        if not words:
            continue
        size = min(window, len(words))
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.uint64, len(words))
        ends = np.cumsum(lengths + np.uint64(1)) - np.uint64(1) + np.uint64(held)
        starts = ends - lengths
        blocks = words if size == 1 else [b"%b %b" % pair for pair in zip(words, words[1:], strict=False)]
        hashes = np.fromiter(map(_hash, blocks), np.uint64, len(blocks))
        by_length.setdefault(size, []).append((hashes, starts, ends, numbers.setdefault(item, len(numbers))))
        texts.append(joined)
        held += len(joined) + 1
    text, names = b" ".join(texts), list(numbers)
    searches = []
    for size, rows in sorted(by_length.items()):
        search = Search(size, text, names)
        search.fill(rows)
        searches.append(search)
    return searches


def occurrences(words: list[bytes], search: Search) -> Iterator[tuple[int, str]]:
    """(first word, item) of every occurrence, in order."""
    m, shift, mask, keys = search.m, search.shift, search.mask, search.keys
    pairs, at, n = m > 1, m - 1, len(words)
    while at < n:
        block = _hash(words[at - 1] + b" " + words[at] if pairs else words[at])
        step = shift[block & mask]
        if step:
            at += step
            continue
        start = at - m + 1
        head = _hash(words[start] + b" " + words[start + 1]) if pairs else block
        key = block >> 32 << 32 | head >> 32
        k = bisect_left(keys, key)
        if k < len(keys) and keys[k] == key:
            window = b" ".join(words[start : at + 1])
            while k < len(keys) and keys[k] == key:
                if search.text[search.starts[k] : search.ends[k]] == window:
                    yield start, search.names[search.owners[k]]
                k += 1
        at += 1


def scan(words: list[bytes], searches: list[Search]) -> tuple[list[list[int]], set[str]]:
    """Merged [first, last) word ranges that are hit, and the items that hit."""
    found, items = [], set()
    for search in searches:
        last = -1
        for start, item in occurrences(words, search):
            if start != last:
                found.append([start, start + search.m])
                last = start
            items.add(item)
    return merge(found), items


def merge(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


_HITS = "n_words long, spans array<array<int>>, items array<string>"


def _groups(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in groups of bounded bytes; a longer item is a group of its own."""
    group: list[tuple[str, bytes]] = []
    held = 0
    for item, data in benchmark.toLocalIterator():
        if group and held + len(data) > block_bytes:
            yield group
            group, held = [], 0
        group.append((item, data))
        held += len(data)
    yield group


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
    name: str = "hits",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` (or its id alone) with the struct ``name``: n_words, hit word ranges, item ids.

    Null texts have no words.  Items without words hit nothing; a null item id is written
    ``null``.  An item shorter than ``window`` words is one pattern.  Ties do not arise; repeated
    rows and repeated items give the same hits again.  Texts and items of any length are searched whole.  An
    empty table of documents stays empty; an empty benchmark hits nothing.  With ``keep`` the columns of ``docs``
    stay as they are, so ``name`` must not be one of them; without it, others than the two named are not read.
    """
    spark = docs.sparkSession
    out = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")),
        F.coalesce(F.col("text"), F.lit("")).cast("binary"),
    )
    groups = [spark.sparkContext.broadcast(build(group, window)) for group in _groups(items, block_bytes)]
    return out.withColumn(name, _searched(groups)(F.col(text_col if keep else "text").cast("binary")))


def _searched(groups: list[Broadcast]):
    @F.arrow_udf(_HITS)
    def search(texts: pa.Array) -> pa.Array:
        rows = [{"n_words": 0, "spans": [], "items": set()} for _ in range(len(texts))]
        for group in groups:
            searches = group.value
            for text, row in zip(texts, rows, strict=True):
                words = words_of(text.as_py())
                spans, items = scan(words, searches)
                row["n_words"] = len(words)
                row["spans"] = merge(spans + row["spans"]) if row["spans"] else spans
                row["items"] |= items
            if len(groups) > 1:
                # the worker's copy; the next batch reads it from the broadcast's file again
                searches = None
                vars(group).pop("_value", None)
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
        return pa.array([row | {"items": sorted(row["items"])} for row in rows], kind)

    return search


def _n_hit(hits: str):
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda n, s: n + (s[1] - s[0]))


def contaminated(hits: str):
    n = _n_hit(hits)
    return (n > 0) & (n * HIT_SHARE >= F.col(f"{hits}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; just a twentieth of the words is contaminated.  Repeated
    rows give a row each; empty tables, long texts and clashing names are as in ``find_hits``.
    """
    hits = find_hits(docs, benchmark, **options)
    return hits.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        _n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated("hits").alias("contaminated"),
    )

