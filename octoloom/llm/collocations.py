"""Frequent phrases of two to four words, found by PCY and DHP hashing.

Each pass reads the texts once.  Pass j counts phrases of j words exactly and, while it has the words
in hand, counts phrases of j + 1 words by hash bucket.  A bucket below the least frequency holds no
frequent phrase, so the next pass counts only phrases whose bucket is full and whose two parts of j words are
frequent (Apriori).  Both tests are bitmaps of a fixed number of bits, broadcast: what a task holds does not
grow with the corpus or its vocabulary, and a bit that is set by chance costs a row, never a wrong result, as every
phrase that passes is counted by its own words.

Texts become word numbers and rolling 64-bit hashes in numpy, a slice of bounded bytes at a time; counts of a
slice go to Spark's aggregation, combined before the shuffle and keyed by the whole phrase, so neither a frequent
word nor a language is a hot key.  Only what is frequent is kept after a pass.  Most buckets are met once or twice, so
their counts travel packed, a row for each block of 2^15 buckets and not one for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.batches import bounded
from .common import cut

LEAST = 30
LONGEST = 4
TOP = 2_000
#: A longer candidate with this share of a phrase's occurrences stands for it.
COVER_PERCENT = 80
SCALE = 2_000_000
#: Bitmaps have 2^26 bits (8 MB), whatever the corpus.
BUCKET_BITS = 26
#: Bytes of text whose words are numbered at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes of text that wait for their slice to fill, in all languages.
WAIT_BYTES = 8 << 20

#: Ends of pieces become 0xFF, a byte that no UTF-8 text holds; A-Z become a-z.
_BREAK = b"\xff"
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BLOCK_BITS = 15
#: Buckets whose counts a task holds before it hands them on, and rows that it hands on at once.
HELD_BUCKETS = 1 << 19
_ROWS = 1 << 15
#: Texts whose words are objects at once.
_TEXTS = 64

#: A phrase, its bucket and its count; or (phrase null) the number of a block, its packed counts, and 1.
_COUNTS = "lang string, phrase string, bucket int, packed binary, n long"
_COUNTS_ARROW = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary()), ("n", pa.int64())]
)


class Words(dict):
    """Numbers of words in order of appearance, and their hashes; number 0 is the break."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


def _numbered(texts: list[bytes], words: Words) -> np.ndarray:
    """The numbers of all words, with a break after each piece; a few texts at a time are objects."""
    out = [np.empty(0, np.int32)]
    for first in range(0, len(texts), _TEXTS):
        tokens = (_BREAK.join(texts[first : first + _TEXTS]).translate(_FOLD) + _BREAK).replace(_BREAK, b" \xff ").split()
        out.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
    return np.concatenate(out)


def _buckets(hashes: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return ((hashes ^ np.uint64(seed)) * _MIX[1]) >> np.uint64(64 - bits)


def _is_set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> np.uint64(3)] >> (buckets & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_slice(
    texts: list[bytes], lang: str, size: int, longest: int, bits: int, frequent: np.ndarray | None, full: np.ndarray | None
) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray]]:
    """(phrases, buckets, counts) of phrases of ``size`` words, and of the buckets of the next length (phrases None).

    ``frequent`` has the bits of frequent phrases one word shorter, ``full`` those of full buckets of this length.
    """
    words = Words()
    codes = _numbered(texts, words)
    if not len(codes):
        return
    seed = xxhash.xxh64_intdigest(lang)
    hashes = np.array(words.hashes, np.uint64)[codes]
    # one[i]: a word stands at i; inside[i]: ``size`` words of one piece start at i
    one = codes != 0
    inside, rolled = one, hashes
    for k in range(1, size):
        if k == size - 1:
            shorter = _is_set(frequent, _buckets(rolled, seed, bits)) & inside
            inside_next = shorter[:-1] & shorter[1:]
        else:
            inside_next = inside[:-1] & one[k:]
        inside, rolled = inside_next, _longer(rolled, hashes[k:])
    if full is not None:
        inside = inside & _is_set(full, _buckets(rolled, seed, bits))
    at = np.flatnonzero(inside)
    if not len(at):
        return
    spelled = [None] * len(words)
    for word, number in words.items():
        spelled[number] = word
    yield from _exact(codes, at, size, spelled, _buckets(rolled[at], seed, bits))
    if size < longest:
        both = inside[:-1] & inside[1:]
        found = _buckets(_longer(rolled, hashes[size:])[both], seed, bits).astype(np.int32)
        values, counts = np.unique(found, return_counts=True)
        if len(values):
            yield [None] * len(values), values, counts


def _longer(rolled: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer: ``following`` starts at the word after the first phrase."""
    head = rolled[: len(following)]
    return (head ^ (head >> np.uint64(29))) * _MIX[0] + following


def _exact(
    codes: np.ndarray, at: np.ndarray, size: int, spelled: list[bytes], buckets: np.ndarray
) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    key = codes[at].astype(np.int64)
    for k in range(1, size):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(spelled) + codes[at + k]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    for begin in range(0, len(first), _ROWS):
        part = first[begin : begin + _ROWS]
        columns = [codes[at[part] + k].tolist() for k in range(size)]
        phrases = [b" ".join([spelled[c] for c in row]).decode("utf-8", "replace") for row in zip(*columns, strict=True)]
        yield phrases, buckets[part], counts[begin : begin + _ROWS]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language together, in slices of bounded bytes, whatever the batches."""
    held: dict[str, list[bytes]] = {}
    bytes_held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = text.as_py() or b""
            held.setdefault(lang, []).append(data)
            bytes_held[lang] = bytes_held.get(lang, 0) + len(data) + 1
            if bytes_held[lang] >= SLICE_BYTES:
                del bytes_held[lang]
                yield lang, held.pop(lang)
            elif sum(bytes_held.values()) >= WAIT_BYTES:
                most = max(bytes_held, key=bytes_held.__getitem__)
                del bytes_held[most]
                yield most, held.pop(most)
    while held:
        yield held.popitem()


class BucketCounts:
    """Counts by bucket of several slices, merged whenever ``HELD_BUCKETS`` have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, values: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes counts in; gives them all out if they stay too many when merged."""
        self.parts.append((values, counts))
        self.held += len(values)
        if self.held > HELD_BUCKETS:
            values, counts = self.merged()
            if len(values) > HELD_BUCKETS // 2:
                yield values, counts
            else:
                self.parts, self.held = [(values, counts)], len(values)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in self.parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in self.parts])).astype(np.int64)
        self.parts, self.held = [], 0
        return values, counts


def _rows(lang: str, phrases: list[str], buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.string()), pa.array(buckets.astype(np.int32))]
    columns += [pa.nulls(n, pa.binary()), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS_ARROW)


def _wide(least: int) -> type:
    return np.uint8 if least < 256 else np.int64


def _packed_rows(buckets: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """A row for each block: places in it (two bytes each), then their counts.

    Counts stop at ``least``, which says as much of a sum that only has to be compared with ``least``.
    """
    blocks, places = buckets >> _BLOCK_BITS, (buckets & ((1 << _BLOCK_BITS) - 1)).astype(np.uint16)
    counts = np.minimum(counts, least).astype(_wide(least))
    found, first = np.unique(blocks, return_index=True)
    parts = [slice(a, b) for a, b in zip(first, [*first[1:], len(blocks)], strict=True)]
    n = len(parts)
    packed = pa.array([places[p].tobytes() + counts[p].tobytes() for p in parts], pa.binary())
    columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(found.astype(np.int32)), packed, pa.array(np.ones(n, np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS_ARROW)


def _pass(docs: DataFrame, size: int, longest: int, least: int, bits: int, maps: Broadcast | None) -> DataFrame:
    """A cut of frequent phrases of ``size`` words and of the packed bucket counts of the next length (phrase null).

    In the first pass also all words of each language, under the empty phrase.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, full = maps.value if maps else (None, None)
        held = BucketCounts()
        for lang, texts in _slices(batches):
            total = 0
            for phrases, buckets, counts in count_slice(texts, lang, size, longest, bits, frequent, full):
                if phrases[0] is None:
                    for more in held.add(buckets, counts):
                        yield _packed_rows(*more, least)
                    continue
                yield _rows(lang, phrases, buckets, counts)
                total += counts.sum()
            if size == 1 and total:
                yield _rows(lang, [""], np.zeros(1), np.array([total]))
        if held.parts:
            yield _packed_rows(*held.merged(), least)

    # a packed row is a group of its own; equal ones are counted
    counted = docs.mapInArrow(count, _COUNTS).groupBy("lang", "phrase", "bucket", "packed").agg(F.sum("n").alias("n"))
    return cut(counted.where((F.col("n") >= least) | (F.col("phrase") == "") | F.col("packed").isNotNull()))


def _full(packed: DataFrame, least: int) -> DataFrame:
    """(block, bits): the buckets of each block whose counts sum to ``least``; a task holds one block at a time."""
    wide, size = _wide(least), 1 << _BLOCK_BITS
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits() -> pa.RecordBatch:
            made = np.packbits(sums >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"block": [block], "bits": [made]}, schema=schema)

        block, sums = None, np.zeros(size, np.int64)
        for batch in batches:
            for number, data, times in zip(*[batch.column(c).to_pylist() for c in ("bucket", "packed", "n")], strict=True):
                if number != block and block is not None:
                    yield bits()
                    sums[:] = 0
                block = number
                n = len(data) // (2 + np.dtype(wide).itemsize)
                places = np.frombuffer(data, np.uint16, n)
                sums[places] = np.minimum(sums[places] + np.frombuffer(data, wide, n, 2 * n).astype(np.int64) * times, least)
        if block is not None:
            yield bits()

    dealt = packed.select("bucket", "packed", "n").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "block int, bits binary")


def _marked(buckets: DataFrame) -> DataFrame:
    """(block, bits) with the bits of ``bucket`` set."""
    block = F.shiftright("bucket", _BLOCK_BITS)
    place = F.col("bucket").bitwiseAND((1 << _BLOCK_BITS) - 1).cast("long")
    return buckets.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))


def _bitmap(blocks: DataFrame, bits: int) -> np.ndarray:
    """One bitmap of (block, bits); at most 2^(bits - 15) rows of 4 KB come to the driver."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (_BLOCK_BITS - 3)
    for row in blocks.collect():
        out[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BUCKET_BITS) -> DataFrame:
    """(lang, phrase, words, n): every phrase of at most ``longest`` words found ``least`` times or more in a language.

    Under the empty phrase (words 0) stands the number of all words of each language.  Null lang is ``und``.
    """
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    maps, out = None, None
    for size in range(1, longest + 1):
        found = _pass(texts, size, longest, least, bits, maps)
        if maps:
            maps.destroy()
        exact = found.where("phrase IS NOT NULL")
        words = F.when(F.col("phrase") == "", F.lit(0)).otherwise(F.lit(size))
        sized = exact.select("lang", "phrase", words.alias("words"), "n")
        out = sized if out is None else out.unionByName(sized)
        if size < longest:
            phrases = exact.where("phrase != ''")
            full = _full(found.where("phrase IS NULL"), least)
            maps = spark.sparkContext.broadcast((_bitmap(_marked(phrases), bits), _bitmap(full, bits)))
    return out


def _parts(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def _big(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words; null lang is ``und``; repeated rows count each; ids are not
    read.  Texts of any length are counted whole.  Ties in score go by a, then by the phrase's bytes, so ranks are unique.
    Empty tables, and languages in which no phrase is frequent, give no rows.  Other columns are not read.
    """
    counts = frequent_phrases(docs, least, longest, bits)
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    heads = known.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.withColumns(
        {"head": _parts(words, F.lit(1), F.col("k")), "tail": _parts(words, F.col("k") + 1, F.col("words") - F.col("k"))}
    )
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    cuts = cuts.withColumn("twice", _big(F.col("a")) * F.lit(SCALE)).withColumn("parts", _big(F.col("l")) + _big(F.col("r")))
    worst = F.min(F.struct(F.expr("twice div parts").alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst.alias("worst"))

    spans = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> struct(s AS s, m AS m))))"
    )
    inner = found.where("words > 2").select("lang", "a", words.alias("w"), F.explode(spans).alias("span"))
    inner = inner.select("lang", _parts(F.col("w"), F.col("span.s"), F.col("span.m")).alias("phrase"), "a")
    covers = inner.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    covered = _big(F.col("cover")) * F.lit(100) >= _big(F.col("a")) * F.lit(COVER_PERCENT)
    left = scored.join(covers, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "worst.*").withColumn("rank", F.row_number().over(order))
    return (
        ranked.where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )
