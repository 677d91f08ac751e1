"""Quality rules: fixed counts of a text, and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word one- and two-grams and hashed character
n-grams (code points), each family as relative frequencies, so a text of any length is read whole.  It is
fitted on a bounded sample of labelled rows, calibrated on a part kept from the fit (Platt), and
scored in Arrow batches against a fixed threshold.  Features are made where the texts lie; one task
fits those of the bounded sample, and the driver sees the weights, whose number is fixed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logistic import Blocks, fit_logistic, fit_platt, linear, sigmoid

#: Labelled ids that the fit takes at most (those first in hash order), one row each.
SAMPLE_ROWS = 4_000
#: Feature entries (of 8 bytes) that the fit holds at most; rows after it do not count.
SAMPLE_ENTRIES = 32_000_000
#: Kept below this calibrated probability of good quality no longer.
KEEP_FROM = 0.5
LEAST_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
BITS = 16
#: Words and pairs of words, three and five characters.
FAMILIES = 4
DIMS = FAMILIES << BITS
SYMBOLS = b"#*$%&|<>"

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Of bytes by their place in a word; places after the last share its power.
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
#: Multipliers of the 32-bit hashes.
_MIX32, _STEP32 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_SHIFT32 = np.uint32(32 - BITS)


class Text:
    """One text: its bytes, which of them are blank, and a 64-bit hash of each word, in order."""

    def __init__(self, data: bytes | None):
        self.data = data or b""
        self.chars = np.frombuffer(self.data, np.uint8)
        self.blank = (self.chars == 0x20) | (self.chars - np.uint8(0x09) <= 4)
        edges = np.flatnonzero(np.diff(self.blank, prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        self.hashes = np.zeros(0, np.uint64)
        if len(starts):
            # a sum of bytes times powers by their place in the word, blanks being nothing
            place = np.arange(len(self.chars)) - np.repeat(starts, np.diff(starts, append=len(self.chars)) + _first(starts))
            summed = np.add.reduceat((self.chars * ~self.blank) * _POWERS.take(place, mode="clip"), starts)
            self.hashes = (summed + (ends - starts).astype(np.uint64)) * _MIX


def _first(starts: np.ndarray) -> np.ndarray:
    """How much further the first word's run reaches: blanks before it are counted to it."""
    out = np.zeros(len(starts), np.int64)
    out[0] = starts[0]
    return out


def repeat_words(text: Text, window: int = REPEAT_WINDOW) -> int:
    """Words inside windows that are found twice or more, the first of them included.

    Windows of different hashes differ; those of one hash are compared word by word.
    """
    n = len(text.hashes) - window + 1
    if n < 2:
        return 0
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * _MIX + text.hashes[k : k + n]
    ranked = np.sort(hashes)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return 0
    words = text.data.split()
    places = defaultdict(list)
    for at in np.flatnonzero(np.isin(hashes, again)).tolist():
        places[tuple(words[at : at + window])].append(at)
    found = np.array(sorted(at for ats in places.values() if len(ats) > 1 for at in ats), np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: Text) -> dict[str, int]:
    data = text.data
    starts = (text.chars & 0xC0) != 0x80
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "n_words": len(text.hashes),
        "word_chars": int(np.count_nonzero(starts & ~text.blank)),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(text),
    }


def families(text: Text) -> list[np.ndarray]:
    """The hash of every n-gram, a family at a time; repeats stay.  Bytes that are no UTF-8 are one character."""
    words = (text.hashes >> np.uint64(32)).astype(np.uint32)
    chars = np.frombuffer(text.data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    once = chars * _STEP32
    three = (once * _STEP32)[:-2] + once[1:-1] + chars[2:]
    grams = [words, words[:-1] * _STEP32 + words[1:], three, (three[:-2] * _STEP32 + chars[3:-1]) * _STEP32 + chars[4:]]
    return [(gram * _MIX32) >> _SHIFT32 for gram in grams]


def sparse(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): each family's relative frequencies."""
    index, value = [], []
    for k, gram in enumerate(families(text)):
        if len(gram):
            which, often = np.unique(gram, return_counts=True)
            index.append(which.astype(np.int32) + np.int32(k << BITS))
            value.append((often / len(gram)).astype(np.float32))
    if not index:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(index), np.concatenate(value)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, text: Text) -> float:
        score = self.bias
        for weights, gram in zip(self.weights.reshape(FAMILIES, -1), families(text), strict=True):
            if len(gram):
                score += float(weights[gram].sum(dtype=np.float64)) / len(gram)
        return float(sigmoid(self.slope * score + self.offset))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    features: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, label, x) of at most ``rows`` labelled ids, first in hash order, one row each.

    Ids are ranked among the labels alone, so that the join has a side of proven size.  ``features`` is
    ``x`` from the binary column ``text``; it is made where the text lies, and of the rows of one id
    those with the least hash of it stays, which each task finds first among its own.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", features.alias("x"))
    return found.groupBy("doc_id", "label").agg(F.min_by("x", F.xxhash64("x")).alias("x"))


def in_one_task(rows: DataFrame) -> DataFrame:
    """The bounded sample in one task, in hash order."""
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def fit_rows(rows: Iterable[tuple[int, int, tuple[np.ndarray, np.ndarray]]], most: int = SAMPLE_ENTRIES) -> Model | None:
    """The calibrated model of rows (doc_id, label, sparse features), read once; every fifth calibrates.

    Rows count until they have ``most`` entries in all.
    """
    fitted, judged = Blocks(), Blocks()
    for doc_id, label, (index, value) in rows:
        most -= len(index)
        if most < 0:
            break
        (judged if crc32(str(doc_id).encode()) % 5 == 0 else fitted).add(index, value, label)
    if not fitted.mixed():
        fitted, judged = fitted.joined(judged), Blocks()
    if not fitted.mixed():
        return None
    weights, bias = fit_logistic(fitted.rows(), fitted.labels(), DIMS)
    held = judged if judged.labels().size else fitted
    slope, offset = fit_platt(bias + linear(held.rows(), weights), held.labels())
    return Model(weights.astype(np.float32), bias, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **columns) -> Model | None:
    """The calibrated model, or None where the sample has not both classes.

    Null and empty texts are rows without features; of repeated ids one row counts; ties in hash order
    go to the smaller id; empty tables have no classes.
    """

    @F.arrow_udf("struct<index:array<int>,value:array<float>>")
    def features(texts: pa.Array) -> pa.Array:
        index, value = zip(*[sparse(Text(t.as_py())) for t in texts], strict=True) if len(texts) else ((), ())
        lists = [pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
        return pa.StructArray.from_arrays(lists, ["index", "value"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for index, value in zip(column.field("index"), column.field("value"), strict=True):
                yield index.values.to_numpy(), value.values.to_numpy()

        model = fit_rows(
            row
            for batch in batches
            for row in zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), arrays(batch["x"]), strict=True)
        )
        if model:
            fields = [model.weights.tobytes(), model.bias, model.slope, model.offset]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in fields], ["weights", "bias", "slope", "offset"])

    got = in_one_task(sample(docs, labels, "quality", rows, features("text"), **columns))
    found = got.mapInArrow(train, "weights binary, bias double, slope double, offset double").collect()
    if not found:
        return None
    return Model(np.frombuffer(found[0]["weights"], np.float32), *found[0][1:])


_RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p_good double"


def with_quality(
    docs: DataFrame, model: Model | None, name: str = "quality", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the struct ``name``: the counts and ``p_good`` (1 without a model).

    Null and empty texts have zero counts.  Texts are read whole, very long ones too; repeated rows are
    judged alike, and an empty table stays empty.  Columns other than the text are not touched; pass a
    ``name`` that ``docs`` does not have.
    """
    spark = docs.sparkSession
    state = None if model is None else (model.weights, model.bias, model.slope, model.offset)
    sent = spark.sparkContext.broadcast(state)

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        known = sent.value and Model(*sent.value)
        rows = []
        for t in texts:
            text = Text(t.as_py())
            rows.append(counts(text) | {"p_good": known.probability(text) if known else 1.0})
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.array(rows, pa.struct([(x, pa.int64()) for x in names] + [("p_good", pa.float64())]))

    return docs.withColumn(name, judge(F.col(text_col).cast("binary")))


def base_failed(name: str = "quality"):
    words, again = F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words")
    return (words < LEAST_WORDS) | (again * 100 > words * REPEAT_PERCENT)


def kept(name: str = "quality"):
    return ~base_failed(name) & (F.col(f"{name}.p_good") >= KEEP_FROM)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept and p_good.

    Columns other than the two named are not read, so their names cannot clash; a ``p_good`` of just
    ``KEEP_FROM`` is kept.  Null and empty texts fail the base rules.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_quality(rows, model).select(
        "doc_id", "quality.*", base_failed().alias("base_failed"), kept().alias("kept")
    )
