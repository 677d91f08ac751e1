"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and the beginnings of them, hashed to a fixed number of
columns.  The score adds a weight for each term and, for each pair of terms, the product of their
factor vectors, so that a pair such as an insult with a mention of a group counts beyond its parts.
With binary terms the pair sum is ``(|sum of v|^2 - sum of |v|^2) / 2``: linear in the terms.

Columns take part if their presence depends on the label in the sample (a chi-square of
``LEAST_CHI2``), or if that of a pair does and its parts say much less (``LEAST_PAIR_CHI2``), and weights
are shrunk, so the thousands of ordinary words of a long text do not drown or imitate a few telling
ones.  Terms of a bounded sample of labelled rows are made where the texts lie, and one task fits
them; tasks score Arrow batches with tables of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import words_of
from .logistic import adam, fit_platt, owners, sigmoid, stack
from .quality import in_one_task, sample

#: Labelled ids that the fit takes at most (those first in hash order), one row each.
SAMPLE_ROWS = 16_000
#: Terms that the fit holds at most; rows after it do not count.
SAMPLE_TERMS = 16_000_000
TOXIC_FROM = 0.3
BITS = 18
FACTORS = 4
STARTS = (4, 6)
LEAST_CHI2 = 12.0
#: Pairs are looked for among so many columns, those most frequent in rows of label 1.
PAIR_COLUMNS, LEAST_PAIR_CHI2 = 1_024, 60.0
STEPS, BATCH_ROWS = 300, 2_048
#: A row is held out where crc32(doc_id as text) leaves this remainder.
FOLDS, HELD_OUT = 4, 2

_MASK = (1 << BITS) - 1


class Columns(dict):
    """The columns of a word and its beginnings (UTF-8 bytes), by word; forgotten when there are many."""

    MOST = 1 << 18

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.MOST:
            self.clear()
        keys = [word, *(word[:n] + b"*" for n in STARTS if len(word) > n)]
        self[word] = found = tuple(crc32(k) & _MASK for k in keys)
        return found


def terms(data: bytes | None, columns: Columns) -> np.ndarray:
    """Sorted distinct columns of a text's words and word beginnings."""
    found = set().union(*map(columns.__getitem__, set(words_of(data))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class Model:
    columns: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, index: np.ndarray) -> float:
        slots = self.columns[index]
        slots = slots[slots >= 0]
        v = self.factors[slots]
        pairs = 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(self.bias + self.weights[slots].sum() + pairs)

    def probability(self, index: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.raw(index) + self.offset))


def _dependence(up: np.ndarray, down: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Chi-square of presence and label, from how many rows of label 1 and of label 0 have it."""
    n, positive = len(labels), labels.sum()
    seen = up + down
    spread = seen * (n - seen) * (positive / n) * (1 - positive / n) / n
    return np.where(spread > 0, (up - seen * positive / n) ** 2 / np.maximum(spread, 1e-12), 0.0)


def telling_columns(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Sorted columns that take part: on their own account, or with another."""
    hit = [np.concatenate([r for r, y in zip(rows, labels, strict=True) if bool(y > 0) is k]) for k in (True, False)]
    up, down = (np.bincount(h, minlength=1 << BITS).astype(float) for h in hit)
    alone = _dependence(up, down, labels)
    used = np.flatnonzero(alone >= LEAST_CHI2)

    often = np.argsort(-up, kind="stable")[:PAIR_COLUMNS]
    often = often[up[often] > 0]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[often] = np.arange(len(often))
    both = {True: np.zeros((len(often), len(often)), np.float32), False: np.zeros((len(often), len(often)), np.float32)}
    for k in both:
        some = [r for r, y in zip(rows, labels, strict=True) if bool(y > 0) is k]
        for at in range(0, len(some), _PAIR_ROWS):
            block = np.zeros((len(some[at : at + _PAIR_ROWS]), len(often)), np.float32)
            for row, r in zip(block, some[at : at + _PAIR_ROWS], strict=True):
                mine = slot[r]
                row[mine[mine >= 0]] = 1
            both[k] += block.T @ block
    paired = _dependence(both[True].astype(float), both[False].astype(float), labels)
    parts = np.maximum(alone[often][:, None], alone[often][None, :])
    more = (paired >= LEAST_PAIR_CHI2) & (paired >= 2 * parts)
    return np.union1d(used, often[more.any(1)])


_PAIR_ROWS = 1_024


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, apart: np.ndarray, steps: int = STEPS) -> Model:
    """The machine on rows not ``apart``, calibrated on those that are."""
    fitted = [r for r, a in zip(rows, apart, strict=True) if not a]
    y = labels[~apart]
    used = telling_columns(fitted, y)
    columns = np.full(1 << BITS, -1, np.int32)
    columns[used] = np.arange(len(used))
    slots = [(s := columns[r])[s >= 0] for r, a in zip(rows, apart, strict=True) if not a]
    dims, up = len(used), max(1, y.sum())
    blocks = []
    for at in range(0, len(slots), BATCH_ROWS):
        part = slots[at : at + BATCH_ROWS]
        index, _, sizes = stack([(s, np.ones(len(s))) for s in part])
        blocks.append((index, owners(sizes), y[at : at + BATCH_ROWS]))
    turn = 0

    def gradient(params):
        nonlocal turn
        index, owner, goal = blocks[turn % len(blocks)]
        turn += 1
        w, v, b = params
        n, at = len(goal), v[index]
        sums = np.stack([np.bincount(owner, weights=at[:, f], minlength=n) for f in range(FACTORS)], 1)
        squares = np.bincount(owner, weights=(at**2).sum(1), minlength=n)
        z = b[0] + np.bincount(owner, weights=w[index], minlength=n) + 0.5 * ((sums**2).sum(1) - squares)
        # both classes weigh alike over all rows
        balance = np.where(goal > 0, 0.5 / up, 0.5 / max(1, len(y) - up)) * len(y) / n
        off = (sigmoid(z) - goal) * balance
        each = off[owner]
        pull = (sums[owner] - at) * each[:, None]
        gv = np.stack([np.bincount(index, weights=pull[:, f], minlength=dims) for f in range(FACTORS)], 1)
        gw = np.bincount(index, weights=each, minlength=dims)
        return [gw + 1e-3 * w, gv + 1e-2 * v, np.array([off.sum()])]

    start = np.random.default_rng(7).normal(0, 0.05, (dims, FACTORS))
    w, v, b = adam([np.zeros(dims), start, np.zeros(1)], gradient, steps, 0.05, falling=True)
    model = Model(columns, w.astype(np.float32), v.astype(np.float32), float(b[0]), 1.0, 0.0)
    held = apart if apart.any() else ~apart
    scores = np.array([model.raw(r) for r, a in zip(rows, held, strict=True) if a])
    model.slope, model.offset = fit_platt(scores, labels[held])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit_sample(
    rows: Iterable[tuple[int, int, np.ndarray]], most: int = SAMPLE_TERMS, steps: int = STEPS
) -> Model | None:
    """The machine from (doc_id, label, columns), every fifth row set apart; None without both classes."""
    ids, labels, x = [], [], []
    for doc_id, label, columns in rows:
        most -= len(columns)
        if most < 0:
            break
        ids.append(doc_id)
        labels.append(float(label))
        x.append(columns)
    y = np.array(labels)
    if not 0 < y.sum() < len(y):
        return None
    apart = np.array([crc32(str(i).encode()) % 5 == 0 for i in ids])
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    return fit_rows(x, y, apart, steps)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **columns) -> Model | None:
    """The machine from labelled rows that are not held out; None where they have not both classes.

    Null and empty texts are rows without terms; of repeated ids one row counts; empty tables have no
    classes.
    """

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        known = Columns()
        return pa.array([terms(t.as_py(), known) for t in texts], pa.list_(pa.int32()))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_sample(
            row
            for batch in batches
            for row in zip(
                batch["doc_id"].to_pylist(),
                batch["label"].to_pylist(),
                (x.values.to_numpy() for x in batch["x"]),
                strict=True,
            )
        )
        if model:
            arrays = [a.tobytes() for a in (model.columns, model.weights, model.factors)]
            fields = [*arrays, model.bias, model.slope, model.offset]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in fields], _FIELDS)

    got = sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", rows, hashed("text"), **columns)
    kinds = ["binary"] * 3 + ["double"] * 3
    schema = ", ".join(f"{n} {k}" for n, k in zip(_FIELDS, kinds, strict=True))
    found = in_one_task(got).mapInArrow(train, schema).collect()
    if not found:
        return None
    factors = np.frombuffer(found[0]["factors"], np.float32).reshape(-1, FACTORS)
    return Model(
        np.frombuffer(found[0]["columns"], np.int32), np.frombuffer(found[0]["weights"], np.float32), factors, *found[0][3:]
    )


_FIELDS = ["columns", "weights", "factors", "bias", "slope", "offset"]


def with_score(docs: DataFrame, model: Model | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the double ``name``, from 0 to 1; 0 throughout without a model.

    Only the text is read, whole, very long ones too.  Null and empty texts have no terms and get the
    bias alone.  Repeated rows score alike, and an empty table stays empty.  Pass a ``name`` that
    ``docs`` does not have.
    """
    state = None if model is None else astuple(model)
    sent = docs.sparkSession.sparkContext.broadcast(state)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known, columns = sent.value and Model(*sent.value), Columns()
        return pa.array([known.probability(terms(t.as_py(), columns)) if known else 0.0 for t in texts], pa.float64())

    return docs.withColumn(name, score(F.col(text_col).cast("binary")))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Repeated rows score alike; a score of just ``TOXIC_FROM`` is predicted 1; a null id is not held out;
    an empty table gives no rows.  Columns other than the two named are not read, so their names
    cannot clash.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(rows, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
