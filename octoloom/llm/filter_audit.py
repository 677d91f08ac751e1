"""How five text filters interact: order effects and exact Shapley shares.

Each row gets a five-bit mask of the filters that it fails.  Everything asked for follows from the
number of rows of each mask in a part, so the corpus is read once and what is left is at most 32
rows a part.  From these counts comes the part's *removal polynomial*, the multilinear extension of
"rows removed by a set of filters": with filter i applied with probability x_i,

    f(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)).

A corner of the cube is a set of filters, so f at corners gives what survives each step of each
order.  The partial derivative by x_i along the diagonal, integrated from 0 to 1 in exact rationals,
is filter i's Shapley value; times 120 it is the number of rows that it removes, summed over all orders.

The fifth filter (text seen at a smaller id) needs the table: the smallest id of each text's SHA-256 is
found by a pre-aggregated minimum and matched back by (hash, id), so that a text that a third of all
rows share is spread by their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Per cent of words that must be distinct, and of code points that may be capitals.
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(0x41, 0x5B))
_ORDERS = 120
_MASKS = 1 << len(FILTERS)
_LAST = 1 << len(FILTERS) - 1


def text_mask(data: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails; ``bytes.split`` cuts at space and 0x09-0x0D alone."""
    words = data.split()
    code_points = int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * code_points,
        len(data.translate(None, MARKS)) < len(data),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


_FACTS = pa.struct([("mask", pa.int32()), ("digest", pa.binary())])


@F.arrow_udf(T.StructType([T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]))
def _facts(texts: pa.Array) -> pa.Array:
    data = (t.as_py() or b"" for t in texts)
    return pa.array([{"mask": text_mask(d), "digest": hashlib.sha256(d).digest()} for d in data], _FACTS)


def _any(flag: Column) -> Column:
    return F.max(F.coalesce(flag, F.lit(False)).cast("long"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each mask in each part, and how many of them are labelled so.

    ``part`` is lang, null as the empty string.  Null texts count as empty.  A row without an id repeats
    nothing, is repeated by nothing and has no label; rows equal in id and text are not copies of
    each other.  An id with several labels is good (toxic) if any of them says so.
    """
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), _facts(F.col("text").cast("binary")).alias("facts")
    )
    keys = ["doc_id", "part", "digest", "mask"]
    rows = cut(rows.select("doc_id", "part", "facts.*").groupBy(*keys).agg(F.count("*").alias("n")))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.where("doc_id IS NOT NULL")
    flags = labels.groupBy("doc_id").agg(_any(F.col("quality") == 1).alias("good"), _any(F.col("toxic") == 1).alias("toxic"))
    repeated = F.when(F.col("first").isNull(), F.lit(_LAST)).otherwise(F.lit(0))
    judged = named.join(firsts, ["doc_id", "digest"], "left").join(flags, "doc_id", "left")
    zero = F.lit(0).cast("long")
    columns = ("part", "mask", "n", "good", "toxic")
    judged = judged.select(
        "part",
        F.col("mask").bitwiseOR(repeated).alias("mask"),
        "n",
        (F.col("n") * F.coalesce("good", zero)).alias("good"),
        (F.col("n") * F.coalesce("toxic", zero)).alias("toxic"),
    )
    nameless = rows.where("doc_id IS NULL").select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    both = judged.unionByName(nameless.select(*columns))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by monomial (a bit for each x_i) of f, from rows by mask.

    1 - product of (1 - x_i) over a mask has -(-1)^|s| at each non-empty subset s of the mask, so the
    coefficient of s sums the counts of the masks that hold s.
    """
    above = list(counts)
    for bit in range(len(FILTERS)):
        for s in range(_MASKS):
            if not s >> bit & 1:
                above[s] += above[s | 1 << bit]
    return [0] + [above[s] if s.bit_count() % 2 else -above[s] for s in range(1, _MASKS)]


def at_corner(polynomial: list[int], chosen: int) -> int:
    """The polynomial where the chosen variables are 1 and the others 0."""
    return sum(c for s, c in enumerate(polynomial) if s & chosen == s)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """Integral over t from 0 to 1 of the derivative by x_i at (t, ..., t)."""
    along: dict[int, int] = {}
    for s, c in enumerate(polynomial):
        if s >> i & 1:
            degree = s.bit_count() - 1
            along[degree] = along.get(degree, 0) + c
    return sum((Fraction(c, degree + 1) for degree, c in along.items()), Fraction(0))


def part_rows(counts: list[int], good: list[int], toxic: list[int]) -> Iterator[dict]:
    """The 600 rows of one part: each step of each order of the filters."""
    rows, good, toxic = (removal_polynomial(c) for c in (counts, good, toxic))
    total, everything = sum(counts), _MASKS - 1
    corners = [[at_corner(p, s) for s in range(_MASKS)] for p in (rows, good, toxic)]
    shares = []
    for i in range(len(FILTERS)):
        share = shapley(rows, i) * _ORDERS
        assert share.denominator == 1
        shares.append(share.numerator)
    gone, good_gone, toxic_gone = corners
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield {
                "filter_order": "".join(FILTERS[k] for k in order),
                "step": step,
                "kept": total - gone[after],
                "removed": removed,
                "redundant": gone[1 << i] - removed,
                "unique_fails": gone[everything] - gone[everything ^ 1 << i],
                "good_lost": good_gone[after] - good_gone[before],
                "toxic_lost": toxic_gone[after] - toxic_gone[before],
                "shapley": shares[i],
            }
            before = after


_LONGS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _LONGS)
_REPORT_ARROW = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _LONGS)]
)


def _part(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    by_kind = {c: [0] * _MASKS for c in ("n", "good", "toxic")}
    for row in table.to_pylist():
        for c, counts in by_kind.items():
            counts[row["mask"]] = row[c]
    rows = part_rows(by_kind["n"], by_kind["good"], by_kind["toxic"])
    return pa.Table.from_pylist([{"part": key[0].as_py(), **r} for r in rows], _REPORT_ARROW)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: what the step keeps, removes and finds removed.

    Parts are the values of lang (null: the empty string).  Null and empty texts have no words: they fail
    A alone, and E where a smaller id has no text either.  Texts of any length are read whole.  Repeated rows count
    each; for ids see ``mask_counts``.  An empty table has no parts and gives no rows; without labels
    good_lost and toxic_lost are zero.  Other columns are not read, so their names cannot clash.
    """
    return mask_counts(docs, labels).groupBy("part").applyInArrow(_part, _REPORT)
