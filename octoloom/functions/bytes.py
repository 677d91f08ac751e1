"""Byte colours, at row grain (a column of byte values) and at chunk grain (a column of binaries).

Both grains give the same values.  Row grain stays in generated code and suits sampled bytes; chunk
grain maps whole binaries through a 256-entry table in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Colours of the classes zero, 255, printable and other.  Fixed values.
CLASS_GREY = (0, 255, 55, 228)
CLASS_RGB = ((0, 0, 0), (255, 255, 255), (55, 126, 184), (228, 26, 28))
#: Printable bytes, both ends included.  Fixed values.
PRINTABLE = ((9, 13), (32, 126))
MASK_COLOUR = 255
CHANNELS = ("r", "g", "b")


def byte_at(data: Column, index: Column) -> Column:
    """The byte at a zero-based index, as an int; null past the end."""
    one = F.substr(data, index.cast("int") + 1, F.lit(1))
    return F.conv(F.nullif(F.hex(one), F.lit("")), 16, 10).cast("int")


def printable(b: Column) -> Column:
    low, high = PRINTABLE
    return b.between(*low) | b.between(*high)


def by_class(b: Column, zero, full, text, other) -> Column:
    return F.when(b == 0, zero).when(b == 255, full).when(printable(b), text).otherwise(other)


def class_grey(b: Column) -> Column:
    return by_class(b, *[F.lit(v) for v in CLASS_GREY])


def class_rgb(b: Column) -> Column:
    return F.struct(
        *[by_class(b, *[F.lit(p[k]) for p in CLASS_RGB]).alias(c) for k, c in enumerate(CHANNELS)]
    )


def magnitude(b: Column) -> Column:
    return b


def entropy_curve(v: Column) -> Column:
    """The contrast curve of entropy colours: ``(4v - 4v^2)^4``, not below zero."""
    return F.greatest(F.pow(v * 4 - v * v * 4, F.lit(4)), F.lit(0.0))


def hex_colour(spec: Column) -> Column:
    """``RRGGBB`` as three fractions; red where it is no such text."""

    def part(at: int) -> Column:
        return F.conv(F.substring(spec, at, 2), 16, 10).cast("double") / 255

    ok = F.coalesce(spec.rlike("^[0-9A-Fa-f]{6}$"), F.lit(False))
    return F.struct(
        F.when(ok, part(1)).otherwise(1.0).alias("r"),
        F.when(ok, part(3)).otherwise(0.0).alias("g"),
        F.when(ok, part(5)).otherwise(0.0).alias("b"),
    )


def class_table() -> np.ndarray:
    """The grey class colour of every byte value."""
    values = np.arange(256)
    text = np.zeros(256, bool)
    for low, high in PRINTABLE:
        text |= (values >= low) & (values <= high)
    return np.select([values == 0, values == 255, text], CLASS_GREY[:3], CLASS_GREY[3]).astype(np.uint8)


def rgb_table() -> np.ndarray:
    grey = class_table()
    palette = np.zeros((256, 3), np.uint8)
    for level, colour in zip(CLASS_GREY, CLASS_RGB, strict=True):
        palette[grey == level] = colour
    return palette


GREY_TABLES = {"class": class_table(), "magnitude": np.arange(256, dtype=np.uint8)}


def chunk_colours(data: Column, kind: str) -> Column:
    """A binary of equal length with the grey colour of each byte."""
    if kind not in GREY_TABLES:
        raise NotImplementedError(f"no chunk colour map named {kind!r}; there are {sorted(GREY_TABLES)}")
    table = GREY_TABLES[kind].tobytes()

    @F.arrow_udf("binary")
    def recolour(chunks: pa.Array) -> pa.Array:
        return pa.array([None if c is None else c.translate(table) for c in chunks.to_pylist()], pa.binary())

    return recolour(data)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("zero", "full", "text", "other")]))
def class_counts(chunks: pa.Array) -> pa.Array:
    """How many bytes of each class a binary has."""
    table = np.searchsorted(np.sort(CLASS_GREY), class_table())
    names = [("zero", "text", "other", "full")[k] for k in range(4)]
    rows = []
    for c in chunks.to_pylist():
        found = np.bincount(table[np.frombuffer(c or b"", np.uint8)], minlength=4)
        rows.append(dict(zip(names, found.tolist(), strict=True)))
    return pa.array(rows, pa.struct([(n, pa.int64()) for n in ("zero", "full", "text", "other")]))


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_counts(chunks: pa.Array) -> pa.Array:
    """How often a binary has each of the 256 byte values."""
    rows = [np.bincount(np.frombuffer(c or b"", np.uint8), minlength=256) for c in chunks.to_pylist()]
    return pa.array(rows, pa.list_(pa.int64()))


@F.arrow_udf(T.LongType())
def byte_sum(chunks: pa.Array) -> pa.Array:
    """The sum of a binary's byte values."""
    return pa.array([int(np.frombuffer(c or b"", np.uint8).sum(dtype=np.int64)) for c in chunks.to_pylist()], pa.int64())
