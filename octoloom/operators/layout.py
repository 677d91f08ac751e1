"""Space-filling curves: position on the curve to (x, y)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import div


def check_size(size: int) -> int:
    if not isinstance(size, int) or isinstance(size, bool) or size < 1:
        raise ValueError(f"size must be a positive whole number, not {size!r}")
    return size


def _bits(size: int) -> int:
    bits = check_size(size).bit_length() - 1
    if 1 << bits != size:
        raise ValueError(f"a Hilbert curve needs a power of two, not {size}")
    return bits


def zigzag(d: Column, size: int) -> Column:
    """Serpentine: x grows each ``size`` steps, y runs to and fro."""
    check_size(size)
    x = div(d, size).cast("int")
    y = F.pmod(d, F.lit(size)).cast("int")
    return F.struct(x.alias("x"), F.when(x % 2 == 1, size - 1 - y).otherwise(y).alias("y"))


def hilbert(d: Column, size: int) -> Column:
    """Hilbert's curve, decoded with one bit more than the size has.

    The quadrants are unfolded from the smallest square up, two bits of ``d`` at each level.
    """
    levels = F.array([F.lit(1 << k) for k in range(_bits(size) + 1)])
    zero = F.lit(0)
    start = F.struct(zero.alias("x"), zero.alias("y"), d.cast("long").alias("rest"))

    def unfold(s: Column, side: Column) -> Column:
        across = F.shiftright(s["rest"], 1).bitwiseAND(1).cast("int")
        up = s["rest"].bitwiseAND(1).cast("int").bitwiseXOR(across)
        flip = (up == 0) & (across == 1)
        x = F.when(flip, side - 1 - s["x"]).otherwise(s["x"])
        y = F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        return F.struct(
            (F.when(up == 0, y).otherwise(x) + side * across).alias("x"),
            (F.when(up == 0, x).otherwise(y) + side * up).alias("y"),
            F.shiftright(s["rest"], 2).alias("rest"),
        )

    return F.aggregate(levels, start, unfold, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def hilbert_index(x: Column, y: Column, size: int) -> Column:
    """The position on Hilbert's curve of (x, y): ``hilbert`` undone, from the largest square down."""
    sides = F.array([F.lit(1 << k) for k in range(_bits(size), -1, -1)])
    start = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(0).cast("long").alias("d"))

    def fold(s: Column, side: Column) -> Column:
        across, up = (s["x"] >= side).cast("int"), (s["y"] >= side).cast("int")
        x, y = s["x"] - side * across, s["y"] - side * up
        flip = (up == 0) & (across == 1)
        first, second = F.when(up == 0, y).otherwise(x), F.when(up == 0, x).otherwise(y)
        return F.struct(
            F.when(flip, side - 1 - first).otherwise(first).alias("x"),
            F.when(flip, side - 1 - second).otherwise(second).alias("y"),
            (s["d"] * 4 + across * 2 + up.bitwiseXOR(across)).alias("d"),
        )

    return F.aggregate(sides, start, fold, lambda s: s["d"])


def _place(x: int, y: int, bits: int) -> int:
    """The same of whole numbers."""
    d = 0
    for k in range(bits, -1, -1):
        side = 1 << k
        across, up = int(x >= side), int(y >= side)
        x, y = x - side * across, y - side * up
        if not up:
            x, y = y, x
            if across:
                x, y = side - 1 - x, side - 1 - y
        d = d * 4 + across * 2 + (up ^ across)
    return d


def window_ranges(name: str, size: int, x: int, y: int, width: int, height: int) -> list[tuple[int, int]]:
    """The runs [first, last) of the curve that make up a window of the square, in order.

    An aligned square of 2^k pixels a side is one run of a Hilbert curve, so a window is cut into the
    largest of them: their number goes with its edge, not with its area.  Of a zigzag each column is a run.
    """
    check_size(size)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + width, size), min(y + height, size)
    runs: list[tuple[int, int]] = []
    if x0 >= x1 or y0 >= y1:
        return runs
    if name == "zigzag":
        for column in range(x0, x1):
            low, high = (size - y1, size - y0) if column % 2 else (y0, y1)
            runs.append((column * size + low, column * size + high))
    elif name == "hilbert":
        bits = _bits(size)
        squares = [(0, 0, bits)]
        while squares:
            left, top, k = squares.pop()
            side = 1 << k
            if left >= x1 or top >= y1 or left + side <= x0 or top + side <= y0:
                continue
            if x0 <= left and y0 <= top and left + side <= x1 and top + side <= y1:
                first = _place(left, top, bits) >> 2 * k << 2 * k
                runs.append((first, first + (1 << 2 * k)))
            else:
                half = side // 2
                squares += [(left + a * half, top + b * half, k - 1) for a in (0, 1) for b in (0, 1)]
    else:
        raise NotImplementedError(f"no curve named {name!r}; there are {sorted(CURVES)}")
    merged: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if merged and merged[-1][1] == first:
            merged[-1] = (merged[-1][0], last)
        else:
            merged.append((first, last))
    return merged


#: Curves by name.
CURVES = {"hilbert": hilbert, "zigzag": zigzag}


def curve(name: str, d: Column, size: int) -> Column:
    if name not in CURVES:
        raise NotImplementedError(f"no curve named {name!r}; there are {sorted(CURVES)}")
    return CURVES[name](d, size)


def layout_table(spark: SparkSession, name: str, size: int) -> DataFrame:
    """(d, x, y) of a whole square; ``size ** 2`` rows, however many blobs are drawn."""
    positions = spark.range(size * size).select(F.col("id").alias("d"))
    return positions.select("d", curve(name, F.col("d"), size).alias("p")).select("d", "p.x", "p.y")


def positions(name: str, size: int) -> np.ndarray:
    """The same layout as an array of (x, y) rows, for chunk kernels."""
    return decoded(name, np.arange(check_size(size) ** 2, dtype=np.int64), size)


def decoded(name: str, d: np.ndarray, size: int) -> np.ndarray:
    """(x, y) rows of any positions on the curve."""
    if name == "zigzag":
        x, y = d // size, d % size
        return np.stack([x, np.where(x % 2 == 1, size - 1 - y, y)], 1).astype(np.int32)
    if name != "hilbert":
        raise NotImplementedError(f"no curve named {name!r}; there are {sorted(CURVES)}")
    x, y = np.zeros_like(d), np.zeros_like(d)
    for k in range(_bits(size) + 1):
        across = (d >> 1) & 1
        up = (d & 1) ^ across
        side = 1 << k
        flip = (up == 0) & (across == 1)
        x, y = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(up == 0, y, x) + side * across, np.where(up == 0, x, y) + side * up
        d = d >> 2
    return np.stack([x, y], 1).astype(np.int32)
