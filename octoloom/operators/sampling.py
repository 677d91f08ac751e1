"""Which bytes of a blob are painted where: the sample grids of the three layouts.

The grid is planned first and only sampled bytes are read: ``quads * size ** 2`` rows a blob, not a
row a byte.  All offsets are 64-bit and absolute, so quads are independent of each other and may be
drawn by different tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.bytes import byte_at
from ..functions.numbers import ceil_div, ceil_div_by, div
from .layout import check_size, curve, decoded, window_ranges

LAYOUTS = ("square", "unrolled", "unrolled_n")
DEFAULT_QUADS = 4
#: Pixels of a window that go to Python in a row at most.
RUN_PIXELS = 256
_SHOWN = pa.list_(pa.struct([("j", pa.int64()), ("byte_idx", pa.int64()), ("b", pa.int32()), ("x", pa.int32()), ("y", pa.int32())]))


def quad_count(n_bytes: Column, size: int, layout: str, step: int | None = None) -> Column:
    """Squares that a blob of ``n_bytes`` fills."""
    area = check_size(size) ** 2
    if layout == "square":
        quads = F.lit(1)
    elif layout == "unrolled":
        quads = F.lit(DEFAULT_QUADS) if step is None else ceil_div(n_bytes, step * area)
    elif layout == "unrolled_n":
        quads = ceil_div(n_bytes, area)
    else:
        raise NotImplementedError(f"no layout named {layout!r}; there are {LAYOUTS}")
    return quads.cast("long")


def quad_bounds(n_bytes: Column, quad: Column, size: int, layout: str, step: int | None = None) -> tuple[Column, Column]:
    """First byte of a quad's range, and the first after it.

    Without a step, the quads part the blob: each ends where the next begins.
    """
    area = size * size
    if layout == "square":
        return F.lit(0).cast("long"), n_bytes.cast("long")
    if layout == "unrolled" and step is None:
        return tuple(div(q * n_bytes, DEFAULT_QUADS) for q in (quad, quad + 1))
    width = area * (step if layout == "unrolled" else 1)
    return (quad * width).cast("long"), ((quad + 1) * width).cast("long")


def sample_index(start: Column, stop: Column, j: Column, size: int) -> Column:
    """``start + floor(j * (stop - start) / size ** 2)`` in whole numbers."""
    return start + div(j * (stop - start), size * size)


def _check_step(step: int | None) -> None:
    if step is not None and step < 1:
        raise ValueError("step must be at least 1")


def _first_at(offset: Column, start: Column, width: Column, area: int) -> Column:
    """The first ``j`` whose sample stands at ``offset`` or after it."""
    at = F.greatest(offset - start, F.lit(0).cast("long"))
    return F.when(width > 0, F.least(ceil_div_by(at * area, width), F.lit(area).cast("long"))).otherwise(
        F.when(at > 0, F.lit(area).cast("long")).otherwise(F.lit(0).cast("long"))
    )


def strips(chunks: DataFrame, size: int, layout: str = "unrolled", step: int | None = None) -> DataFrame:
    """(blob_id, quad, first_j, n_j, start, width, samples): what each chunk gives to each quad.

    ``chunks`` has blob_id, n_bytes, byte_start and data.  A strip is a run of pixels whose samples all
    lie in one chunk, so it holds at most a chunk or a quad.  Pixels past the end of a blob have no
    strip.  A chunk reaches few quads: those whose range meets its own.
    """
    return _picked(planned(chunks, size, layout, step), check_size(size) ** 2)


def planned(chunks: DataFrame, size: int, layout: str, step: int | None) -> DataFrame:
    """Which pixels (first_j, n_j) of which quads each chunk gives, before any byte is looked at."""
    _check_step(step)
    area = check_size(size) ** 2
    n, first, end = F.col("n_bytes"), F.col("byte_start"), F.col("byte_start") + F.octet_length("data")
    last = quad_count(n, size, layout, step) - 1
    if layout == "square":
        low = high = F.lit(0).cast("long")
    elif layout == "unrolled" and step is None:
        # floors part the blob, so look one quad further on both sides
        low = F.greatest(div(first * DEFAULT_QUADS, n) - 1, F.lit(0).cast("long"))
        high = F.least(div(end * DEFAULT_QUADS, n) + 1, last)
    else:
        wide = area * (step if layout == "unrolled" else 1)
        low, high = div(first, wide), F.least(div(end - 1, wide), last)
    met = chunks.where("n_bytes > 0").select("*", end.alias("_end"), F.explode(F.sequence(low, high)).alias("quad"))
    start, stop = quad_bounds(n, F.col("quad"), size, layout, step)
    met = met.select("*", start.alias("start"), (stop - start).alias("width"))
    first_j, end_j = (
        _first_at(F.col(c), F.col("start"), F.col("width"), area) for c in ("byte_start", "_end")
    )
    return met.select("*", first_j.alias("first_j"), (end_j - first_j).alias("n_j")).where("n_j > 0 AND start < n_bytes")


def _picked(met: DataFrame, area: int) -> DataFrame:
    @F.arrow_udf("binary")
    def pick(data: pa.Array, at: pa.Array, a: pa.Array, w: pa.Array, j: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for d, *numbers in zip(*[c.to_pylist() for c in (data, at, a, w, j, k)], strict=True):
            begin, zero, width, first, count = numbers
            index = zero - begin + np.arange(first, first + count, dtype=np.int64) * width // area
            out.append(np.frombuffer(d, np.uint8)[index].tobytes())
        return pa.array(out, pa.binary())

    samples = pick("data", "byte_start", "start", "width", "first_j", "n_j").alias("samples")
    return met.select("blob_id", "n_bytes", "quad", "first_j", "n_j", "start", "width", samples)


def _grid_of_chunks(chunks: DataFrame, size: int, layout: str, step: int | None) -> DataFrame:
    area = size * size
    found = strips(chunks, size, layout, step)
    known = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_j") - 1)).alias("_k"))
    known = known.select(
        "blob_id", "quad", (F.col("first_j") + F.col("_k")).alias("j"), "start", "width", byte_at(F.col("samples"), F.col("_k")).alias("b")
    )
    # the last chunk of a blob gives the pixels past the blob's end
    ends = chunks.where(F.col("byte_start") + F.octet_length("data") == F.col("n_bytes")).where("n_bytes > 0")
    quad = quad_count(F.col("n_bytes"), size, layout, step) - 1
    ends = ends.select("blob_id", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), quad)).alias("quad"))
    start, stop = quad_bounds(F.col("n_bytes"), F.col("quad"), size, layout, step)
    ends = ends.select("*", start.alias("start"), (stop - start).alias("width"))
    past = _first_at(F.col("n_bytes"), F.col("start"), F.col("width"), area)
    ends = ends.select("*", past.alias("_past")).where(F.col("_past") < area)
    j = F.explode(F.sequence(F.col("_past"), F.lit(area - 1).cast("long"))).alias("j")
    rest = ends.select("blob_id", "quad", j, "start", "width", F.lit(None).cast("int").alias("b"))
    at = (F.col("start") + div(F.col("j") * F.col("width"), area)).alias("byte_idx")
    return known.unionByName(rest).select("blob_id", "quad", "j", at, "b")


def grid(blobs: DataFrame, size: int, layout: str = "unrolled", step: int | None = None) -> DataFrame:
    """(blob_id, quad, j, byte_idx, b) of every pixel; ``b`` is null past the end of the blob.

    ``blobs`` has blob_id and data (binary), a whole blob a row, or is a table of chunks (see
    ``strips``), where no row holds more than a chunk.  Empty blobs have no pixels.  ``j`` runs along
    the curve inside a quad.
    """
    _check_step(step)
    if "byte_start" in blobs.columns:
        return _grid_of_chunks(blobs, check_size(size), layout, step)
    known = blobs.select("blob_id", "data", F.octet_length("data").cast("long").alias("n_bytes")).where("n_bytes > 0")
    quads = known.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), quad_count(F.col("n_bytes"), size, layout, step) - 1)).alias("quad")
    )
    start, stop = quad_bounds(F.col("n_bytes"), F.col("quad"), size, layout, step)
    ranged = quads.select("blob_id", "data", "n_bytes", "quad", start.alias("start"), stop.alias("stop"))
    pixels = ranged.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size * size - 1).cast("long"))).alias("j"))
    pixels = pixels.withColumn("byte_idx", sample_index(F.col("start"), F.col("stop"), F.col("j"), size))
    b = F.when(F.col("byte_idx") < F.col("n_bytes"), byte_at(F.col("data"), F.col("byte_idx")))
    return pixels.select("blob_id", "quad", "j", "byte_idx", b.alias("b"))


def window(
    blobs: DataFrame,
    size: int,
    x: int,
    y: int,
    width: int,
    height: int,
    curve_name: str = "hilbert",
    layout: str = "unrolled",
    step: int | None = None,
) -> DataFrame:
    """(blob_id, quad, j, x, y, byte_idx, b) of the pixels of a window of each image, where quads stand below each other.

    The window is cut into runs of the curve, and of a blob only the bytes between a run's first and
    last sample are taken; of chunks, only those that have samples of a run go on.  Pixels past the end of a
    blob are left out.  ``blobs`` are whole blobs or chunks, as for ``grid``.
    """
    area = check_size(size) ** 2
    runs = []
    for quad in range(max(y, 0) // size, -(-(y + height) // size)):
        runs += [(quad, a, b) for a, b in window_ranges(curve_name, size, x, y - quad * size, width, height)]
    if "byte_start" in blobs.columns:
        pieces = blobs.select("blob_id", "n_bytes", "byte_start", "data")
    else:
        n = F.octet_length("data").cast("long")
        pieces = blobs.select("blob_id", n.alias("n_bytes"), F.lit(0).cast("long").alias("byte_start"), "data")
    listed = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("qab", run, strict=True)]) for run in runs])
    if not runs:
        listed = F.array().cast("array<struct<q:long,a:long,b:long>>")
    met = planned(pieces, size, layout, step)
    end = F.col("first_j") + F.col("n_j")
    own = F.filter(listed, lambda r: (r["q"] == F.col("quad")) & (r["a"] < end) & (r["b"] > F.col("first_j")))

    def parts(run: Column) -> Column:
        """The run in stretches, each with the bytes from its first sample to its last."""
        first, last = F.greatest(run["a"], F.col("first_j")), F.least(run["b"], end)

        def part(j: Column) -> Column:
            count = F.least(F.lit(RUN_PIXELS).cast("long"), last - j)
            at = [F.col("start") + div(k * F.col("width"), area) - F.col("byte_start") for k in (j, j + count - 1)]
            held = F.substr("data", (at[0] + 1).cast("int"), (at[1] - at[0] + 1).cast("int"))
            return F.struct(j.alias("first"), count.alias("count"), held.alias("part"))

        return F.transform(F.sequence(first, last - 1, F.lit(RUN_PIXELS).cast("long")), part)

    cut = met.select("blob_id", "quad", "start", "width", F.inline(F.flatten(F.transform(own, parts))))
    seen = cut.select("blob_id", "quad", F.inline(_shown(curve_name, size)("part", "first", "count", "start", "width")))
    return seen.select("blob_id", "quad", "j", "byte_idx", "b", "x", (F.col("y") + F.col("quad") * size).cast("long").alias("y"))


def _shown(curve_name: str, size: int):
    """The pixels of stretches of a curve, all stretches of a batch at once."""
    area = size * size

    @F.arrow_udf(from_arrow_type(_SHOWN))
    def shown(part: pa.Array, first: pa.Array, count: pa.Array, start: pa.Array, width: pa.Array) -> pa.Array:
        first, count, start, width = (c.to_numpy() for c in (first, count, start, width))
        ends = np.cumsum(count)
        row = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(row)) - (ends - count)[row] + first[row]
        index = start[row] + j * width[row] // area
        begin = start + first * width // area
        sizes = np.fromiter(map(len, held := part.to_pylist()), np.int64, len(part))
        data = np.frombuffer(b"".join(held), np.uint8)
        at = decoded(curve_name, j, size)
        b = data[(np.cumsum(sizes) - sizes - begin)[row] + index].astype(np.int32)
        pixels = pa.StructArray.from_arrays([pa.array(c) for c in (j, index, b, at[:, 0].copy(), at[:, 1].copy())], fields=list(_SHOWN.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pixels)

    return shown


def place(pixels: DataFrame, size: int, curve_name: str = "hilbert") -> DataFrame:
    """``pixels`` with x and y in the image, where quads stand one below the other."""
    at = curve(curve_name, F.col("j"), size)
    placed = pixels.withColumn("_at", at)
    return placed.select(
        *pixels.columns, F.col("_at.x").alias("x"), (F.col("_at.y") + F.col("quad") * size).cast("long").alias("y")
    )
