"""Local and whole-blob Shannon entropy of bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sampling
from .layout import check_size

WINDOW = 32
SYMBOLS = 256


def window_entropy(pixels: DataFrame) -> DataFrame:
    """``pixels`` (blob_id, quad, j, byte_idx, b) with ``entropy``, 0 to 1.

    The frame holds 16 samples before to 15 after inside the quad; places outside it, and samples
    past the end of a blob, count as byte 0.  The base of the logarithm is the window, so quads
    need at least that many samples.  A group is the samples of one quad, whose number a layout fixes.
    """
    row = F.struct("j", "byte_idx", "b")
    quads = pixels.groupBy("blob_id", "quad").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    values = F.transform("_rows", lambda r: F.coalesce(r["b"], F.lit(0)).cast("short"))
    rows = quads.select("blob_id", "quad", F.explode(F.arrays_zip("_rows", quad_entropy(values).alias("_h"))).alias("_z"))
    return rows.select("blob_id", "quad", "_z._rows.*", F.col("_z._h").alias("entropy"))


#: Keeps a sum of logarithms that should be a whole step of the colour from falling just below it.
NUDGE = 1e-9


def entropy_colours(entropy: Column) -> Column:
    """Red by entropy, blue by its square."""
    top = F.least(entropy, F.lit(1.0))
    return F.struct(
        F.floor(top * 255 + NUDGE).cast("int").alias("r"),
        F.lit(0).alias("g"),
        F.floor(top * top * 255 + NUDGE).cast("int").alias("b"),
    )


def entropy_levels(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same red and blue of one quad's samples, for chunk kernels."""
    top = np.minimum(window_entropy_kernel(samples), 1.0)
    return np.floor(top * 255 + NUDGE), np.floor(top * top * 255 + NUDGE)


#: Terms c ln c of a window's 256 counts, in whole steps of 2^-40, so that adding and taking off leaves no rounding behind.
_TERMS = np.array([0] + [round(c * math.log(c) * (1 << 40)) for c in range(1, WINDOW + 1)], np.int64)
#: Samples whose counts are held at once.
SLICE = 1 << 16


def _slice_entropy(framed: np.ndarray) -> np.ndarray:
    """Entropy of each full window of ``framed``, from the window before it.

    A step takes one byte off a histogram and adds one, so the sum of its terms moves by two differences of
    ``_TERMS``.  They need the count of the byte that goes, in the window that it heads, and of the byte
    that comes, in the window that it ends: places of equal bytes within a window's reach, found for
    all steps at once in the order (byte, place).
    """
    n, reach = len(framed), WINDOW - 1
    order = np.argsort(framed, kind="stable")
    keys = framed[order].astype(np.int64) * (n + WINDOW) + order
    rank = np.arange(n)
    ahead, back = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(keys, keys + reach, "right") - rank
    back[order] = rank - np.searchsorted(keys, keys - reach) + 1
    gone, come = ahead[: n - WINDOW], back[WINDOW:]
    sums = np.empty(n - reach, np.int64)
    sums[0] = _TERMS[np.bincount(framed[:WINDOW])].sum()
    sums[1:] = _TERMS[gone - 1] - _TERMS[gone] + _TERMS[come] - _TERMS[come - 1]
    return 1.0 - np.cumsum(sums) / _TERMS[WINDOW]


def window_entropy_kernel(samples: np.ndarray, before: bytes = b"", after: bytes = b"") -> np.ndarray:
    """The same entropy of a run of one quad's samples, for chunk kernels.

    ``before`` and ``after`` are the samples beside the run, as far as the quad has any: its halo.  The
    run is worked through in slices of ``SLICE`` samples, each with a halo of its own.
    """
    half = WINDOW // 2
    framed = np.zeros(len(samples) + WINDOW - 1, np.uint8)
    framed[half : half + len(samples)] = samples
    for halo, at in ((before[-half:], half - min(half, len(before))), (after[: half - 1], half + len(samples))):
        framed[at : at + len(halo)] = np.frombuffer(halo, np.uint8)
    out = np.empty(len(samples))
    for first in range(0, len(samples), SLICE):
        last = min(first + SLICE, len(samples))
        out[first:last] = _slice_entropy(framed[first : last + WINDOW - 1])
    return out


#: Pixels that a task hands on at once.
BATCH_PIXELS = 1 << 16


def strip_entropy(found: DataFrame, size: int) -> DataFrame:
    """Pixels (blob_id, quad, j, byte_idx, b, entropy) of strips of a layout (see ``sampling.strips``).

    A strip gets the last 16 samples before it and the first 15 after it from its neighbours in the quad,
    however few each of them has.  The last strip of a quad also answers for its pixels past the end of the blob.
    """
    half, area = WINDOW // 2, size * size
    order = Window.partitionBy("blob_id", "quad").orderBy("first_j")
    tail = F.substr("samples", F.greatest(F.col("n_j") - half, F.lit(0)).cast("int") + 1, F.lit(half))
    head = F.substr("samples", F.lit(1), F.lit(half - 1))
    haloed = found.withColumns(
        {
            "before": F.collect_list(tail).over(order.rowsBetween(-half, -1)),
            "after": F.collect_list(head).over(order.rowsBetween(1, half - 1)),
            "_last": F.lead("first_j").over(order).isNull(),
        }
    )
    past = F.when(F.col("_last"), area - F.col("first_j") - F.col("n_j")).otherwise(0).cast("long").alias("past")
    return _pixels(haloed.select("blob_id", "quad", "first_j", "n_j", "start", "width", "samples", past, "before", "after"), area)


def _pixels(strips: DataFrame, area: int) -> DataFrame:
    """The pixels of strips with their entropies; ``samples`` are picked here where strips come with whole ``data``.

    One Python function does it all, so a task has one worker, which holds a batch of strips and of pixels.
    """
    schema = T.StructType([strips.schema["blob_id"]]).add("quad", "long").add("j", "long").add("byte_idx", "long").add("b", "integer")
    schema = schema.add("entropy", "double")
    whole = "data" in strips.columns
    names = ["first_j", "n_j", "start", "width", "past"] + ([] if whole else ["before", "after"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            texts = batch.column("data" if whole else "samples")
            for row, (first, count, start, width, past, *halo) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                values = np.zeros(count + past, np.uint8)
                j = np.arange(first, first + len(values), dtype=np.int64)
                index = start + j * width // area
                text = np.frombuffer(texts[row].as_buffer(), np.uint8)
                values[:count] = text[index[:count]] if whole else text
                found = window_entropy_kernel(values, *map(b"".join, halo))
                held.append((np.full(len(values), row), j, index, values, np.arange(len(values)) >= count, found))
                n += len(values)
                if n >= BATCH_PIXELS:
                    yield from made(batch, held)
                    held, n = [], 0
            if held:
                yield from made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        row, j, index, values, past, found = (np.concatenate(c) for c in zip(*held, strict=True))
        for first in range(0, len(row), BATCH_PIXELS):
            part = slice(first, first + BATCH_PIXELS)
            keys = batch.select(["blob_id", "quad"]).take(pa.array(row[part]))
            b = pa.array(values[part].astype(np.int32), mask=past[part])
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(j[part]), pa.array(index[part]), b, pa.array(found[part])], schema.names)

    return strips.mapInArrow(answer, schema)


def blob_entropy(blobs: DataFrame, size: int, layout: str = "unrolled", step: int | None = None) -> DataFrame:
    """``sampling.grid`` with ``entropy``, 0 to 1, of blobs (blob_id, data) or of chunks of blobs.

    The same numbers as ``window_entropy``.  Samples stay packed until they are answered for.  A whole blob
    is one chunk, so its quads need no neighbours and nothing is shuffled; of chunks, a strip and its halo
    are shuffled, never a quad's pixels.
    """
    if "byte_start" in blobs.columns:
        return strip_entropy(sampling.strips(blobs, size, layout, step), size)
    area = check_size(size) ** 2
    n = F.octet_length("data").cast("long")
    whole = blobs.select("blob_id", n.alias("n_bytes"), F.lit(0).cast("long").alias("byte_start"), "data")
    past = (area - F.col("first_j") - F.col("n_j")).alias("past")
    return _pixels(sampling.planned(whole, size, layout, step).select("blob_id", "quad", "first_j", "n_j", "start", "width", "data", past), area)


def quad_entropy(values: Column) -> Column:
    """Entropies of arrays that hold one quad's samples each."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def entropies(samples: pa.Array) -> pa.Array:
        rows = [window_entropy_kernel(s.values.to_numpy().astype(np.uint8)) for s in samples]
        return pa.array(rows, pa.list_(pa.float64()))

    return entropies(values)


def block_entropy(counts: Column, n_bytes: Column) -> Column:
    """Entropy of a whole binary from its 256 byte counts; base ``min(n, window, symbols)``.

    Null for binaries of fewer than two bytes, whose base would be one.
    """
    base = F.log(F.least(n_bytes, F.lit(WINDOW), F.lit(SYMBOLS)).cast("double"))
    total = F.aggregate(
        F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda s, c: s - c / n_bytes * F.log(c / n_bytes)
    )
    return F.when(n_bytes > 1, total / base)
