"""Colour maps by name, and mixing them into channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bytes import CHANNELS, class_grey, class_rgb, magnitude

#: Grey colour of a byte, by the map's name.  ``entropy``, ``structure`` and ``mask`` need more than the byte and
#: come as columns of their own.
GREY = {"class": class_grey, "magnitude": magnitude}
RGB = {"class": class_rgb}


def grey(name: str, b: Column) -> Column:
    if name not in GREY:
        raise NotImplementedError(f"no colour map named {name!r}; there are {sorted(GREY)}")
    return GREY[name](b)


def mix(channels: list[Column], mode: str = "RGB", rgb: Column | None = None) -> Column:
    """Up to three grey channels as r, g, b.

    One channel: its own palette (``rgb``) in mode RGB, the grey three times in mode L.  Two: the
    third is zero.  More than three: the first three count.  None is an error.
    """
    if not channels:
        raise ValueError("a mixture needs at least one channel")
    if mode not in ("RGB", "L"):
        raise ValueError(f"mode must be RGB or L, not {mode!r}")
    if len(channels) == 1:
        if mode == "RGB" and rgb is not None:
            return rgb
        channels = channels * 3
    channels = [*channels, F.lit(0)][:3]
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(channels, CHANNELS, strict=True)])


def same_length(*data: Column) -> Column:
    """True, or an error where binaries differ in length."""
    first = F.octet_length(data[0])
    same = F.lit(True)
    for other in data[1:]:
        same = same & F.octet_length(other).eqNullSafe(first)
    return F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("colour maps differ in length")))
