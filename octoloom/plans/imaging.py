"""Blobs to images: pixel tables at row grain, and whole quads at chunk grain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import GREY_TABLES, class_rgb, rgb_table
from ..operators import colours, entropy, layout, sampling, spans

DEFAULT_MAPS = ("class",)


def render(
    blobs: DataFrame,
    size: int = 256,
    color_map: tuple[str, ...] = DEFAULT_MAPS,
    layout_map: str = "hilbert",
    layout_type: str = "unrolled",
    step: int | None = None,
    mode: str = "RGB",
    members: DataFrame | None = None,
) -> DataFrame:
    """Pixels (blob_id, quad, j, x, y, r, g, b) of blobs (blob_id, data) or of chunks of blobs.

    ``color_map`` names ``class``, ``magnitude``, ``entropy`` or ``structure`` (which needs
    ``members``).  Pixels past the end of a blob are black.  Only sampled bytes are read.
    """
    names, channels = list(color_map), []
    read = entropy.blob_entropy if "entropy" in names else sampling.grid
    pixels = read(blobs, size, layout_type, step)
    if "structure" in names:
        if members is None:
            raise ValueError("the colour map 'structure' needs members")
        pixels = spans.structure(pixels, members)
    for name in names:
        if name == "entropy":
            channels.append(entropy.entropy_colours(F.col("entropy"))["r"])
        elif name == "structure":
            channels.append(F.col("structure"))
        else:
            channels.append(colours.grey(name, F.col("b")))
    palette = {"class": class_rgb(F.col("b"))}
    if "entropy" in names:
        palette["entropy"] = entropy.entropy_colours(F.col("entropy"))
    single = palette.get(names[0]) if len(names) == 1 else None
    pixels = pixels.withColumn("_c", F.when(F.col("b").isNotNull(), colours.mix(channels, mode, single)))
    placed = sampling.place(pixels, size, layout_map)
    return placed.select(
        "blob_id", "quad", "j", "x", "y", *[F.coalesce(f"_c.{c}", F.lit(0)).alias(c) for c in ("r", "g", "b")]
    )


def render_mask(
    blobs: DataFrame,
    marked: DataFrame,
    size: int = 256,
    layout_map: str = "hilbert",
    layout_type: str = "unrolled_n",
    step: int | None = None,
) -> DataFrame:
    """Pixels (blob_id, quad, j, x, y, mask) with 255 where a sampled byte lies in a span."""
    pixels = sampling.grid(blobs, size, layout_type, step)
    if "byte_start" in blobs.columns:
        sizes = blobs.where("byte_start = 0").select("blob_id", "n_bytes")
    else:
        sizes = blobs.select("blob_id", F.octet_length("data").cast("long").alias("n_bytes"))
    masked = spans.mask(pixels, spans.check_spans(marked, sizes))
    shown = F.when(F.col("b").isNull(), 0).otherwise(F.col("mask")).alias("mask")
    return sampling.place(masked, size, layout_map).select("blob_id", "quad", "j", "x", "y", shown)


def render_quads(
    blobs: DataFrame,
    size: int = 256,
    color_map: tuple[str, ...] = DEFAULT_MAPS,
    layout_map: str = "hilbert",
    layout_type: str = "unrolled",
    step: int | None = None,
) -> DataFrame:
    """(blob_id, quad, image) with one RGB binary of ``size`` rows a quad, drawn by an Arrow kernel.

    Colour maps are ``class``, ``magnitude`` and ``entropy``; images with ``structure`` or of masks are
    drawn by ``images`` from their pixels.  A row carries the bytes of its own quad, or only its samples
    where ``blobs`` are chunks, so quads of one blob are drawn side by side and no task holds an image.
    """
    area = size * size
    if "byte_start" in blobs.columns:
        found = sampling.strips(blobs, size, layout_type, step)
        strip = F.struct("first_j", "samples")
        ranged = found.groupBy("blob_id", "quad").agg(F.array_sort(F.collect_list(strip)).alias("_s"))
        part = F.concat_ws("", F.transform("_s", lambda x: F.hex(x["samples"])))
        ranged = ranged.select("blob_id", "quad", F.lit(area).cast("long").alias("width"), F.unhex(part).alias("part"))
    else:
        known = blobs.select("blob_id", "data", F.octet_length("data").cast("long").alias("n")).where("n > 0")
        last = sampling.quad_count(F.col("n"), size, layout_type, step) - 1
        quads = known.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("quad"))
        start, stop = sampling.quad_bounds(F.col("n"), F.col("quad"), size, layout_type, step)
        # an empty range still shows the byte at its start, as the row grain does
        end = F.least(F.greatest(stop, start + 1), F.col("n"))
        part = F.substr("data", (start + 1).cast("int"), (end - start).cast("int"))
        ranged = quads.select("blob_id", "quad", (stop - start).alias("width"), part.alias("part"))
    at = layout.positions(layout_map, size)
    names = list(color_map)
    grey = {k: v for k, v in GREY_TABLES.items() if k in names}
    palette = rgb_table()
    for name in names:
        if name != "entropy" and name not in grey:
            raise NotImplementedError(f"no chunk colour map named {name!r}")

    levels = entropy.entropy_levels

    def colour(name: str, samples: np.ndarray) -> np.ndarray:
        return levels(samples)[0] if name == "entropy" else grey[name][samples]

    @F.arrow_udf("binary")
    def draw(parts: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for data, width in zip(parts.to_pylist(), widths.to_pylist(), strict=True):
            values = np.frombuffer(data, np.uint8)
            index = np.arange(area, dtype=np.int64) * width // area
            known = index < len(values)
            samples = np.zeros(area, np.uint8)
            samples[known] = values[index[known]]
            if names == ["class"]:
                pixels = palette[samples]
            elif names == ["entropy"]:
                red, blue = levels(samples)
                pixels = np.stack([red, np.zeros(area), blue], 1)
            else:
                channels = [colour(n, samples) for n in (names * 3 if len(names) == 1 else names)[:3]]
                channels += [np.zeros(area)] * (3 - len(channels))
                pixels = np.stack(channels, 1)
            image = np.zeros((size, size, 3), np.uint8)
            image[at[known, 1], at[known, 0]] = pixels[known]
            out.append(image.tobytes())
        return pa.array(out, pa.binary())

    return ranged.select("blob_id", "quad", draw("part", "width").alias("image"))


def images(pixels: DataFrame, size: int) -> DataFrame:
    """(blob_id, quad, image) of pixels (blob_id, quad, x, y, and r, g, b or mask), a quad a group.

    For colours that need a join, such as archive structure and masks.
    """
    grey = "mask" in pixels.columns
    colour = ["mask"] * 3 if grey else ["r", "g", "b"]
    flat = pixels.select(
        "blob_id", "quad", (F.col("y") - F.col("quad") * size).cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        *[F.col(c).cast("int").alias(f"c{k}") for k, c in enumerate(colour)],
    )

    def draw(group: pa.Table) -> pa.Table:
        image = np.zeros((size, size, 3), np.uint8)
        y, x = (group[c].to_numpy() for c in ("y", "x"))
        for k in range(3):
            image[y, x, k] = group[f"c{k}"].to_numpy()
        first = group.slice(0, 1).select(["blob_id", "quad"])
        return first.append_column("image", pa.array([image.tobytes()], pa.binary()))

    kind = pixels.schema["blob_id"].dataType.simpleString()
    return flat.groupBy("blob_id", "quad").applyInArrow(draw, f"blob_id {kind}, quad long, image binary")


def patches_of_quads(quads: DataFrame, size: int, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, patch) numbered over the whole image, where quads stand below each other."""
    from ..operators.patches import cut_patches

    if size % patch_h:
        raise ValueError("patches must not straddle quads")
    images = quads.select(
        F.struct("blob_id", "quad").alias("image_name"), F.lit(size).alias("width"), F.lit(size).alias("height"), F.col("image").alias("data")
    )
    each = (size // patch_w) * (size // patch_h)
    cut = cut_patches(images, patch_w, patch_h)
    return cut.select(
        F.col("image_name.blob_id").alias("image_name"),
        (F.col("image_name.quad") * each + F.col("patch_id")).alias("patch_id"),
        "patch",
    )
