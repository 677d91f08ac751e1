"""Images cut into fixed patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import div


def patch_id(x: Column, y: Column, width: Column, patch_w: int, patch_h: int) -> Column:
    """Row-major number of the patch that holds a pixel."""
    return div(y, patch_h) * div(width, patch_w) + div(x, patch_w)


def whole_patches(pixels: DataFrame, width: Column, height: Column, patch_w: int, patch_h: int) -> DataFrame:
    """Pixels (x, y, ...) of full patches, with ``patch_id``; the remainder at the edges goes."""
    inside = (F.col("x") < div(width, patch_w) * patch_w) & (F.col("y") < div(height, patch_h) * patch_h)
    return pixels.where(inside).withColumn("patch_id", patch_id(F.col("x"), F.col("y"), width, patch_w, patch_h))


def split_bounds(length: Column, parts: int, k: Column) -> tuple[Column, Column]:
    """[first, last) of the k-th of near-equal parts; the first ones are longer by one."""
    small, more = div(length, parts), F.pmod(length, F.lit(parts))
    return k * small + F.least(k, more), (k + 1) * small + F.least(k + 1, more)


def patch_labels(masked: DataFrame) -> DataFrame:
    """(image_name, patch_id, label): 1 where any mask value of the patch is not zero."""
    return masked.groupBy("image_name", "patch_id").agg(F.max((F.col("mask") != 0).cast("int")).alias("label"))


def label_of(name: Column) -> Column:
    """0 for ``benign``, else 1."""
    return F.when(name == "benign", 0).otherwise(1)


def one_hot(label: Column) -> Column:
    return F.when(label == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))


def label_from_path(path: Column) -> Column:
    return F.when(path.contains("benign"), 0).otherwise(1)


def mask_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.png$", ".mask.png")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def swap_channels(pixel: Column) -> Column:
    """RGB to BGR and back."""
    return F.struct(pixel["b"].alias("r"), pixel["g"].alias("g"), pixel["r"].alias("b"))


def _tiles(data: pa.Array, width: pa.Array, height: pa.Array, patch_w: int, patch_h: int) -> Iterator[np.ndarray]:
    """For each image its full patches, a row of RGB bytes a patch."""
    for d, w, h in zip(data, width.to_pylist(), height.to_pylist(), strict=True):
        image = np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 3)
        down, across = h // patch_h, w // patch_w
        whole = image[: down * patch_h, : across * patch_w]
        yield whole.reshape(down, patch_h, across, patch_w, 3).swapaxes(1, 2).reshape(-1, patch_h * patch_w * 3)


def cut_patches(images: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, patch) from images (image_name, width, height, data: rows of RGB bytes).

    ``patch`` is a binary of ``patch_h`` rows of ``patch_w`` RGB pixels.  An image is one task's
    work only while it is cut; patches are rows of their own.
    """

    @F.arrow_udf("array<binary>")
    def patches(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = [[t.tobytes() for t in tiles] for tiles in _tiles(data, width, height, patch_w, patch_h)]
        return pa.array(rows, pa.list_(pa.binary()))

    return images.select("image_name", F.posexplode(patches("data", "width", "height")).alias("patch_id", "patch"))


def mask_labels(masks: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, label) from mask images: 1 where a patch has any value but zero.

    Masks are cut and looked at by one function, so a task has one Python worker and patches of masks are never rows.
    """

    @F.arrow_udf("array<int>")
    def marked(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = [tiles.any(axis=1).astype(np.int32) for tiles in _tiles(data, width, height, patch_w, patch_h)]
        return pa.array(rows, pa.list_(pa.int32()))

    return masks.select("image_name", F.posexplode(marked("data", "width", "height")).alias("patch_id", "label"))


def training_patches(images: DataFrame, masks: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, patch, label) of images with a label, and masks of the same names.

    Patches of benign images are 0 and their masks are not looked at; of others, each patch has the
    label of its mask, or the image's where there is no mask.
    """
    named = images.select("image_name", F.col("label").alias("_image"))
    bad = named.where("_image = 1").select("image_name")
    labels = mask_labels(masks.join(bad, "image_name", "left_semi"), patch_w, patch_h)
    cut = cut_patches(images, patch_w, patch_h).join(named, "image_name")
    joined = cut.join(labels, ["image_name", "patch_id"], "left")
    label = F.when(F.col("_image") == 0, 0).otherwise(F.coalesce("label", "_image"))
    return joined.select("image_name", "patch_id", "patch", label.alias("label"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def planes(patch: pa.Array) -> pa.Array:
    """Rows of RGB bytes as floats, all of red first, then green, then blue; null stays null."""
    rows = [None if d is None else np.frombuffer(d, np.uint8).reshape(-1, 3).T.astype(np.float32).ravel() for d in patch.to_pylist()]
    return pa.array(rows, pa.list_(pa.float32()))


def training_source(
    images: DataFrame, masks: DataFrame, patch_w: int, patch_h: int, seed: int, buffer: int | None = None
) -> DataFrame:
    """``training_patches`` in a seeded order: over all images, or through a ``buffer`` of so many rows in each task."""
    cut = training_patches(images, masks, patch_w, patch_h)
    return shuffled(cut, seed) if buffer is None else buffered(cut, seed, buffer)


def validation_source(images: DataFrame, masks: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """``training_patches`` in no order."""
    return training_patches(images, masks, patch_w, patch_h)


def inference_source(images: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, patch) without labels or masks."""
    return cut_patches(images, patch_w, patch_h)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows in a seeded order; needed only where a consumer reads them in turn."""
    return rows.orderBy(F.rand(seed))


def buffered(rows: DataFrame, seed: int, buffer: int = 1_000) -> DataFrame:
    """Rows shuffled inside their partitions by a buffer, without an exchange; each row once.

    A task holds ``buffer`` rows and as many that come: it mixes them, hands half of them on and holds the others, so a
    row may wait for long but none moves forward by twice the buffer.  The order follows from the seed, the number
    of the partition and the order in which its rows come, not from the size of batches.  Shards read in a seeded order
    (``tars.read_shards`` with ``seed``) give the other level.
    """
    if buffer < 1:
        raise ValueError("the buffer must hold a row at least")

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, coming, n = None, [], 0

        def turn(more: pa.Table, keep: int) -> tuple[pa.Table, pa.Table]:
            both = more if held is None else pa.concat_tables([held, more])
            order = chance.permutation(both.num_rows)
            leave = max(0, both.num_rows - keep)
            # taken, not sliced, so that what is held does not hold on to what has left
            return both.take(order[:leave]), both.take(order[leave:])

        for batch in batches:
            coming.append(batch)
            n += batch.num_rows
            while n >= buffer:
                table = pa.Table.from_batches(coming)
                out, held = turn(table.slice(0, buffer), buffer)
                coming, n = table.slice(buffer).to_batches(), n - buffer
                yield from out.to_batches()
        if coming or held is not None:
            rest = pa.Table.from_batches(coming) if coming else held.slice(0, 0)
            yield from turn(rest, 0)[0].to_batches()

    return rows.mapInArrow(mix, rows.schema)


def normalised(pixel: Column, mean: float, deviation: float) -> Column:
    return (pixel / 255 - mean) / deviation
