"""PNG files read by bands of rows, so that no image is whole anywhere.

A file is a task, as its stream can only be inflated from the front, but what the task holds is a band: the rows
of one row of patches.  Row filters refer to the pixel before and the row above, so a band is undone along its
diagonals, all rows of it at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import find, open_file

PIECE_BYTES = 1 << 16
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes a pixel by colour type: grey, colour, palette, grey with alpha, colour with alpha.  Fixed values.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _parts(file) -> Iterator[tuple[bytes, bytes]]:
    """(kind, piece) of the file's parts; image data in pieces of at most ``PIECE_BYTES``."""
    if file.read(len(_SIGNATURE)) != _SIGNATURE:
        raise ValueError("no PNG file")
    while len(head := file.read(8)) == 8:
        size, kind = struct.unpack(">I4s", head)
        if kind == b"IDAT":
            while size:
                piece = file.read(min(size, PIECE_BYTES))
                if not piece:
                    raise ValueError("the file ends inside its image data")
                size -= len(piece)
                yield kind, piece
        else:
            yield kind, file.read(size)
        file.read(4)


def undone(filtered: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels (rows, width, channels) of filtered ones; ``above`` is the row before the first."""
    rows, width, channels = filtered.shape
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    if kinds.max(initial=0) < 3:
        out = np.empty_like(filtered)
        for r in range(rows):
            out[r] = np.cumsum(filtered[r], axis=0, dtype=np.uint8) if kinds[r] == 1 else filtered[r] + above if kinds[r] == 2 else filtered[r]
            above = out[r]
        return out
    known = np.zeros((rows + 1, width + 1, channels), np.int16)
    known[0, 1:] = above
    for t in range(width + rows - 1):
        r = np.arange(max(0, t - width + 1), min(rows, t + 1))
        c = t - r
        left, up, corner = known[r + 1, c], known[r, c + 1], known[r, c]
        near_left, near_up, near_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        paeth = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
        own = kinds[r, None]
        guess = np.select([own == 1, own == 2, own == 3, own == 4], [left, up, (left + up) >> 1, paeth], 0)
        known[r + 1, c + 1] = (filtered[r, c] + guess) & 255
    return known[1:, 1:].astype(np.uint8)


def bands_of(file, rows: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(width, height, first row, RGB pixels) of each band of ``rows`` rows, the last as high as is left."""
    width = height = 0
    channels, palette, above = 0, np.zeros((256, 3), np.uint8), None
    stream, held, first = zlib.decompressobj(), bytearray(), 0
    for kind, piece in _parts(file):
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", piece)
            if depth != 8 or laced or colour not in CHANNELS:
                raise ValueError("only images of 8 bits a channel that are not interlaced are read by bands")
            channels, above = CHANNELS[colour], np.zeros((width, CHANNELS[colour]), np.uint8)
            grey, indexed = colour in (0, 4), colour == 3
        elif kind == b"PLTE":
            palette[: len(piece) // 3] = np.frombuffer(piece, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            line = 1 + width * channels
            while piece and first < height:
                want = min(rows, height - first) * line
                held += stream.decompress(piece, want - len(held))
                piece = stream.unconsumed_tail
                if len(held) == want:
                    raw = np.frombuffer(bytes(held), np.uint8).reshape(-1, line)
                    held.clear()
                    pixels = undone(raw[:, 1:].reshape(len(raw), width, channels), raw[:, 0].astype(int), above)
                    above = pixels[-1]
                    shown = palette[pixels[..., 0]] if indexed else np.repeat(pixels[..., :1], 3, 2) if grey else pixels[..., :3]
                    yield width, height, first, shown
                    first += len(raw)
    if first < height or not height:
        raise ValueError("the image ends before its last row")


class BandPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options["rows"])

    def partitions(self) -> list[BandPartition]:
        return [BandPartition(name) for name, _ in find(self.path, ".png")]

    def read(self, partition: BandPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition of a source without files
            return
        name = partition.path.rsplit("/", 1)[-1].rpartition(".")[0]
        with open_file(partition.path) as file:
            for width, height, first, pixels in bands_of(file, self.rows):
                row = {
                    "path": partition.path, "image_name": name, "width": width, "height": height,
                    "band": first // self.rows, "rows": len(pixels), "data": np.ascontiguousarray(pixels).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], _BAND_ARROW)


_BAND = "path string, image_name string, width int, height int, band int, rows int, data binary"
_BAND_ARROW = pa.schema(
    [
        ("path", pa.string()), ("image_name", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
        ("band", pa.int32()), ("rows", pa.int32()), ("data", pa.binary()),
    ]
)


class BandSource(DataSource):
    """PNG files on a shared mount or in an object store, by bands: a task a file, a band in memory."""

    @classmethod
    def name(cls) -> str:
        return "png_bands"

    def schema(self) -> str:
        return _BAND

    def reader(self, schema: StructType) -> BandReader:
        return BandReader(self.options)


def read_bands(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(path, image_name, width, height, band, rows, data) of PNG files; ``data`` is rows of RGB bytes.

    Grey, indexed and transparent images become RGB, as in ``images.read_images``.  Files that are cut off, interlaced
    or of another depth are an error.
    """
    if rows < 1:
        raise ValueError("a band has a row at least")
    spark.dataSource.register(BandSource)
    return spark.read.format("png_bands").option("rows", str(rows)).load(path)


def patches_of_bands(bands: DataFrame, patch_w: int, patch_h: int) -> DataFrame:
    """(image_name, patch_id, patch) of bands of ``patch_h`` rows, numbered as in the whole image; remainders go."""
    from ..operators.patches import cut_patches

    whole = bands.where(F.col("rows") == patch_h)
    named = whole.select(
        F.struct("image_name", "band", "width").alias("image_name"), "width", F.col("rows").alias("height"), "data"
    )
    cut = cut_patches(named, patch_w, patch_h)
    across = F.floor(F.col("image_name.width") / patch_w).cast("int")
    return cut.select(
        "image_name.image_name", (F.col("image_name.band") * across + F.col("patch_id")).cast("int").alias("patch_id"), "patch"
    )
