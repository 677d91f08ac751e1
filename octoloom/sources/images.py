"""Images: read through Spark's image source, and written as PNG, whole or quad by quad.

An image of many quads is never in one place.  Every quad is deflated in its own task, without a last block,
so the streams of its quads make one stream when they stand behind each other; each becomes a part of the
file with a checksum of its own, and the checksum of the whole is combined from theirs.  A data source
writer puts the parts together, an image at a time and a quad in memory, under names that nobody reads, and
the driver moves finished files to their names once all tasks have ended.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import delete_folder, make_folder, move_file, open_new, write_file


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, image_name, width, height, data) of image files; ``data`` is rows of RGB bytes.

    Spark decodes to blue, green, red; grey and transparent images become RGB as well.
    """

    @F.arrow_udf("binary")
    def to_rgb(data: pa.Array, channels: pa.Array) -> pa.Array:
        out = []
        for d, n in zip(data.to_pylist(), channels.to_pylist(), strict=True):
            pixels = np.frombuffer(d, np.uint8).reshape(-1, n)
            pixels = np.repeat(pixels, 3, 1) if n == 1 else pixels[:, 2::-1]
            out.append(np.ascontiguousarray(pixels).tobytes())
        return pa.array(out, pa.binary())

    reader = spark.read.format("image").option("dropInvalid", "true")
    found = reader.option("recursiveFileLookup", "true" if recursive else "false").load(path)
    name = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*$", "")
    return found.select(
        F.col("image.origin").alias("path"),
        name.alias("image_name"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        to_rgb("image.data", "image.nChannels").alias("data"),
    )


_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_ADLER = 65_521


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _header(width: int, height: int) -> bytes:
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))


def png(data: bytes, width: int, height: int) -> bytes:
    """Rows of RGB bytes as a PNG file."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * 3)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()

    return _header(width, height) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


@F.arrow_udf(T.BinaryType())
def encode_png(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    triples = zip(data.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True)
    return pa.array([png(*t) for t in triples], pa.binary())


def write_pngs(images: DataFrame, folder: str) -> int:
    """Write ``folder/<image_name>.png`` on a shared mount or in an object store; the number written.

    A file is written under another name and then renamed, so a task that runs twice does no harm.
    """

    def write(batches):
        for batch in batches:
            for name, data in zip(batch["image_name"].to_pylist(), batch["png"].to_pylist(), strict=True):
                write_file(f"{folder}/{name}.png", data, uuid.uuid4().hex)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    make_folder(folder)
    encoded = images.select("image_name", encode_png("data", "width", "height").alias("png"))
    return encoded.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def adler_of_both(first: int, second: int, n: int) -> int:
    """The Adler-32 of two runs of bytes, of which the second has ``n``."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (b + d + n * (a - 1)) % _ADLER << 16 | (a + c - 1) % _ADLER


_PART = "image_name string, width int, height int, quad long, part binary, adler long, raw long"


def deflated(quads: DataFrame, size: int) -> DataFrame:
    """Quads (image_name, quad, image: rows of RGB bytes) with ``part``, ``adler`` and ``raw``: what they are of a file."""

    @F.arrow_udf("part binary, adler long, raw long")
    def deflate(images: pa.Array) -> pa.Array:
        rows = []
        for image in images:
            pixels = np.frombuffer(image.as_py(), np.uint8).reshape(-1, size * 3)
            raw = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels], 1).tobytes()
            held = zlib.compressobj(6, zlib.DEFLATED, -15)
            part = held.compress(raw) + held.flush(zlib.Z_FULL_FLUSH)
            rows.append({"part": part, "adler": zlib.adler32(raw), "raw": len(raw)})
        return pa.array(rows, pa.struct([("part", pa.binary()), ("adler", pa.int64()), ("raw", pa.int64())]))

    return quads.select("image_name", "quad", deflate("image").alias("_d")).select("image_name", "quad", "_d.*")


class Staged(WriterCommitMessage):
    """Images that a task has written."""

    def __init__(self, names: list[str]):
        self.names = names


class PngWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        """Parts come in the order of image and quad; a second attempt at a task writes under names of its own."""
        attempt, names, file, name, adler = uuid.uuid4().hex, [], None, None, 1

        def close() -> None:
            file.write(_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b""))
            file.close()
            names.append(f"{attempt}/{name}")

        for row in iterator:
            if row["image_name"] != name:
                if file:
                    close()
                name, adler = row["image_name"], 1
                make_folder(f"{self.staged}/{attempt}/{name}".rpartition("/")[0])
                file = open_new(f"{self.staged}/{attempt}/{name}.png")
                file.write(_header(row["width"], row["height"]) + _chunk(b"IDAT", b"\x78\x01"))
            file.write(_chunk(b"IDAT", row["part"]))
            adler = adler_of_both(adler, row["adler"], row["raw"])
        if file:
            close()
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            for name in message.names if message else ():
                final = name.partition("/")[2]
                if "/" in final:
                    make_folder(f"{self.folder}/{final}".rpartition("/")[0])
                move_file(f"{self.staged}/{name}.png", f"{self.folder}/{final}.png")
        delete_folder(self.staged)

    def abort(self, messages: list[Staged | None]) -> None:
        delete_folder(self.staged)


class PngSink(DataSource):
    """PNG files of deflated parts; see ``write_quads``."""

    @classmethod
    def name(cls) -> str:
        return "png_parts"

    def schema(self) -> str:
        return _PART

    def writer(self, schema: T.StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options)


def write_quads(quads: DataFrame, size: int, folder: str) -> None:
    """Write ``folder/<image_name>.png`` from quads (image_name, quad, image) that stand below each other.

    ``image`` is ``size`` rows of RGB bytes, ``quad`` counts from 0.  Nothing stands under a file's name before
    all images are written; if a task fails for good, no file is left.
    """
    spark = quads.sparkSession
    spark.dataSource.register(PngSink)
    make_folder(folder)
    parts = deflated(quads, size)
    heights = quads.groupBy("image_name").agg((F.count("*") * size).cast("int").alias("height"))
    rows = parts.join(heights, "image_name").withColumn("width", F.lit(size))
    names = [c.split()[0] for c in _PART.split(", ")]
    ordered = rows.select(*names).repartition("image_name").sortWithinPartitions("image_name", "quad")
    ordered.write.format("png_parts").mode("append").save(folder)
