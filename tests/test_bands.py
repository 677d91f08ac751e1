"""PNG files by bands against Spark's own reader."""

import io
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from octoloom.operators import patches
from octoloom.sources import bands, images


def filtered(pixels, kinds):
    """Rows as a writer filters them, a byte at a time."""
    rows, width, channels = pixels.shape
    flat = pixels.reshape(rows, -1).astype(int)
    out = bytearray()
    for r in range(rows):
        out.append(kinds[r])
        for i in range(width * channels):
            left = flat[r, i - channels] if i >= channels else 0
            up = flat[r - 1, i] if r else 0
            corner = flat[r - 1, i - channels] if r and i >= channels else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((flat[r, i] - (0, left, up, (left + up) // 2, paeth)[kinds[r]]) % 256)
    return bytes(out)


def encoded(pixels, colour, kinds, palette=None, split=50):
    height, width, _ = pixels.shape
    data = zlib.compress(filtered(pixels, kinds))
    head = images._SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
    body = b"".join(images._chunk(b"IDAT", data[k : k + split]) for k in range(0, len(data), split))
    shown = images._chunk(b"PLTE", palette) if palette else b""
    return head + shown + images._chunk(b"tEXt", b"a\0b") + body + images._chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(1)
    where = tmp_path_factory.mktemp("png")
    for k, (colour, channels) in enumerate({0: 1, 2: 3, 3: 1, 6: 4}.items()):
        for n, kinds in enumerate([[0, 1, 2], [4, 3, 2, 1, 0], [4], [3], [2, 1]]):
            height, width = 11 + n, 9
            pixels = rng.integers(0, 256 if colour != 3 else 20, (height, width, channels), np.uint8)
            if colour == 6:
                pixels[..., 3] = 255
            rows = [kinds[r % len(kinds)] for r in range(height)]
            (where / f"c{k}-{n}.png").write_bytes(encoded(pixels, colour, rows, rng.bytes(60) if colour == 3 else None))
    return str(where)


@pytest.mark.parametrize("rows", [1, 4, 100])
def test_bands_make_the_image(spark, folder, rows):
    whole = {r["image_name"]: r for r in images.read_images(spark, folder).collect()}
    got = {}
    for r in bands.read_bands(spark, folder, rows).orderBy("image_name", "band").collect():
        assert (r["width"], r["height"]) == (whole[r["image_name"]]["width"], whole[r["image_name"]]["height"])
        assert len(r["data"]) == r["rows"] * r["width"] * 3 <= rows * r["width"] * 3
        got[r["image_name"]] = got.get(r["image_name"], b"") + bytes(r["data"])
    assert len(got) == 20 and got == {n: bytes(r["data"]) for n, r in whole.items()}


def test_patches_of_bands_are_those_of_images(spark, folder):
    whole = patches.cut_patches(images.read_images(spark, folder), 4, 3)
    parts = bands.patches_of_bands(bands.read_bands(spark, folder, 3), 4, 3)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_a_long_image_takes_the_memory_of_a_band():
    """1,024 x 35,840, as an image of production: 110 MB decoded, some MB held."""
    height, width = 35_840, 1_024
    packer, row = zlib.compressobj(1), b"\x02" + bytes([1, 2, 3]) * width
    data = b"".join(packer.compress(row) for _ in range(height)) + packer.flush()
    file = images._header(width, height) + images._chunk(b"IDAT", data) + images._chunk(b"IEND", b"")
    tracemalloc.start()
    total = 0
    for _, _, first, pixels in bands.bands_of(io.BytesIO(file), 256):
        total += len(pixels)
        assert pixels[0, 0].tolist() == [(first + 1) * c % 256 for c in (1, 2, 3)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == height and peak < 12 << 20


@pytest.mark.parametrize("cut", [4, 20, 60, 90])
def test_files_that_are_cut_off_are_errors(cut):
    pixels = np.zeros((5, 5, 3), np.uint8)
    file = encoded(pixels, 2, [0] * 5)
    with pytest.raises((ValueError, struct.error)):
        list(bands.bands_of(io.BytesIO(file[: min(cut, len(file) - 20)]), 2))
    with pytest.raises(ValueError, match="8 bits"):
        wide = images._SIGNATURE + images._chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 2, 0, 0, 0))
        list(bands.bands_of(io.BytesIO(wide), 2))


def test_an_empty_folder_has_no_bands(spark, tmp_path):
    assert bands.read_bands(spark, str(tmp_path), 4).count() == 0
