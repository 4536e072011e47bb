"""Raster files as documents of one page a picture: PNG, BMP and PNM, decoded with numpy.

``binaryFile`` finds and splits the files; each is decoded where its bytes are. Other formats
need a decoder, given as a function from bytes to ``(pixels, dpi)``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Resolutions that are believed, and the one taken otherwise.
LEAST_DPI, MOST_DPI, USUAL_DPI = 24, 2400, 96
PAGE = "path string, page int, width int, height int, dpi double, width_pt double, height_pt double, grey binary, error string"


def sound_dpi(dpi: float | None) -> float:
    return dpi if dpi and LEAST_DPI <= dpi <= MOST_DPI else float(USUAL_DPI)


def on_white(rgba: np.ndarray) -> np.ndarray:
    """Colours as they look on white paper."""
    alpha = rgba[..., 3:].astype(np.int64)
    return ((rgba[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def png(data: bytes) -> tuple[np.ndarray, float | None]:
    """Pixels (height, width, 3) of a PNG of 8 bits a sample without interlacing, and its resolution."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette, alpha, dpi, head = 8, b"", None, None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"pHYs" and part[8] == 1:
            dpi = struct.unpack_from(">I", part)[0] * 0.0254
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("PNG with other than 8 bits a sample, or interlaced")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * samples)
    rows, above = np.zeros((height, width, samples), np.int64), np.zeros((width, samples), np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].reshape(width, samples).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line, axis=0)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):  # each sample needs the one to its left
            left, corner = np.zeros(samples, np.int64), np.zeros(samples, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                left, corner = (line[x] + guess) & 255, above[x]
                line[x] = left
        above = rows[y] = line & 255
    rows = rows.astype(np.uint8)
    if colour == 3:
        full = np.full(256, 255, np.uint8)
        if alpha is not None:
            full[: len(alpha)] = alpha
        return on_white(np.concatenate([palette[rows[..., 0]], full[rows]], axis=2)), dpi
    if colour in (0, 2):
        return np.repeat(rows, 3, axis=2) if colour == 0 else rows, dpi
    return on_white(np.concatenate([np.repeat(rows[..., :1], 3, axis=2), rows[..., 1:]], axis=2) if colour == 4 else rows), dpi


def bmp(data: bytes) -> tuple[np.ndarray, float | None]:
    """Pixels of a BMP of 24 or 32 bits a pixel."""
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    start, width, height, bits, scale = (*struct.unpack_from("<I", data, 10), *struct.unpack_from("<ii", data, 18), *struct.unpack_from("<H", data, 28), *struct.unpack_from("<i", data, 38))
    if bits not in (24, 32):
        raise ValueError("BMP with other than 24 or 32 bits a pixel")
    step, tall = (width * bits // 8 + 3) // 4 * 4, abs(height)
    rows = np.frombuffer(data, np.uint8, step * tall, start).reshape(tall, step)[:, : width * bits // 8].reshape(tall, width, bits // 8)
    return np.ascontiguousarray((rows if height < 0 else rows[::-1])[..., 2::-1]), scale * 0.0254 or None


def pnm(data: bytes) -> tuple[np.ndarray, float | None]:
    """Pixels of a grey or coloured PNM in bytes."""
    words, at = [], 0
    while len(words) < 4:
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = next(i for i in range(at, len(data)) if data[i : i + 1].isspace())
            words.append(data[at:end])
            at = end
    if words[0] not in (b"P5", b"P6") or int(words[3]) > 255:
        raise ValueError("PNM other than P5 or P6 in bytes")
    width, height, samples = int(words[1]), int(words[2]), 1 if words[0] == b"P5" else 3
    pixels = np.frombuffer(data, np.uint8, width * height * samples, at + 1).reshape(height, width, samples)
    return np.repeat(pixels, 3, axis=2) if samples == 1 else pixels, None


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, float | None]]] = {"png": png, "bmp": bmp, "pgm": pnm, "ppm": pnm, "pnm": pnm}


def luminance(pixels: np.ndarray) -> np.ndarray:
    return (pixels.astype(np.int64) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def decoded(files: DataFrame, decoders: dict | None = None) -> DataFrame:
    """Pages of ``files`` (``path``, ``content``): size, resolution and grey pixels; what cannot be read says why."""
    known = DECODERS | (decoders or {})

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pixels, dpi = known[path.rsplit(".", 1)[-1].lower()](content.as_py())
                    height, width = pixels.shape[:2]
                    dpi = sound_dpi(dpi)
                    row = (path, 0, width, height, dpi, width * 72 / dpi, height * 72 / dpi, luminance(pixels).tobytes(), None)
                except (ValueError, KeyError, IndexError, TypeError, StopIteration, struct.error, zlib.error) as e:
                    row = (path, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [f.split()[0] for f in PAGE.split(", ")])

    return files.select("path", "content").mapInArrow(run, PAGE)


def read_images(spark: SparkSession, folder: str, decoders: dict | None = None) -> DataFrame:
    """All pictures under ``folder`` by their ending, as pages."""
    endings = "|".join(sorted(DECODERS | (decoders or {})))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return decoded(files.where(F.lower("path").rlike(rf"\.({endings})$")), decoders)


def cleaned(grey: np.ndarray, radius: int = 24) -> tuple[np.ndarray, int]:
    """A scan as ink on white: the paper's shade taken out, the greys spread to their full range, and Otsu's threshold."""
    from pagequarry.operators.ink import box_blur

    paper = np.maximum(box_blur(grey, radius), 1).astype(np.int64)
    flat = np.minimum(grey.astype(np.int64) * 255 // paper, 255)
    low, high = np.sort(flat, axis=None)[[int(flat.size * 0.01), int(flat.size * 0.99) - 1 if flat.size > 1 else 0]]
    spread = np.clip((flat - low) * 255 // max(int(high - low), 1), 0, 255).astype(np.uint8)
    counts = np.bincount(spread.ravel(), minlength=256).astype(np.float64)
    w0, s0 = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((s0 * w0[-1] - s0[-1] * w0) ** 2 / (w0 * (w0[-1] - w0)))
    best = np.flatnonzero(between == between.max())
    return spread, int(best[0] + best[-1]) // 2 + 1


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The nearest pixel of each place."""
    y = np.minimum((np.arange(height) * pixels.shape[0]) // height, pixels.shape[0] - 1)
    x = np.minimum((np.arange(width) * pixels.shape[1]) // width, pixels.shape[1] - 1)
    return pixels[y][:, x]


def cropped(pixels: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    return pixels[max(top, 0) : max(bottom, 0), max(left, 0) : max(right, 0)]
