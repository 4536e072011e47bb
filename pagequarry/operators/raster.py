"""Drawings as pixels: scan-line filling of many pictures at once, strokes as polygons, PNG out.

Every edge crosses the rows of pixel centres between its ends; a crossing adds to or takes from the
winding of all pixels to its right. So a picture is its crossings, summed along rows: even-odd
and non-zero filling read the same sums. Work goes by bands of rows, so that a page of any size takes
bounded memory.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Pixels of a band, corners of a round end.
BAND, ROUND = 1 << 22, 8


def edges_of(points: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Edges ``x0, y0, x1, y1`` of closed pieces; ``pieces`` numbers the piece of each point, in order."""
    if not len(points):
        return np.zeros((0, 4))
    first = np.flatnonzero(np.diff(pieces, prepend=pieces[0] - 1))
    last = np.append(first[1:], len(points)) - 1
    after = np.arange(1, len(points) + 1)
    after[last] = first
    return np.concatenate([points, points[after]], axis=1)


def windings(edges: np.ndarray, owner: np.ndarray, pictures: int, width: int, top: int, bottom: int) -> np.ndarray:
    """The winding of every pixel centre of rows ``top`` to ``bottom`` of each picture: ``(pictures, rows, width)``."""
    rows = bottom - top
    x0, y0, x1, y1 = edges.T
    low = np.clip(np.ceil(np.minimum(y0, y1) - 0.5), top, bottom).astype(np.int64)
    high = np.clip(np.ceil(np.maximum(y0, y1) - 0.5), top, bottom).astype(np.int64)
    many = high - low
    edge = np.repeat(np.arange(len(edges)), many)
    y = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + low[edge]
    across = x0[edge] + (y + 0.5 - y0[edge]) * (x1[edge] - x0[edge]) / (y1[edge] - y0[edge])
    x = np.clip(np.ceil(across - 0.5), 0, width).astype(np.int64)
    place = ((owner[edge] * rows + y - top) * (width + 1)) + x
    sums = np.bincount(place, np.where(y1[edge] > y0[edge], 1, -1), minlength=pictures * rows * (width + 1))
    return np.cumsum(sums.reshape(pictures, rows, width + 1), axis=2)[:, :, :width].astype(np.int64)


def bands(edges: np.ndarray, owner: np.ndarray, even_odd: np.ndarray, pictures: int, width: int, height: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, filled)`` by bands of rows; ``even_odd`` says the rule of each picture."""
    step = max(1, BAND // max(1, pictures * (width + 1)))
    for top in range(0, height, step):
        w = windings(edges, owner, pictures, width, top, min(top + step, height))
        yield top, np.where(even_odd[:, None, None], w % 2 == 1, w != 0)


def filled(edges: np.ndarray, width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """One picture's pixels, filled."""
    out = np.zeros((height, width), bool)
    for top, band in bands(edges, np.zeros(len(edges), np.int64), np.array([even_odd]), 1, width, height):
        out[top : top + band.shape[1]] = band[0]
    return out


def stroked(points: np.ndarray, pieces: np.ndarray, width: float, closed: bool = False) -> np.ndarray:
    """Edges of what a pen of ``width`` with a round tip covers, to be filled by the non-zero rule.

    Each segment is a rectangle and each point a polygon around it, all turned the same way, so that they add up.
    """
    half = max(width, 1e-9) / 2
    along = np.flatnonzero(pieces[1:] == pieces[:-1])
    a, b = points[along], points[along + 1]
    if closed and len(points):
        edges = edges_of(points, pieces)
        a, b = edges[:, :2], edges[:, 2:]
    step = b - a
    length = np.hypot(*step.T)
    a, step, b, length = a[length > 0], step[length > 0], b[length > 0], length[length > 0]
    side = np.stack([-step[:, 1], step[:, 0]], axis=1) / length[:, None] * half
    quads = np.stack([a + side, a - side, b - side, b + side], axis=1)
    turn = 2 * math.pi * np.arange(ROUND) / ROUND
    tips = points[:, None, :] + half / math.cos(math.pi / ROUND) * np.stack([np.cos(turn), np.sin(turn)], axis=1)[None]
    parts = [np.concatenate([q, np.roll(q, -1, axis=1)], axis=2).reshape(-1, 4) for q in (quads, tips) if len(q)]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def png(pixels: np.ndarray) -> bytes:
    """A PNG of grey or coloured pixels of 8 bits."""
    height, width = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
