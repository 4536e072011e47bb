"""Pixels of paths against tests of every point, and drawings of written files as pictures."""

import numpy as np
import pytest

from pagequarry.operators import raster
from pagequarry.plans.drawings import drawn, figures, glyph_size, pictures
from pagequarry.sources import images
from pagequarry.sources.page_files import read_files
from tests.test_page_files import a_file


def winding_by_points(points, pieces, width, height):
    """The winding of each pixel's centre: edges crossed on the way to it from the left."""
    out = np.zeros((height, width), int)
    for piece in np.unique(pieces):
        corners = points[pieces == piece]
        for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            for y in range(height):
                if min(y0, y1) <= y + 0.5 < max(y0, y1):
                    for x in range(width):
                        if x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0) <= x + 0.5:
                            out[y, x] += 1 if y1 > y0 else -1
    return out


@pytest.mark.parametrize("band", [1, 100, 1 << 22])
def test_filling_equals_points(monkeypatch, band):
    monkeypatch.setattr(raster, "BAND", band)
    rng = np.random.default_rng(4)
    for _ in range(25):
        n, pieces = int(rng.integers(3, 9)), int(rng.integers(1, 4))
        points = rng.uniform(-5, 25, (n * pieces, 2)) if rng.random() < 0.5 else rng.integers(-3, 23, (n * pieces, 2)).astype(float)
        of = np.repeat(np.arange(pieces), n)
        w = winding_by_points(points, of, 20, 16)
        edges = raster.edges_of(points, of)
        assert (raster.filled(edges, 20, 16) == (w != 0)).all()
        assert (raster.filled(edges, 20, 16, even_odd=True) == (w % 2 == 1)).all()


def test_strokes_cover_what_is_near():
    rng = np.random.default_rng(5)
    for _ in range(20):
        points, width = rng.uniform(0, 40, (4, 2)), float(rng.uniform(2, 8))
        seen = raster.filled(raster.stroked(points, np.zeros(4, int), width), 40, 40)
        y, x = np.mgrid[:40, :40] + 0.5
        away = np.full((40, 40), np.inf)
        for a, b in zip(points, points[1:], strict=False):
            step = b - a
            t = np.clip(((x - a[0]) * step[0] + (y - a[1]) * step[1]) / (step @ step), 0, 1)
            away = np.minimum(away, np.hypot(x - a[0] - t * step[0], y - a[1] - t * step[1]))
        assert seen[away < width / 2 - 1e-6].all() and not seen[away > width / 2 * 1.09].any()
    assert not raster.filled(raster.stroked(np.zeros((0, 2)), np.zeros(0, int), 2), 5, 5).any()


def test_png_comes_back():
    rng = np.random.default_rng(6)
    for shape in ((5, 7), (4, 3, 3)):
        pixels = rng.integers(0, 256, shape).astype(np.uint8)
        got, _ = images.png(raster.png(pixels))
        assert (got == (pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, axis=2))).all()


def test_drawings_of_a_file(spark):
    body = b"1 0 0 rg 10 10 m 60 10 l 60 60 l 10 60 l h 20 20 m 50 20 l 50 50 l 20 50 l f* 0 0 1 RG 4 w 65 10 m 65 60 l S 150 50 m 152 50 l 152 52 l f"
    files = spark.createDataFrame([("f", bytearray(a_file(body)))], "path string, content binary")
    got = pictures(read_files(files, "objects"), dpi=72).collect()
    assert [(r.page, r.nth, r.l, r.t, r.r, r.b) for r in got] == [(0, 0, 10, 40, 65, 90)]
    pixels, _ = images.png(bytes(got[0].png))
    assert pixels.shape == (50, 55, 3)
    red, blue, white = (255, 0, 0), (0, 0, 255), (255, 255, 255)
    assert tuple(pixels[5, 5]) == red and tuple(pixels[25, 25]) == white and tuple(pixels[25, 54]) == blue and tuple(pixels[25, 51]) == white


def test_parts_without_fill_or_line():
    part = {"shape": [0.0, 0.0, 4.0, 0.0, 4.0, 4.0], "fill": None, "line": None, "width": 0.0, "rule": "non-zero"}
    assert (drawn([part], (0, 0, 4, 4), 72) == 255).all()


def test_figures_and_text():
    """Rows of dots as text, a large sparse frame with a label, the same with rows of text in it, and a line of prose through it."""
    letters = [(x, y, x + 3, y + 4, 14) for y in range(0, 60, 10) for x in range(0, 90, 5)]
    frame = (20, 100, 79, 139, 200)
    label = (45, 118, 48, 122, 14)
    blobs = np.array([*letters, frame, label])
    assert glyph_size(blobs) == 5
    none = np.zeros((0, 4))
    assert figures(blobs, none) == [(20, 100, 80, 140, 1, 2, False)]
    rows = np.array([(25, y, 75, y + 5) for y in (102, 110, 118, 126)])
    assert figures(blobs, rows[:3])[0][-1] is False and figures(blobs, rows)[0][-1] is True
    assert figures(blobs, np.array([(0, 118, 120, 123)]))[0][-1] is True
    beside = (86, 100, 120, 139, 200)  # within two glyphs
    assert [f[:5] for f in figures(np.array([*letters, frame, beside]), none)] == [(20, 100, 121, 140, 2)]
    assert figures(np.zeros((0, 5), int), none) == []
