"""Readers and sinks: pictures, extractors, caches, JSON, logs, swaps and packages."""

import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.plans.files import bodies
from pagequarry.sources import images, sinks
from pagequarry.sources.documents import plain_text, read_cache, read_documents, recognised, write_cache
from pagequarry.sources.views import table

FOLDER = "/root/testdata/sf0.001"


def as_png(pixels, colour, filters, dpi=None, extra=b""):
    """A PNG with the given filter for each row in turn."""
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, width, -1).astype(np.int64)
    raw, above = b"", np.zeros_like(rows[0])
    for y in range(height):
        kind, line = filters[y % len(filters)], rows[y]
        left = np.vstack([np.zeros_like(line[:1]), line[:-1]])
        corner = np.vstack([np.zeros_like(above[:1]), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    out = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra
    if dpi:
        out += part(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1))
    return out + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize(("colour", "samples"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_of_every_filter(colour, samples):
    pixels = np.random.default_rng(colour).integers(0, 256, (11, 7, samples)).astype(np.uint8)
    got, dpi = images.png(as_png(pixels, colour, [0, 1, 2, 3, 4], 300))
    if samples in (1, 3):
        want = np.repeat(pixels, 3, axis=2) if samples == 1 else pixels
    else:
        alpha = pixels[..., -1:].astype(float) / 255
        want = np.round(np.repeat(pixels[..., :1], 3, axis=2) * alpha + 255 * (1 - alpha)) if samples == 2 else np.round(pixels[..., :3] * alpha + 255 * (1 - alpha))
    assert np.abs(got.astype(float) - want).max() <= (0 if samples in (1, 3) else 1) and abs(dpi - 300) < 0.1


def test_pictures_as_pages(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    (tmp_path / "a.PNG").write_bytes(as_png(pixels, 2, [4], 10_000))
    (tmp_path / "b.ppm").write_bytes(b"P6\n# made here\n6 5\n255\n" + pixels.tobytes())
    step = (6 * 3 + 3) // 4 * 4
    rows = b"".join(pixels[y, :, ::-1].tobytes().ljust(step, b"\0") for y in range(4, -1, -1))
    (tmp_path / "c.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 6, 5, 1, 24, 0, len(rows), 11811, 11811, 0, 0) + rows)
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\ncut off")
    (tmp_path / "e.txt").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.PNG", "b.ppm", "c.bmp", "d.png"} and got["d.png"].error and got["d.png"].width is None
    grey = images.luminance(pixels).tobytes()
    assert all(bytes(got[k].grey) == grey and got[k].error is None for k in ("a.PNG", "b.ppm", "c.bmp"))
    assert got["a.PNG"].dpi == 96 and round(got["c.bmp"].dpi) == 300 and abs(got["b.ppm"].width_pt - 6 * 72 / 96) < 1e-9


def test_clean_up_of_scans():
    page = np.full((120, 160), 200, np.uint8) - np.linspace(0, 90, 160).astype(np.uint8)
    page[40:60, 30:130] = page[40:60, 30:130] // 4
    spread, threshold = images.cleaned(page, 12)
    dark = spread < threshold
    assert dark[45:55, 35:125].mean() > 0.9 and dark[:20].mean() < 0.05
    square = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert images.resized(square, 2, 2).tolist() == [[0, 2], [8, 10]] and images.cropped(square, 1, 1, 3, 9).shape == (3, 2)


def test_documents_by_an_extractor(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe broken")
    got = sorted((r.path[-5:], r.page, r.text, r.error is None) for r in read_documents(spark, str(tmp_path), plain_text, "*.txt").collect())
    assert got[:2] == [("a.txt", 0, "one", True), ("a.txt", 1, "two", True)] and got[2][0] == "b.txt" and not got[2][3]


def test_cache_of_recognised_pages(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = [("k1", 0, [("a", [0.1234567, 0.2, 0.3, 0.4]), ("b", [0.1])]), ("k2", 1, [])]
    write_cache(spark.createDataFrame(rows, "document_key string, page int, words array<struct<t:string,b:array<double>>>"), folder)
    write_cache(spark.createDataFrame([("k2", 1, [("c", [0.0, 0.0, 1.0, 1.0])])], "document_key string, page int, words array<struct<t:string,b:array<double>>>"), folder)
    cache = read_cache(spark, folder)
    assert sorted((r.document_key, r.page, [(w.t, w.b) for w in r.words]) for r in cache.collect()) == [("k1", 0, [("a", [0.12346, 0.2, 0.3, 0.4])]), ("k2", 1, [("c", [0.0, 0.0, 1.0, 1.0])])]
    pages = spark.createDataFrame([("k1", 0, 1, 1, b"\0"), ("k3", 2, 1, 1, b"\0"), ("k4", 0, 1, 1, None)], "document_key string, page int, width int, height int, grey binary")
    done = recognised(pages, cache, lambda grey, w, h: [(" word ", [0, 0, 1, 1]), ("  ", [0, 0, 0, 0])]).collect()
    assert [(r.document_key, r.page, [w.t for w in r.words]) for r in done] == [("k3", 2, ["word"])]


def test_json_logs_and_swaps(spark, tmp_path):
    name = str(tmp_path / "state.json")
    for value in ({"a": 1}, {"ä": [1, None]}):
        sinks.write_json(spark, value, name)
        assert spark.read.json(name).count() == 1 and len([p for p in tmp_path.iterdir() if "tmp" in p.name and not p.name.startswith(".")]) == 0
    log = str(tmp_path / "log")
    edits = [(1, 1, 1, "add", "x"), (1, 1, 2, "recolor", "y"), (1, 2, 1, "add", "z"), (1, 2, 3, "delete", None)]
    for e in edits:
        sinks.append_edits(spark.createDataFrame([e], "doc_id long, annot_id long, seq long, op string, value string"), log)
    assert [tuple(r) for r in sinks.current_state(spark.read.parquet(log)).collect()] == [(1, 1, 2, "recolor", "y")]
    folder = str(tmp_path / "table")
    sinks.swap_table(spark.range(3), folder)
    sinks.swap_table(spark.read.parquet(folder).where("id > 0"), folder)
    assert sorted(r.id for r in spark.read.parquet(folder).collect()) == [1, 2] and not [p for p in tmp_path.iterdir() if ".old" in p.name or ".new" in p.name]


def test_packages_hold_all_text(spark):
    docs = table(spark, FOLDER, "documents").where("doc_id < 12")
    made = bodies(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sinks.packages(made).collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
            assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml"} <= set(z.namelist())
            root = ElementTree.fromstring(z.read("word/document.xml"))
            for name in z.namelist():
                ElementTree.fromstring(z.read(name))
        found = "".join(t.text or "" for t in root.iter(f"{{{sinks.W}}}t"))
        # Every visible character, in order; markers were put in by the page's making.
        assert "".join(found.split()).replace("•", "").replace("2.", "") == "".join(texts[r.doc_id].split()).replace("•", "").replace("2.", "")
        assert bytes(r.content) == sinks.package(made.where(F.col("doc_id") == r.doc_id).first().body)


def test_fonts_and_sizes(spark):
    data, guid = bytes(range(100)), "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    hidden = sinks.obfuscated(data, guid)
    assert hidden[0] == 0xFF and hidden[16] == 16 ^ 0xFF and hidden[32:] == data[32:] and sinks.obfuscated(hidden, guid) == data
    df = spark.createDataFrame([(0.1,), (11.25,), (11.75,), (9999.0,)], "p double")
    assert [r.h for r in df.select(sinks.half_points(F.col("p")).alias("h")).collect()] == [2, 22, 24, 3276]
