"""Tables, ink and names on small inputs and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import names as n
from pagequarry.functions.text import roman_value
from pagequarry.operators import ink
from pagequarry.operators.spatial import Grid, inflated, kept_apart, meets, near_groups, union
from pagequarry.operators.tables import boundaries, ruled_grids, unruled_tables
from pagequarry.plans.catalog import QUERIES
from pagequarry.plans.ink import bitmap, page_texts
from pagequarry.operators.trees import depths, nearest_ancestor
from pagequarry.plans.joins import range_boxes
from pagequarry.plans.search import hits
from pagequarry.streaming.replay import cache_use

FOLDER = "/root/testdata/sf0.001"


def flooded(seen, least=4):
    seen, out = seen.copy(), []
    for y, x in zip(*np.nonzero(seen), strict=True):
        if not seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = False
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for i in range(max(a - 1, 0), min(a + 2, seen.shape[0])):
                for j in range(max(b - 1, 0), min(b + 2, seen.shape[1])):
                    if seen[i, j]:
                        seen[i, j] = False
                        stack.append((i, j))
        ys, xs = zip(*cells, strict=True)
        if len(cells) >= least:
            out.append(tuple(map(int, (min(xs), min(ys), max(xs), max(ys), len(cells)))))
    return sorted(out)


def test_blobs_as_flooded():
    """Several bitmaps at once, with ink at their edges: nothing joins across pages."""
    draw = np.random.default_rng(1)
    pages = [draw.random(shape) < share for share in (0.05, 0.2, 0.4, 0.6, 0.9) for shape in ((1, 1), (1, 40), (40, 1), (23, 31))] + [np.zeros((5, 5), bool)]
    found = ink.Sheets(pages).blobs()
    for i, page in enumerate(pages):
        assert sorted(tuple(map(int, x[1:])) for x in found if x[0] == i) == flooded(page)
    assert len(ink.Sheets([]).blobs()) == 0


def test_blobs_of_all_pages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 10")
    expected = sorted((r.doc_id, r.page, *b) for r in page_texts(docs).collect() for b in flooded(bitmap(r.lines)))
    assert sorted(map(tuple, QUERIES["ink_blobs"](spark, FOLDER).where("doc_id < 10").collect())) == expected


def test_darkest_place_and_heights(spark):
    rows = {(r.doc_id, r.page): r for r in QUERIES["page_ink"](spark, FOLDER).where("doc_id < 10").collect()}
    for r in page_texts(spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 10")).collect():
        seen = bitmap(r.lines)
        heights = sorted(b[3] - b[1] + 1 for b in flooded(seen, 8))
        got = rows[r.doc_id, r.page]
        assert got.height == (heights[len(heights) // 2] if heights else 0)
        assert got.darkest == ink.box_blur(np.where(seen, 0, 255).astype(np.uint8), 2).min()


def test_blur_as_stated():
    grey = np.random.default_rng(2).integers(0, 256, (9, 13)).astype(np.uint8)
    for radius in (1, 2, 4):
        wide = 2 * radius + 1
        along = np.array([[sum(int(row[min(max(x + k, 0), 12)]) for k in range(-radius, radius + 1)) // wide for x in range(13)] for row in grey])
        down = np.array([[sum(int(along[min(max(y + k, 0), 8), x]) for k in range(-radius, radius + 1)) // wide for x in range(13)] for y in range(9)])
        assert np.array_equal(ink.box_blur(grey, radius), down)


def test_slopes_of_lines():
    pages = []
    for degrees in (-2.0, 0.0, 3.0):
        page, x = np.zeros((600, 800), bool), np.arange(800)
        for y in range(60, 540, 60):
            at = np.round(y + x * np.tan(np.radians(degrees))).astype(int)
            for k in range(8):
                page[at + k, x] = True
        pages.append(page)
    slopes = ink.Sheets([*pages, np.zeros((50, 50), bool)]).slopes()
    assert [abs(round(np.degrees(np.arctan(s / 10_000)), 3) - d) <= 0.15 for s, d in zip(slopes, (-2.0, 0.0, 3.0, 0.0), strict=True)] == [True] * 4 and slopes[3] == 0


def brute_word_lines(boxes, glyph):
    """Word by word against every open line, one after another."""
    tails, line = [], [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda k: boxes[k][0]):
        left, top, _, bottom = boxes[i]
        scores = []
        for _, up, right, low in tails:
            lesser = min(bottom - top, low - up)
            scores.append((min(bottom, low) - max(top, up)) / lesser if lesser > 0 and left >= right - glyph / 2 else 0)
        best = max(range(len(scores)), key=lambda k: scores[k], default=None)
        if best is None or scores[best] <= 0.5:
            best = len(tails)
            tails.append(None)
        tails[best] = boxes[i]
        line[i] = best
    return line


def test_words_in_lines():
    assert ink.word_lines(np.array([(0, 0, 10, 12), (12, 3, 20, 15), (0, 20, 10, 32), (22, 19, 30, 31)], float), 12).tolist() == [0, 0, 1, 1]
    assert len(ink.word_lines(np.zeros((0, 4)), 12)) == 0
    draw = np.random.default_rng(4)
    for _ in range(30):
        at = draw.integers(0, 200, (40, 2)).astype(float)
        boxes = np.concatenate([at, at + draw.integers(0, 30, (40, 2))], axis=1)
        assert ink.word_lines(boxes, 12).tolist() == brute_word_lines([tuple(b) for b in boxes], 12)


def groups_by_comparing(boxes, reach, kinds, home):
    """Groups by comparing every box with every group, in order."""
    held = []  # bounds, members, kind
    for i, (box, kind) in enumerate(zip(boxes, kinds, strict=True)):
        if home == "new":
            now, members = box, [i]
            for k in reversed(range(len(held))):
                if held[k][2] == kind and meets(held[k][0], inflated(now, reach)):
                    now, members = union(now, held[k][0]), held[k][1] + members
                    del held[k]
            held.append((now, members, kind))
            continue
        near = [k for k, h in enumerate(held) if h[2] == kind and meets(h[0], inflated(box, reach))]
        if not near:
            held.append((box, [i], kind))
            continue
        to = near[0] if home == "first" else near[-1]
        held[to] = (union(box, *(held[k][0] for k in near)), held[to][1] + [i] + [m for k in near if k != to for m in held[k][1]], kind)
        held = [h for k, h in enumerate(held) if k == to or k not in near]
    return [(b, sorted(m)) for b, m, _ in held]


@pytest.mark.parametrize("home", ["first", "last", "new"])
def test_near_groups_equal_comparing_all(home):
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 40, 120):
        for _ in range(12):
            corner = rng.integers(0, 400, (size, 2))
            boxes = [tuple(map(int, (x, y, x + w, y + h))) for (x, y), w, h in zip(corner, rng.integers(0, 60, size) ** 2 // 20, rng.integers(1, 30, size), strict=True)]
            kinds = rng.integers(0, 2, size).tolist()
            for of in (kinds, [None] * size):
                got = [(b, sorted(m)) for b, m in near_groups(boxes, 3, of if of is kinds else None, home)]
                assert got == groups_by_comparing(boxes, 3, of, home)


def test_grid_forgets():
    g = Grid()
    g.add(1, (0, 0, 1, 1))
    g.add(2, (-500, -500, 500, 500))
    assert g.near((0.5, 0.5, 2, 2)) == [1, 2] and g.near((1, 1, 2, 2), touching=True) == [1, 2]
    g.remove(2)
    assert g.near((0.5, 0.5, 2, 2)) == [1] and g.near((1, 1, 2, 2)) == []


def test_kept_apart(spark):
    rows = [(1, 0, 0, 0, 10, 10, True), (1, 1, 5, 5, 15, 15, True), (1, 2, 12, 12, 20, 20, False), (1, 3, 30, 0, 40, 10, False), (1, 4, 35, 5, 45, 15, False), (2, 4, 35, 5, 45, 15, False)]
    df = spark.createDataFrame(rows, "page long, nth long, l long, t long, r long, b long, free boolean")
    assert sorted((r.page, r.nth) for r in kept_apart(df, "page", ["nth"], F.col("free")).collect()) == [(1, 0), (1, 1), (1, 3), (2, 4)]


def test_ruled_grid(spark):
    across = [{"across": True, "l": 0.0, "t": y, "r": 60.0, "b": y + 1.0} for y in (0.0, 20.0, 40.0)]
    down = [{"across": False, "l": x, "t": 0.0, "r": x + 1.0, "b": 40.0} for x in (0.0, 30.0, 31.0, 60.0)]
    pages = spark.createDataFrame([(1, across + down), (2, across), (3, [])], "page int, rules array<struct<across:boolean,l:double,t:double,r:double,b:double>>")
    assert [tuple(r) for r in ruled_grids(pages, ["page"], 12, 2).collect()] == [(1, 0, [0.5, 20.5, 40.5], [0.5, 31.0, 60.5])]


def test_boundaries_fold(spark):
    df = spark.createDataFrame([([5.0, 1.0, 3.0, 20.0],), ([],)], "p array<double>")
    assert [r.b for r in df.select(boundaries(F.col("p"), 3).alias("b")).collect()] == [[3.0, 20.0], []]


def test_unruled_table_needs_aligned_edges(spark):
    rows = [(1, y, y * 16, y * 16 + 12, c, 100 * c, 100 * c + 30 + y, 5) for y in range(4) for c in range(3)]
    ragged = [(2, y, y * 16, y * 16 + 12, c, 100 * c + 20 * y, 100 * c + 30 + 25 * y, 5) for y in range(4) for c in range(3)]
    df = spark.createDataFrame(rows + ragged + [(3, 0, 0, 12, 0, 0, 9, 5)], "page int, line int, t int, b int, piece int, l int, r int, chars int")
    assert [tuple(r) for r in unruled_tables(df, ["page"], 12, 5).collect()] == [(1, 0, 4, 3, 0, 233)]


def test_range_boxes_split_by_accumulated_height(spark):
    boxes = [(0, 0, 10, 30), (95, 0, 105, 10), (190, 0, 200, 10), (291, 0, 300, 10), (340, 0, 350, 10)]
    df = spark.createDataFrame([(boxes,), ([],)], "x array<struct<l:bigint,t:bigint,r:bigint,b:bigint>>")
    got = [[tuple(b) for b in r.y] for r in df.select(range_boxes(F.col("x")).alias("y")).collect()]
    assert got == [[(0, 0, 200, 30), (291, 0, 300, 10), (340, 0, 350, 10)], []]


def test_ancestors_and_depths(spark):
    df = spark.createDataFrame([(1, None, True), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, False)], "node long, parent long, meaningful boolean")
    assert sorted((r.node, r.ancestor) for r in nearest_ancestor(df).collect()) == [(1, None), (2, 1), (3, 1), (4, 1), (5, 4)]
    chain = [(i, i - 1 if i else None, i == 0) for i in range(80)] + [(100, 101, False), (101, 100, False), (200, 999, False)]
    df = spark.createDataFrame(chain, "node long, parent long, meaningful boolean")
    found = {r.node: r.depth for r in depths(df).collect()}
    assert found == {i: i for i in range(65)}  # 64 levels below the root; neither cycles nor what hangs on nothing
    assert {r.node: r.ancestor for r in nearest_ancestor(df).collect() if 0 < r.node < 64} == {i: 0 for i in range(1, 64)}


def test_folds_hold_the_state_only(spark):
    rows = [(u, t, (t * 7 + u) % 5, 10 + t % 3) for u in (1, 2) for t in range(50)]
    df = spark.createDataFrame([(u, t, t, k, n) for u, t, k, n in rows], "user_id long, ts long, event_id long, key long, size long").repartition(5)
    for most in (1, 25, 1000):
        for r in cache_use(df, most).collect():
            held, hits, gone = [], 0, 0
            for u, _, k, n in rows:
                if u == r.user_id:
                    size = dict(held).get(k, n)
                    hits += any(k == x for x, _ in held)
                    held = [x for x in held if x[0] != k] + [(k, size)]
                    while len(held) > 1 and sum(x for _, x in held) > most:
                        held.pop(0)
                        gone += 1
            assert (r.hits, r.evicted, r.held, r.newest) == (hits, gone, len(held), held[-1][0])
    assert cache_use(df.limit(0), 5).count() == 0


def find(spark, text, query, **how):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.start, r.length, r.before, r.hit, r.after) for r in hits(df, query, **how).orderBy("start").collect()]


def test_search_rules(spark):
    assert len(find(spark, "Visit the CAFÉ today", "cafe")) == 1 and len(find(spark, "cafe\u0301 Cafe", "café")) == 2
    assert find(spark, "quick brown\n  fox jumps", "brown fox")[0][:2] == (6, len("brown\n  fox"))
    assert len(find(spark, "cat concatenate cats", "cat", whole_word=True)) == 1 and len(find(spark, "cat concatenate cats", "cat")) == 3
    assert find(spark, "cat", "Cat", match_case=True) == []
    assert find(spark, "first line here\nthe lazy dog sleeps\nnext line", "lazy") == [(20, 4, "the ", "lazy", " dog sleeps")]
    (hit,) = find(spark, "x" * 50 + " The needle is here " + "y" * 50, "needle")
    assert hit[2].startswith("…") and hit[4].endswith("…") and hit[3] == "needle"
    assert find(spark, "so\u00adft hy\u00adphen", "soft  hyphen")[0][:2] == (0, 13)
    assert len(find(spark, "a.b a+b (a", "a+b")) == 1 and find(spark, "😀 needle", "NEEDLE")[0][0] == 2
    assert len(find(spark, "aaaa", "aa")) == 2 and find(spark, "", "a") == []


def test_dates_and_names(spark):
    cases = ["D:20240229103000+05'30'", "D:2024", "D:20230231", "D:20241399", "x", "", None, "D:20240101000000-15'00'"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r.d and str(r.d) for r in df.select(n.pdf_date(F.col("s")).alias("d")).collect()]
    assert got == ["2024-02-29 05:00:00", "2024-01-01 00:00:00", None, "2024-12-31 00:00:00", None, None, None, None]
    df = spark.createDataFrame([("iv", "Ann B. van C-d"), ("vix", "1 2"), ("MCMXC", "")], "r string, a string")
    assert [tuple(r) for r in df.select(roman_value(F.col("r")), n.initials(F.col("a"))).collect()] == [(4, "ABV"), (14, "PDF"), (1990, "PDF")]


def lines_by_comparing(boxes, glyph, column):
    """Each word against the ends of all lines of its column."""
    ends, out = [], {}
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][0]):
        left, top, _, bottom = boxes[i]
        best, most = None, 0.5
        for k, ((_, t, r, b), c) in enumerate(ends):
            lesser = min(bottom - top, b - t)
            if c == column[i] and left >= r - glyph / 2 and lesser > 0 and (min(bottom, b) - max(top, t)) / lesser > most:
                best, most = k, (min(bottom, b) - max(top, t)) / lesser
        if best is None:
            ends.append(None)
            best = len(ends) - 1
        ends[best] = (boxes[i], column[i])
        out[i] = best
    return [out[i] for i in range(len(boxes))]


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_word_lines_in_columns(columns):
    rng = np.random.default_rng(columns)
    for _ in range(60):
        n = int(rng.integers(0, 60))
        column = rng.integers(0, columns, n)
        left = column * 300 + rng.integers(0, 250, n)
        top = rng.integers(0, 12, n) * 14.0 + rng.integers(0, 5, n)
        boxes = np.stack([left, top, left + rng.integers(5, 40, n), top + rng.integers(0, 16, n)], axis=1).astype(float)
        assert ink.word_lines(boxes, 10.0, column).tolist() == lines_by_comparing(boxes.tolist(), 10.0, column.tolist())
        if columns == 1:
            assert ink.word_lines(boxes, 10.0).tolist() == ink.word_lines(boxes, 10.0, column).tolist()
