"""Plans whose steps grow no faster than the tables, and what they give on odd rows."""

import hashlib

import pyarrow as pa

from pagequarry.plans import anchors, joins, layout, packages
from pagequarry.plans.catalog import QUERIES
from pagequarry.sources import page_files

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().split("\n")


def depth(lines, *parts):
    return [len(x) - len(x.lstrip(" :+-")) for x in lines if all(p in x for p in parts)]


def test_marks_meet_lines_before_they_are_laid_out(spark):
    for name in ("char_links", "styled_runs"):
        lines = plan(spark, name)
        laid = depth(lines, "Generate explode(", "sequence(")
        joined = [d for d in depth(lines, "Join Inner")]
        assert laid and all(any(j > d for j in joined) for d in laid), name


def test_blanks_are_counted_not_laid_out(spark):
    assert not depth(plan(spark, "kept_blanks"), "Generate explode(filter(")


def test_words_are_not_laid_out(spark):
    assert not depth(plan(spark, "words_in_figures"), "Generate posexplode(split", "text", " , ")
    assert not [x for x in plan(spark, "words_in_figures") if "Join" in x and ">=" in x]


def test_cells_at_one_place_and_equal_fills_meet_once(spark):
    at = "sheet long, l long, t long, r long, b long"
    c = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (2, 0, 0, 0, 10, 10), (3, 0, 200, 0, 210, 10), (3, 0, 0, 0, 10, 10)], f"cell long, {at}")
    f = spark.createDataFrame([(9, 0, 0, 0, 10, 10), (4, 0, 0, 0, 10, 10), (5, 0, 0, 0, 40, 40)], f"fill long, {at}")
    got = sorted((r.cell, r.fills, r.x.area, r.x.fill) for r in layout.covering_fills(c, f).collect())
    assert got == [(1, 3, 100, 4), (2, 3, 100, 4), (3, 3, 100, 4)]
    for name in ("cell_shading", "cell_colours"):
        lines = plan(spark, name)
        assert sum("Aggregate [sheet" in x for x in lines) >= 2, name  # places and fills, before they meet


def test_letters_of_a_row_are_boxed_together(spark, tmp_path):
    text = "ab  cd" + " " * 4 + "e" * 50 + " " * 3 + "f" * 60
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.row, r.ord, r.l, r.r) for r in joins.range_rects(spark, str(tmp_path)).collect())
    chars = [(i // 90, i % 90) for i, c in enumerate(text) if c != " " and i % 37 >= 7]
    want = []
    for row, k in chars:
        if want and want[-1][0] == row and 10 * (k - want[-1][2]) <= 36:
            want[-1][2] = k + 1
        else:
            want.append([row, k, k + 1])
    assert [(a, c, d) for a, _, c, d in got] == [(r, 10 * a, 10 * b) for r, a, b in want]
    assert "StringTrimLeft" in joins.range_rects(spark, FOLDER)._jdf.queryExecution().analyzed().toJSON()


def test_slots_stream_and_hold_no_table(spark):
    assert not [x for x in plan(spark, "tagged_slots") if "collect_list" in x]
    assert [x for x in plan(spark, "tagged_slots") if "MapInArrow" in x]


def test_of_cells_in_one_slot_the_upper_comes_first(spark, tmp_path):
    cells = [(1, 1, 1), (2, 2, 3), (4, 3, 1), (7, 1, 1), (8, 1, 1)]  # line, columns, rows: the fifth stands in a slot that the second still reaches into
    rows = [(1, n, a, b) for n, a, b in cells]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    cell = lambda n, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>" + (f'<w:r><w:t xml:space="preserve">{n}</w:t></w:r>' if n else "") + "</w:p></w:tc>"
    wide = lambda k: f'<w:gridSpan w:val="{k}"/>'
    first = cell(1) + cell(2, wide(2) + '<w:vMerge w:val="restart"/>')
    second = cell(4, wide(3)) + cell(None, wide(2) + "<w:vMerge/>")
    third = cell(7) + cell(None, wide(2) + "<w:vMerge/>") + cell(8)
    got = packages.table_rows(spark, str(tmp_path)).collect()
    assert [(r.columns, r.rows) for r in got] == [(3, 3)]
    assert got[0].digest == hashlib.md5("".join(f"<w:tr>{x}</w:tr>" for x in (first, second, third)).encode()).hexdigest()


def test_dropped_places_count_once_and_only_on_blanks(spark, tmp_path):
    spark.createDataFrame([(1, "a b c\n \nxyz")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1201, 1), (1, 1), (0, 1)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.doc_id, r.line, r.blanks) for r in anchors.kept_blanks(spark, str(tmp_path)).collect())
    # 1201 drops place 2 of line 1, which has none there; 1 the same; 0 drops a letter
    assert got == [(1, 0, 2), (1, 1, 1)]


def test_letters_of_page_files_come_by_columns():
    pages = [[(0.0, 0.0, "ab c"), (0.0, 16.0, "x")], [], [(10.0, 0.0, "z\U0001f600")]]
    data = page_files.page_file(pages, 100, 40)
    wanted = {"path", "page", "idx", "ch", "l", "b", "size"}
    got = list(page_files.found_in("f", data, "glyphs", wanted))
    assert got and all(isinstance(x, pa.RecordBatch) for x in got)
    letters = [(r["page"], r["idx"], r["ch"], r["l"]) for x in got for r in x.to_pylist()]
    assert letters[:6] == [(0, 0, "a", 0.0), (0, 1, "b", 10.0), (0, 2, " ", 20.0), (0, 3, "c", 30.0), (0, 4, "\n", None), (0, 5, "x", 0.0)]
    assert [x[:3] for x in letters[6:]] == [(2, 0, "z"), (2, 1, "\U0001f600")]


def test_a_matrix_and_digits_at_once_are_as_one_by_one():
    at_once, apart = ([[(1.5, 2.0, "abc")]] for _ in range(2))
    whole = page_files.page_file(at_once, 100, 40, packed=False)
    split = page_files.page_file(apart, 100, 40, packed=False).replace(b" Tm <", b" Tm\n%\n<")
    rows = [[r for x in page_files.found_in("f", data, "glyphs", set(page_files.columns_of("glyphs"))) for r in x.to_pylist()] for data in (whole, split)]
    assert rows[0] == rows[1] and len(rows[0]) == 3
