"""Rules on small inputs."""

import re

import numpy as np
from pyspark.sql import functions as F

from pagequarry.functions import geometry as g
from pagequarry.functions.stats import lower_median, nearest_rank, ranked_groups, upper_median
from pagequarry.functions.text import folded, roman_value, visible_chars
from pagequarry.operators.glyphs import breaks, placed_lines
from pagequarry.operators.shapes import as_of
from pagequarry.plans.search import hits
from pagequarry.streaming.replay import debounced, forwarded, undo_step, upsert_recents


def one(df):
    return list(df.first())


def test_medians_take_elements(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int")
    assert one(df.agg(upper_median(F.col("v")), lower_median(F.col("v")), nearest_rank(F.col("v"), 0.5))) == [3, 2, 3]


def test_ranked_groups_agree_with_lists(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 1, 9)] + [("b", 7)], "k string, v int")
    assert sorted(map(tuple, ranked_groups(df, ["k"], "v", {"m": F.floor(F.col("n") / 2)}).collect())) == [("a", 5), ("b", 7)]


def test_text_rules(spark):
    df = spark.createDataFrame([("  a \n b­ c ", "xiv"), ("", "mm"), ("x", "q1")], "t string, r string")
    got = [list(r) for r in df.select(visible_chars(F.col("t")), folded(F.col("t")), roman_value(F.col("r"))).collect()]
    assert got == [[4, "a b c ", 14], [0, "", 2000], [1, "x", None]]


def test_empty_rectangles(spark):
    empty, full = g.rect(*map(F.lit, (5, 5, 5, 9))), g.rect(*map(F.lit, (0, 0, 4, 4)))
    touch = g.rect(*map(F.lit, (4, 0, 8, 4)))
    row = one(spark.range(1).select(g.union(empty, full)["r"], g.intersects(full, touch), g.contains(full, F.lit(4), F.lit(4))))
    assert row == [4, False, True]


def test_visual_lines_break_and_stack():
    boxes = np.array([(0, 0, 10, 12), (10, 0, 20, 12), (0, 16, 10, 28), (0, 26, 10, 38), (0, 90, 10, 99)])
    assert breaks(boxes, np.array([0, 0, 0, 0, 1])).tolist() == [False, False, True, False, False]


def test_lines_of_blanks_and_wide_letters(spark):
    texts = ["  a", "    ", "", "é" * 95, "\U0001f600 x"]
    lines_ = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], "doc_id long, page long, line long, text string")
    got = sorted(tuple(r)[2:] for r in placed_lines(lines_).collect())
    assert got == [(0, 0, 0, 3, 20, 0, 30, 12), (1, 0, 0, 4, None, None, None, None), (3, 0, 0, 90, 0, 0, 900, 12), (3, 1, 90, 5, 0, 16, 50, 28), (4, 0, 0, 3, 0, 0, 30, 12)]


def test_as_of_takes_the_later_of_ties(spark):
    marks = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 20, 3, "c")], "k int, at int, ord int, v string")
    points = spark.createDataFrame([(1, 5, "x"), (1, 10, "y"), (1, 25, "z"), (2, 9, "w")], "k int, at int, p string")
    assert sorted((r.p, r.v) for r in as_of(points, marks, ["k"], "at", ["ord"], ["v"]).collect()) == [("w", None), ("x", None), ("y", "b"), ("z", "c")]


def test_whole_word_hits(spark):
    df = spark.createDataFrame([(1, "cat concatenate cats")], "doc_id long, text string")
    assert hits(df, "cat").count() == 3
    assert [r.start for r in hits(df, "cat", whole_word=True).collect()] == [0]


def test_snippet_stays_on_its_line(spark):
    df = spark.createDataFrame([(1, "one\nthe lazy dog sleeps\nend")], "doc_id long, text string")
    found = hits(df, "lazy").first()
    assert [found.before, found.hit, found.after] == ["the ", "lazy", " dog sleeps"]


def test_undo_redo():
    def fold_undo(steps):
        state = ([], [])
        for i, kind in steps:
            state = undo_step(state, i, kind)
        return state

    assert fold_undo([(1, "do"), (2, "do"), (3, "undo"), (4, "redo"), (5, "undo"), (6, "do"), (7, "redo")]) == ([1, 6], [])
    assert fold_undo([(i, "do") for i in range(150)])[0][0] == 50


def test_debounce_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, debounced(events).collect()))


def test_recents_upsert(spark):
    a = spark.createDataFrame([("A", 1), ("b", 2)], "path string, ts int")
    b = spark.createDataFrame([("a", 3)], "path string, ts int")
    assert [tuple(r) for r in upsert_recents(b, a).collect()] == [("a", 3), ("b", 2)]


def test_forwarded_files_upsert_recents(spark, tmp_path):
    """Files asked for while a stream runs come into the recents, once each, the newest first; broken lines are passed over."""
    source, kept = tmp_path / "asked", []
    source.mkdir()

    def keep(batch, _):
        before = spark.createDataFrame(kept, "path string, ts timestamp") if kept else None
        kept[:] = upsert_recents(batch, before).collect()

    for day, line in ((1, '{"path": "A.pdf", "ts": "2024-01-01T00:00:00"}\n{"path": "b.pdf", "ts": "2024-01-02T00:00:00"}\n'), (2, '{"path": "a.PDF", "ts": "2024-01-03T00:00:00"}\n{broken\n')):
        (source / f"{day}.json").write_text(line)
        forwarded(spark, str(source)).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(60)
    assert [r.path for r in kept] == ["a.PDF", "b.pdf"]


def test_hits_of_long_lines_and_many_hits(spark):
    """Contexts and places against slices of the text: a line of 100,000 characters, a thousand hits, hits that touch."""
    texts = ["x" * 60_000 + " cat " + "y" * 40_000, "cat" * 30 + "\n" + " dog cat, " * 1_000, "a\u00ad\ncat\u00ad", "cat", "no", "c\u00adat concat cat1 cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shown(text, a, b):
        tidy = lambda t: re.sub(r"\s+", " ", t.replace("\u00ad", ""))
        left, right = text[:a].rsplit("\n", 1)[-1], text[b:].split("\n", 1)[0]
        return ("…" + tidy(left[-40:]).lstrip(" ") if len(left) > 40 else tidy(left), tidy(text[a:b]), tidy(right[:40]).rstrip(" ") + "…" if len(right) > 40 else tidy(right))

    for whole in (False, True):
        want = []
        for i, t in enumerate(texts):
            for m in re.finditer("c\u00ad*a\u00ad*t", t):
                next_to = t[: m.start()].rstrip("\u00ad")[-1:] + t[m.end() :].lstrip("\u00ad")[:1]
                if not whole or not any(c.isalnum() for c in next_to):
                    want.append((i, 0, m.start(), m.end() - m.start(), *shown(t, m.start(), m.end())))
        assert sorted(tuple(r) for r in hits(df, "cat", whole_word=whole).collect()) == sorted(want)
