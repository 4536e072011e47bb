"""Tables on pages: from rules that nearly touch, or from lines whose pieces stand below each other."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.operators.spatial import near_groups

#: Rules a grid needs, boundaries each way, share of an edge that a rule must cover, grids a page.
LEAST_RULES, LEAST_BOUNDARIES, COVERED, MOST_GRIDS = 4, 3, 0.6, 12
#: Rows, columns and characters of tables without rules, pitch limit, tables a column.
LEAST_ROWS, LEAST_COLUMNS, MOST_CHARS, PITCHES, MOST_TABLES = 3, 2, 80, 1.6, 6


def boundaries(positions: Column, snap: float) -> Column:
    """Positions as boundaries: ascending ones join the mean of those before them within ``snap``.

    ``positions`` is an array of one page's positions; the fold runs in the JVM.
    """
    start = F.struct(F.expr("cast(array() as array<double>)").alias("done"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        mean = acc["sum"] / acc["n"]
        joins = (acc["n"] > 0) & (x - mean <= snap)
        done = F.when(joins | (acc["n"] == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(mean)))
        return F.struct(done.alias("done"), F.when(joins, acc["sum"] + x).otherwise(x).alias("sum"), F.when(joins, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"))

    ascending = F.array_sort(F.transform(positions, lambda p: p.cast("double")))
    return F.aggregate(ascending, start, step, lambda acc: F.when(acc["n"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["sum"] / acc["n"]))))


def rule_groups(pages: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Rules with the number of their group. ``pages`` has ``keys`` and ``rules``, one page's rules in order."""
    fields = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    sides = ["across", "l", "t", "r", "b"]

    def run(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            bounds, flat = lists.offsets.to_numpy().tolist(), lists.values
            values = {c: flat.field(flat.type.get_field_index(c)) for c in sides}
            boxes = list(zip(*(values[c].to_pylist() for c in sides[1:]), strict=True))
            page, at, grid = [], [], []
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for number, (_, members) in enumerate(near_groups(boxes[a:b], reach)):
                    page += [i] * len(members)
                    at += [a + m for m in members]
                    grid += [number] * len(members)
            page, at = pa.array(page, pa.int64()), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(page) for i in range(len(keys))), pa.array(grid, pa.int32()), *(values[c].take(at) for c in sides)], [*keys, "grid", *sides])

    return pages.select(*keys, "rules").mapInArrow(run, f"{fields}, grid int, across boolean, l double, t double, r double, b double")


def ruled_grids(pages: DataFrame, keys: list[str], glyph: float, snap_least: float) -> DataFrame:
    """Grids of a page: ``keys, grid, row_edges, column_edges``; three boundaries each way at least."""
    snap = max(glyph * 0.3, snap_least)
    of = lambda across, mid: F.collect_list(F.when(F.col("across") == across, mid))
    each = rule_groups(pages.where(F.size("rules") >= LEAST_RULES), keys, glyph * 1.5)
    sides = each.groupBy(*keys, "grid").agg(of(True, (F.col("t") + F.col("b")) / 2).alias("ys"), of(False, (F.col("l") + F.col("r")) / 2).alias("xs"))
    found = sides.select(*keys, "grid", boundaries(F.col("ys"), snap).alias("row_edges"), boundaries(F.col("xs"), snap).alias("column_edges")).where(f"size(row_edges) >= {LEAST_BOUNDARIES} and size(column_edges) >= {LEAST_BOUNDARIES}")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("grid"))
    return found.withColumn("nth", order).where(F.col("nth") <= MOST_GRIDS).drop("nth")


def unruled_tables(pieces: DataFrame, keys: list[str], glyph: float, tolerance: float) -> DataFrame:
    """Runs of lines with equally many aligned pieces: ``keys, first_line, n_rows, n_columns, l, r``.

    ``pieces`` has ``keys, line, t, b, piece, l, r, chars``. Pieces of a line travel together, so
    all steps share one partitioning by page.
    """
    page = Window.partitionBy(*keys).orderBy("line")
    made = pieces.groupBy(*keys, "line").agg(F.min("t").alias("t"), F.max("b").alias("b"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.array_sort(F.collect_list(F.struct("piece", "l", "r"))).alias("parts"))
    steps = made.withColumn("step", F.col("t") - F.lag("t").over(page)).withColumn("steps", F.array_sort(F.collect_list("step").over(Window.partitionBy(*keys))))
    steps = steps.withColumn("pitch", F.try_element_at("steps", F.floor(F.size("steps") / 2).cast("int") + 1)).drop("steps", "step")
    fits = (F.col("n") >= LEAST_COLUMNS) & (F.col("chars") <= MOST_CHARS)
    far = F.col("t") - F.lag("b").over(page) >= F.greatest(F.coalesce("pitch", F.lit(0)), F.lit(glyph)) * PITCHES
    starts = F.lag("fits").over(page).isNull() | ~F.lag("fits").over(page) | (F.lag("n").over(page) != F.col("n")) | far
    runs = steps.withColumn("fits", fits).withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(page.rowsBetween(Window.unboundedPreceding, 0))).where("fits")
    column = runs.select(*keys, "run", "line", F.explode("parts").alias("p")).groupBy(*keys, "run", "p.piece").agg(F.min("line").alias("first_line"), F.count("*").alias("n_rows"), F.min("p.l").alias("l0"), F.max("p.l").alias("l1"), F.min("p.r").alias("r0"), F.max("p.r").alias("r1"))
    after = Window.partitionBy(*keys, "run").orderBy("piece")
    apart = F.coalesce(F.col("l0") > F.lag("r1").over(after), F.lit(True))
    even = (F.col("l1") - F.col("l0") <= tolerance) | (F.col("r1") - F.col("r0") <= tolerance)
    whole = column.withColumn("good", apart & even).groupBy(*keys, "run").agg(F.min("first_line").alias("first_line"), F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"), F.min("l0").alias("l"), F.max("r1").alias("r"), F.bool_and("good").alias("good"))
    ranked = whole.where((F.col("n_rows") >= LEAST_ROWS) & F.col("good")).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")))
    return ranked.where(F.col("nth") <= MOST_TABLES).select(*keys, "first_line", "n_rows", "n_columns", "l", "r")
