"""Documents written as page description files and read back: texts and letters with their places."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.plans.registry import query
from pagequarry.sources.page_files import page_file, read_files
from pagequarry.sources.views import LINES_A_PAGE, LINES_SQL, PITCH, ROW, WIDE, table

_ROWS_SQL = f"""{LINES_SQL}, cut AS (SELECT doc_id, page, line, k, substring(text, k * {ROW} + 1, {ROW}) AS text FROM lines, LATERAL (SELECT unnest(range(greatest(CAST(ceil(length(text) / {ROW}.0) AS BIGINT), 1))) AS k)),
 put AS (SELECT doc_id, page, line, k, text, {PITCH} * (row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) - 1) AS t FROM cut)"""


def as_files(docs: DataFrame) -> DataFrame:
    """``path, content``: a file a document, its lines cut into rows on a fixed grid; no shuffle."""

    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                pages = []
                for at in range(0, len(lines), LINES_A_PAGE):
                    rows = [line[k : k + ROW] for line in lines[at : at + LINES_A_PAGE] for k in range(0, max(len(line), 1), ROW)]
                    pages.append([(0.0, float(PITCH * i), row) for i, row in enumerate(rows)])
                height = PITCH * max(map(len, pages))
                yield pa.RecordBatch.from_arrays([pa.array([str(doc_id)]), pa.array([page_file(pages, ROW * WIDE, height, WIDE)], pa.binary())], ["path", "content"])

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "path string, content binary")


@query(f"WITH {_ROWS_SQL}, h AS (SELECT doc_id, max(t) + {PITCH} AS height FROM put GROUP BY doc_id) SELECT doc_id, page, any_value(height)::DOUBLE AS height, coalesce(sum(length(text)) + greatest(count(*) FILTER (text <> '') - 1, 0), 0)::BIGINT AS n_chars, md5(coalesce(string_agg(text, chr(10) ORDER BY line, k) FILTER (text <> ''), '')) AS digest FROM put JOIN h USING (doc_id) GROUP BY doc_id, page")
def page_file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and texts of the pages of written files; empty rows leave no trace on a page."""
    pages = read_files(as_files(table(spark, sf_dir, "documents")), "pages", ["path", "page", "height", "text"])
    return pages.select(F.col("path").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "height", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_ROWS_SQL} SELECT doc_id, page, sum(length(text))::BIGINT AS n, sum({WIDE} * (length(text) * (length(text) - 1)) / 2)::DOUBLE AS sum_l, sum(t * length(text))::DOUBLE AS sum_t, max({WIDE} * length(text))::DOUBLE AS r, max(t + 12) FILTER (text <> '')::DOUBLE AS b FROM put WHERE text <> '' GROUP BY doc_id, page")
def page_file_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all letters of written files, as counts, sums and bounds of a page."""
    glyphs = read_files(as_files(table(spark, sf_dir, "documents")), "glyphs", ["path", "page", "l", "t", "r", "b"]).where("l is not null")
    near = lambda c: F.round(c, 3)  # noqa: E731  units of a float's matrix
    return glyphs.groupBy(F.col("path").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"), near(F.sum("l")).alias("sum_l"), near(F.sum("t")).alias("sum_t"), near(F.max("r")).alias("r"), near(F.max("b")).alias("b"))
