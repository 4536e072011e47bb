"""Document tables as pages, lines and glyphs.

A document's lines are its text between newlines; a page is 40 lines. Glyphs stand on a fixed
pitch in whole units: 10 wide, 12 high, rows 16 apart, 90 to a row; blanks have no box.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE, ROW, WIDE, HIGH, PITCH = 40, 90, 10, 12, 16

#: The same lines in DuckDB.
LINES_SQL = f"lines AS (SELECT doc_id, page, line, text FROM (SELECT doc_id, CAST(i // {LINES_A_PAGE} AS BIGINT) AS page, CAST(i AS BIGINT) AS line, l[i + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL (SELECT unnest(range(len(l))) AS i) u))"


#: A table up to this size may be one group of rows in its file, which one task reads.
ONE_GROUP = 1 << 28


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(found) if name == "documents" else found


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, so that work on its texts is not one task's; larger ones are split by their files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < ONE_GROUP
    return df.repartition(cores) if small and cores > 1 else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``; it goes when the session's JVM ends.

    Only a session of one process without that setting takes a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pagequarry-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    folder = f"{shared}/pagequarry/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, page, line, text``."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return each.select("doc_id", F.floor(F.col("line") / LINES_A_PAGE).cast("long").alias("page"), F.col("line").cast("long").alias("line"), "text")


def rows(lines_: DataFrame) -> DataFrame:
    """Lines cut into rows of a page's width: ``row, text``."""
    cut = F.expr(f"transform(sequence(0, greatest(cast(ceil(char_length(text) / {ROW}.0) as int) - 1, 0)), k -> substring(text, k * {ROW} + 1, {ROW}))")
    return lines_.select("doc_id", "page", "line", F.posexplode(cut).alias("row", "text"))


def glyphs(lines_: DataFrame) -> DataFrame:
    """``doc_id, page, line, idx, ch, l, t, r, b``: a row a code point; blanks have no box."""
    each = rows(lines_).where("text <> ''").select("doc_id", "page", "line", "row", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("col"))
    boxed = each.withColumn("ch", F.expr("substring(text, col + 1, 1)"))
    seen = F.col("ch") != " "
    return boxed.select(
        "doc_id", "page", "line", (F.col("row") * ROW + F.col("col")).cast("long").alias("idx"), "ch",
        F.when(seen, F.col("col") * WIDE).alias("l"), F.when(seen, F.col("row") * PITCH).alias("t"),
        F.when(seen, (F.col("col") + 1) * WIDE).alias("r"), F.when(seen, F.col("row") * PITCH + HIGH).alias("b"),
    )


GLYPHS_SQL = LINES_SQL + (
    f", chars AS (SELECT doc_id, page, line, CAST(i AS BIGINT) AS idx, s[i + 1] AS ch FROM (SELECT doc_id, page, line, string_split(text, '') AS s FROM lines WHERE text <> '') d, LATERAL (SELECT unnest(range(len(s))) AS i) u)"
    f", glyphs AS (SELECT doc_id, page, line, idx, ch, CASE WHEN ch <> ' ' THEN idx % {ROW} * {WIDE} END AS l, CASE WHEN ch <> ' ' THEN idx // {ROW} * {PITCH} END AS t, CASE WHEN ch <> ' ' THEN (idx % {ROW} + 1) * {WIDE} END AS r, CASE WHEN ch <> ' ' THEN idx // {ROW} * {PITCH} + {HIGH} END AS b FROM chars)"
)
