"""Lists and tables as packages hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import names as n
from pagequarry.operators import paragraphs as p
from pagequarry.operators.shapes import islands
from pagequarry.plans.composition import _STRUCTURE_SQL, structured
from pagequarry.plans.names import _ROMAN_SQL
from pagequarry.plans.registry import SQL, query
from pagequarry.plans.structure import tagged_slots
from pagequarry.sources.packages import FIRST_OWN
from pagequarry.sources.views import table


def numbered(s: DataFrame) -> DataFrame:
    """``doc_id, page, para, level, number, num_id``: every numbered paragraph of ``structured`` ones and the list that it is in.

    A list goes on while paragraphs follow one another, over pages too, with one level, format and label and numbers
    that go up by one; anything else begins a new one.
    """
    over = Window.partitionBy("doc_id").orderBy("page", "para")
    marked = F.col("listed") & (F.col("kind") == "number")
    label = n.number_label(F.rtrim(F.regexp_extract("text", p.NUMBER, 0)))
    each = s.select("doc_id", "page", "para", "level", F.when(marked, label).alias("number"))
    before = F.lag(F.struct("level", "number")).over(over)
    same = (before["level"] == F.col("level")) & (before["number"]["format"] == F.col("number.format")) & (before["number"]["label"] == F.col("number.label")) & (before["number"]["start"] + 1 == F.col("number.start"))
    fresh = F.col("number").isNotNull() & ~F.coalesce(F.col("same"), F.lit(False))
    found = islands(each.withColumn("same", same), ["doc_id"], ["page", "para"], fresh, "nth")
    return found.where("number is not null").select("doc_id", "page", "para", "level", "number", (F.col("nth") + FIRST_OWN - 1).cast("long").alias("num_id"))


@query(f"""WITH RECURSIVE {_STRUCTURE_SQL},
 mk AS (SELECT doc_id, page, para, CAST(least(greatest(round_even(l / 31.5, 0), 0), 4) AS INT) AS level, CASE WHEN listed AND kd = 'number' THEN rtrim(regexp_extract(head, '{p.NUMBER}')) END AS marker FROM st),
 d AS (SELECT DISTINCT marker, trim(marker, '().') AS token FROM mk WHERE marker IS NOT NULL),
 f AS (SELECT *, CASE WHEN regexp_matches(token, '^0.') THEN 'none' WHEN regexp_matches(token, '^\\d+$') THEN 'decimal' WHEN regexp_matches(token, '^([ivxlcdmIVXLCDM]{{2,}}|[iI])$') THEN CASE WHEN token[1] = upper(token[1]) THEN 'upperRoman' ELSE 'lowerRoman' END WHEN regexp_matches(token, '^[a-zA-Z]$') THEN CASE WHEN token = upper(token) THEN 'upperLetter' ELSE 'lowerLetter' END ELSE 'none' END AS format FROM d),
 rm AS (SELECT marker, token, {_ROMAN_SQL} AS roman FROM f WHERE format LIKE '%Roman'),
 lb AS (SELECT f.marker, f.format, CAST(CASE WHEN f.format = 'decimal' THEN TRY_CAST(f.token AS INTEGER) WHEN f.format LIKE '%Roman' THEN greatest(rm.roman, 0) WHEN f.format LIKE '%Letter' THEN ascii(upper(f.token)) - 64 ELSE 1 END AS INTEGER) AS start, CASE WHEN f.format = 'none' THEN f.marker ELSE replace(f.marker, f.token, '%1') END AS label FROM f LEFT JOIN rm ON rm.marker = f.marker),
 q AS (SELECT mk.doc_id, mk.page, mk.para, mk.level, mk.marker, format, start, label, lag(mk.level) OVER w AS pl, lag(format) OVER w AS pf, lag(start) OVER w AS ps, lag(label) OVER w AS pb FROM mk LEFT JOIN lb ON lb.marker = mk.marker WINDOW w AS (PARTITION BY mk.doc_id ORDER BY mk.page, mk.para)),
 nn AS (SELECT *, sum(CASE WHEN marker IS NOT NULL AND NOT coalesce(pl = level AND pf = format AND pb = label AND ps + 1 = start, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, para) AS nth FROM q)
 SELECT doc_id, page, CAST(para AS BIGINT) AS para, level, format, start, label, CAST(nth + {FIRST_OWN - 1} AS BIGINT) AS num_id FROM nn WHERE marker IS NOT NULL""")
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs with their label and the list that they go on or begin."""
    return numbered(structured(table(spark, sf_dir, "documents"))).select("doc_id", "page", "para", "level", "number.format", "number.start", "number.label", "num_id")


_CELL_SQL = "'<w:tc><w:tcPr>' || CASE WHEN span > 1 THEN '<w:gridSpan w:val=\"' || span || '\"/>' ELSE '' END || CASE merge WHEN 1 THEN '<w:vMerge w:val=\"restart\"/>' WHEN 2 THEN '<w:vMerge/>' ELSE '' END || '</w:tcPr><w:p>' || CASE WHEN merge < 2 THEN '<w:r><w:t xml:space=\"preserve\">' || n || '</w:t></w:r>' ELSE '' END || '</w:p></w:tc>'"


@query(f"""WITH slots AS ({SQL["tagged_slots"]}), h AS (SELECT tbl, max(row) AS last FROM slots GROUP BY tbl),
 e AS (SELECT s.tbl, s.n, r AS row, s.col, s.col_span, CASE WHEN least(s.row_span, last - s.row + 1) = 1 THEN 0 WHEN r = s.row THEN 1 ELSE 2 END AS merge FROM slots s JOIN h USING (tbl), LATERAL (SELECT unnest(range(s.row, least(s.row + s.row_span, last + 1))) AS r)),
 g AS (SELECT *, col - coalesce(lag(col + col_span) OVER (PARTITION BY tbl, row ORDER BY col), 0) AS gap, col_span AS span FROM e),
 c AS (SELECT tbl, row, col, span, CASE WHEN gap > 0 THEN '<w:tc><w:tcPr>' || CASE WHEN gap > 1 THEN '<w:gridSpan w:val="' || gap || '"/>' ELSE '' END || '</w:tcPr><w:p></w:p></w:tc>' ELSE '' END || {_CELL_SQL} AS xml FROM g),
 t AS (SELECT tbl, row, '<w:tr>' || string_agg(xml, '' ORDER BY col) || '</w:tr>' AS xml, max(col + span) AS columns FROM c GROUP BY tbl, row)
 SELECT tbl, CAST(max(columns) AS BIGINT) AS columns, count(*) AS rows, md5(string_agg(xml, '' ORDER BY row)) AS digest FROM t GROUP BY tbl""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged tables as rows of nested elements: cells over columns, merges over rows with what goes on below, empty cells in gaps.

    Of cells that reach into one slot, the one that begins further up comes first; the SQL leaves their order open.
    """
    slots = tagged_slots(spark, sf_dir)
    last = F.max("row").over(Window.partitionBy("tbl"))
    below = F.least(F.col("row") + F.col("row_span") - 1, F.col("last"))
    each = slots.withColumn("last", last).withColumn("below", below).select("tbl", "n", "col", F.col("col_span").alias("span"), F.col("row").alias("first"), "below", F.explode(F.sequence("row", "below")).alias("row"))
    each = each.withColumn("merge", F.when(F.col("first") == F.col("below"), 0).when(F.col("row") == F.col("first"), 1).otherwise(2))
    row = Window.partitionBy("tbl", "row").orderBy("col", "first")
    gap = F.col("col") - F.coalesce(F.lag(F.col("col") + F.col("span")).over(row), F.lit(0))
    wide = lambda k: F.when(k > 1, F.concat(F.lit('<w:gridSpan w:val="'), k.cast("string"), F.lit('"/>'))).otherwise("")
    merge = F.when(F.col("merge") == 1, '<w:vMerge w:val="restart"/>').when(F.col("merge") == 2, "<w:vMerge/>").otherwise("")
    text = F.when(F.col("merge") < 2, F.concat(F.lit('<w:r><w:t xml:space="preserve">'), F.col("n").cast("string"), F.lit("</w:t></w:r>"))).otherwise("")
    empty = F.when(F.col("gap") > 0, F.concat(F.lit("<w:tc><w:tcPr>"), wide(F.col("gap")), F.lit("</w:tcPr><w:p></w:p></w:tc>"))).otherwise("")
    cells = each.withColumn("gap", gap).withColumn("xml", F.concat(empty, F.lit("<w:tc><w:tcPr>"), wide(F.col("span")), merge, F.lit("</w:tcPr><w:p>"), text, F.lit("</w:p></w:tc>")))
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "xml"))), lambda x: x["xml"]), "")
    rows = cells.groupBy("tbl", "row").agg(F.concat(F.lit("<w:tr>"), joined("col", "first"), F.lit("</w:tr>")).alias("xml"), F.max(F.col("col") + F.col("span")).alias("columns"))
    return rows.groupBy("tbl").agg(F.max("columns").alias("columns"), F.count("*").alias("rows"), F.md5(joined("row").cast("binary")).alias("digest"))
