"""What files hold and what is written to them, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.names import pdf_date
from pagequarry.plans.composition import _STRUCTURE_SQL, structured
from pagequarry.plans.registry import query
from pagequarry.sources.documents import VERSION, WORDS, cached_words, lenient_json
from pagequarry.sources.sinks import paragraph_xml
from pagequarry.sources.views import table

#: Fixed value: bytes of pictures that a page gives.
PICTURE_BYTES = 48 << 20


@query("SELECT event_id, try_cast(json_extract_string(j, '$.k') AS BIGINT) AS k, j IS NOT NULL AS sound FROM (SELECT event_id, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN substring(props, 1, length(props) - 1) WHEN 1 THEN 'none' ELSE props END AS p FROM events))")
def lenient_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records read by a schema: cut-off and foreign text is null, and nothing fails."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.expr("substring(props, 1, char_length(props) - 1)")).when(i % 5 == 1, "none").otherwise(F.col("props"))
    read = table(spark, sf_dir, "events").select(i, lenient_json(text, "k long, _corrupt_record string").alias("j"))
    return read.select(i, F.col("j.k").alias("k"), (F.col("j").isNotNull() & F.col("j._corrupt_record").isNull()).alias("sound"))


@query(f"WITH c AS (SELECT vec_id // 8 AS doc, vec_id % 8 AS page, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE {VERSION} END AS version, list_transform(embedding[1:CASE WHEN vec_id % 3 = 0 THEN 3 ELSE 4 END], lambda x: round_even(x::DOUBLE, 5)) AS b FROM embeddings) SELECT doc, page, len(b) = 4 AS kept, round(CASE WHEN len(b) = 4 THEN list_sum(b) ELSE 0 END, 5) AS total FROM c WHERE version = {VERSION}")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised pages as a cache keeps and gives them: five places, this version, boxes of four sides."""
    v = F.col("vec_id")
    box = F.transform(F.slice("embedding", F.lit(1), F.when(v % 3 == 0, 3).otherwise(4)), lambda x: x.cast("double"))
    words = F.array(F.struct(F.lit("w").alias("t"), box.alias("b"))).cast(WORDS)
    c = table(spark, sf_dir, "embeddings").select(F.floor(v / 8).alias("doc"), (v % 8).alias("page"), F.when(v % 5 == 0, 2).otherwise(VERSION).alias("version"), cached_words(words)[0]["b"].alias("b"))
    total = F.when(F.size("b") == 4, F.aggregate("b", F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    return c.where(F.col("version") == VERSION).select("doc", "page", (F.size("b") == 4).alias("kept"), F.round(total, 5).alias("total"))


@query(f"WITH p AS (SELECT event_id, user_id AS page, event_id * 7919 % 9000000 AS bytes FROM events), r AS (SELECT *, sum(bytes) OVER (PARTITION BY page ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS so_far, row_number() OVER (PARTITION BY page ORDER BY event_id) AS nth FROM p) SELECT page, event_id, bytes FROM r WHERE so_far <= {PICTURE_BYTES} AND nth <= 64")
def pictures_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a page within its budget of bytes, 64 at most (the feature's limits)."""
    over = Window.partitionBy("page").orderBy("event_id")
    p = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("page"), (F.col("event_id") * 7919 % 9_000_000).alias("bytes"))
    r = p.withColumn("so_far", F.sum("bytes").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(over))
    return r.where((F.col("so_far") <= PICTURE_BYTES) & (F.col("nth") <= 64)).select("page", "event_id", "bytes")


@query("SELECT doc_id, lang || '/' || source AS title, length(text) // 4000 + 1 AS pages, make_timestamp(2000 + doc_id % 25, 1 + doc_id % 12, 1 + doc_id % 28, doc_id % 24, doc_id % 60, 0) - INTERVAL 1 MINUTE * (CASE doc_id % 3 WHEN 0 THEN 90 WHEN 1 THEN -60 ELSE 0 END) AS created FROM documents")
def document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's metadata in one row: title, pages, and when it was made, from its date with an offset."""
    i = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    zone = F.when(i % 3 == 0, "+01'30'").when(i % 3 == 1, "-01'00'").otherwise("Z")
    stamp = F.concat(F.lit("D:"), (2000 + i % 25).cast("string"), two(1 + i % 12), two(1 + i % 28), two(i % 24), two(i % 60), F.lit("00"), zone)
    return table(spark, sf_dir, "documents").select(i, F.concat("lang", F.lit("/"), "source").alias("title"), (F.floor(F.char_length("text") / 4000) + 1).alias("pages"), pdf_date(stamp).alias("created"))


@query("WITH p AS (SELECT doc_id, length(text) < 400 AS few FROM documents), c AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id FROM p WHERE few AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id)")
def to_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that bulk recognition still has to read: little text, and none in the cache (toxic labels stand for it)."""
    p = table(spark, sf_dir, "documents").where(F.char_length("text") < 400).select("doc_id")
    return p.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH RECURSIVE {_STRUCTURE_SQL}, x AS (SELECT doc_id, page, para, '<w:p>' || CASE WHEN heading > 0 THEN '<w:pPr><w:pStyle w:val="Heading' || heading || '"/></w:pPr>' WHEN listed THEN '<w:pPr><w:ind w:left="' || (CAST(least(greatest(round_even(l / 31.5, 0), 0), 4) AS INT) + 1) * 360 || '"/></w:pPr>' ELSE '' END || '<w:r><w:t xml:space="preserve">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</w:t></w:r></w:p>' AS xml FROM st)
 SELECT doc_id, count(*) AS paragraphs, md5(string_agg(xml, '' ORDER BY page, para)) AS digest FROM x GROUP BY doc_id""")
def package_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of word-processor files out of composed documents, as a count and a digest."""
    return bodies(table(spark, sf_dir, "documents")).select("doc_id", "paragraphs", F.md5(F.col("body").cast("binary")).alias("digest"))


def bodies(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraphs, body``: all pages composed, as the content of a file."""
    xml = paragraph_xml(F.col("text"), F.col("heading"), F.col("listed"), F.col("level"))
    each = structured(docs).select("doc_id", "page", "para", xml.alias("xml"))
    parts = F.array_sort(F.collect_list(F.struct("page", "para", "xml")))
    return each.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.array_join(F.transform(parts, lambda x: x["xml"]), "").alias("body"))


@query("SELECT doc_id, hex_out AS head FROM (SELECT doc_id, string_agg(lower(lpad(to_hex(xor(ascii(substring(a, i + 1, 1)), ('0x' || substring(k, 31 - 2 * (i % 16), 2))::INT)), 2, '0')), '' ORDER BY i) AS hex_out FROM (SELECT doc_id, md5(text) AS a, md5(doc_id::VARCHAR) AS k FROM documents), range(32) r(i) GROUP BY doc_id)")
def font_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes of embedded fonts under their key: xor with the key's bytes from the end."""
    a, k = F.md5(F.col("text").cast("binary")), F.md5(F.col("doc_id").cast("string").cast("binary"))
    one = table(spark, sf_dir, "documents").select("doc_id", a.alias("a"), k.alias("k"))
    byte = lambda i: F.ascii(F.substring(F.col("a"), i + 1, F.lit(1))).bitwiseXOR(F.conv(F.substring(F.col("k"), 31 - 2 * (i % 16), F.lit(2)), 16, 10).cast("int"))
    return one.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lower(F.lpad(F.hex(byte(i)), 2, "0"))), "").alias("head"))
