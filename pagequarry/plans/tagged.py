"""What a document's tags say of its paragraphs, against what their looks say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators import paragraphs as p
from pagequarry.operators.trees import nearest_ancestor
from pagequarry.plans.composition import _STRUCTURE_SQL, composed, structured
from pagequarry.plans.registry import query
from pagequarry.plans.structure import _MARKS, _NODES, owned
from pagequarry.sources.views import table

#: Sorts of elements by an event's number; spans mean nothing by themselves, what is around them decides.
SORTS = ["H1", "H2", "P", "Span", "Span", "LI", "Caption", "Span"]
_SORT_SQL = "[" + ", ".join(f"'{s}'" for s in SORTS) + "][event_id % 8 + 1]"

_TAGS_SQL = f"""tm AS ({_MARKS}), tn AS ({_NODES}), own AS (SELECT tm.doc_id, i AS idx, max(node) AS owner FROM tm JOIN tn USING (doc_id, mcid), LATERAL (SELECT unnest(range(start, stop)) AS i) GROUP BY ALL),
 tree AS (SELECT event_id AS node, CASE WHEN event_id % 3 <> 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent, {_SORT_SQL} AS sort FROM events WHERE event_type = 'error'),
 up AS (SELECT node AS start, parent, sort FROM tree UNION ALL SELECT up.start, t.parent, t.sort FROM up JOIN tree t ON up.parent = t.node WHERE up.sort = 'Span'),
 role AS (SELECT start AS node, sort FROM up WHERE sort <> 'Span'),
 votes AS (SELECT q.doc_id, q.page, q.para, owner, sum(length(regexp_replace(q.text, '\\s', '', 'g'))) AS n, min(q.line) AS first FROM para q JOIN own ON own.doc_id = q.doc_id AND own.idx = q.line GROUP BY ALL),
 best AS (SELECT doc_id, page, para, owner FROM votes WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page, para ORDER BY n DESC, first) = 1)"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, sort``: the nearest element from a node upward that means something."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    sort = F.get(F.array(*map(F.lit, SORTS)), (F.col("event_id") % 8).cast("int"))
    above = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    nodes = e.select(F.col("event_id").alias("node"), F.when(F.col("event_id") % 3 != 0, above).alias("parent"), sort.alias("sort")).withColumn("meaningful", F.col("sort") != "Span")
    around = nearest_ancestor(nodes, 24).join(nodes.select(F.col("node").alias("ancestor"), F.col("sort").alias("outer")), "ancestor", "left")
    return nodes.join(around, "node").select("node", F.when(F.col("meaningful"), F.col("sort")).otherwise(F.col("outer")).alias("sort")).where("sort is not null")


@query(f"""WITH RECURSIVE {_STRUCTURE_SQL}, {_TAGS_SQL}
 SELECT st.doc_id, st.page, CAST(st.para AS BIGINT) AS para, sort AS tag, CASE WHEN sort IS NULL THEN heading WHEN sort IN ('H1', 'H2') THEN CAST(sort[2] AS INT) ELSE 0 END AS heading,
  CASE WHEN sort IS NULL THEN listed ELSE sort = 'LI' END AS listed, CASE WHEN sort IS NULL THEN kd WHEN sort <> 'LI' THEN 'text' WHEN regexp_matches(head, '{p.NUMBER}') THEN 'number' ELSE 'bullet' END AS kind
 FROM st LEFT JOIN best ON best.doc_id = st.doc_id AND best.page = st.page AND best.para = st.para LEFT JOIN role ON role.node = best.owner""")
def tagged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and lists where tags overrule what was found: the owner of most of a paragraph's letters decides, the first seen of equal ones.

    Lines are owned here as a document's first characters are elsewhere; a line counts as much as it has letters.
    """
    docs = table(spark, sf_dir, "documents")
    lines = composed(docs).select("doc_id", "page", "para", F.explode("lines").alias("x")).select("doc_id", "page", "para", F.col("x.line").alias("idx"), F.char_length(F.regexp_replace("x.text", r"\s", "")).alias("n"))
    votes = lines.join(owned(spark, sf_dir), ["doc_id", "idx"]).groupBy("doc_id", "page", "para", "owner").agg(F.sum("n").alias("n"), F.min("idx").alias("first")).where("n > 0")
    best = votes.groupBy("doc_id", "page", "para").agg(F.max_by("owner", F.struct("n", -F.col("first"))).alias("node"))
    tags = best.join(roles(spark, sf_dir), "node").select("doc_id", "page", "para", F.col("sort").alias("tag"))
    s = structured(docs).join(tags, ["doc_id", "page", "para"], "left")
    none, tag = F.col("tag").isNull(), F.col("tag")
    return s.select(
        "doc_id", "page", "para", "tag", F.when(none, F.col("heading")).when(tag.startswith("H"), F.substring(tag, 2, 1).cast("int")).otherwise(0).alias("heading"),
        F.when(none, F.col("listed")).otherwise(tag == "LI").alias("listed"), F.when(none, F.col("kind")).when(tag != "LI", "text").when(F.col("head").rlike(p.NUMBER), "number").otherwise("bullet").alias("kind"),
    )
