"""What operators move between tasks."""

import re

from pagequarry.llm import substring_dedup


def test_repeated_units_move_once(spark):
    """Units that repeat go through one shuffle for their first occurrence and for the others, and reach their texts by another."""
    passage = " ".join(f"w{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(8)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = substring_dedup.dedup(docs)
        rows = {r.doc_id: r for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[0].text == f"own0 {passage} end0" and all(rows[i].removed_spans[0].kept_doc_id == 0 and "w30" not in rows[i].text for i in range(1, 8))
    moved = set(re.findall(r" Exchange (hashpartitioning\(.*?plan_id=\d+)", plan))
    assert len([x for x in moved if "h1#" in x]) == 1 and len(moved) == 3, moved  # texts, removed units, units that repeat
