"""Searches through an index (G1, T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.plans.registry import query
from pagequarry.plans.search import hits_sql, page_texts
from pagequarry.sources.search_index import build
from pagequarry.sources.views import scratch, table


@query(f"WITH {hits_sql('of the')} SELECT * FROM hits")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase by the places of its words; only texts of pages that have it are read for contexts."""
    return build(page_texts(table(spark, sf_dir, "documents")), scratch(spark, "search")).hits("of  the ")
