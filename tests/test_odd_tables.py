"""Every query that reads documents, on odd ones and on none."""

import os

import pytest

from pagequarry.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n", "\n\n\n", "   \n \t \n", "one", "one row\nand another of quite another width than the first one", "x" * 5_000, ("word " * 2_000).strip(), "a\r\nb\r\n", "\tindented\n• item\n• item\n1. first\n2. second\n- maybe",
    "\n".join(["same line"] * 90), "é ü 日本語 \U0001f600 thing", "- \n* \n1.\n(a)\n", "A HEADING\n\nbody text that goes on.\n" * 30, "a­b thing­ s", "\n".join(" " * i + "x" for i in range(60)),
]
READS = sorted(n for n, q in SQL.items() if "documents" in q) + ["ink_blobs", "page_ink", "recognised_lines", "page_figures"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = {}
    for kind in ("odd", "empty"):
        at[kind] = tmp_path_factory.mktemp(kind)
        for name in os.listdir(FOLDER):
            if name != "documents.parquet":
                (at[kind] / name).symlink_to(f"{FOLDER}/{name}")
        whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
        rows = [(i, t, "en", "here", None if t is None else len(t)) for i, t in enumerate(TEXTS)] if kind == "odd" else []
        spark.createDataFrame(rows, whole.schema).coalesce(1).write.parquet(str(at[kind] / "documents.parquet"))
    return at


@pytest.mark.parametrize("name", READS)
def test_runs_on_odd_pages(spark, folders, name):
    QUERIES[name](spark, str(folders["odd"])).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["search_hits", "search_indexed", "page_lines", "paragraphs", "package_bodies", "page_file_text", "page_figures", "tagged_paragraphs", "list_numbering", "running_heads"])
def test_no_documents_give_no_rows(spark, folders, name):
    assert QUERIES[name](spark, str(folders["empty"])).count() == 0
