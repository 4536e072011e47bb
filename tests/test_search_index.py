"""Searches through an index against searches through all texts."""

import pytest

from pagequarry.plans.search import hits, page_texts
from pagequarry.sources.search_index import build, folded_words
from pagequarry.sources.views import table

FOLDER = "/root/testdata/sf0.001"
ODD = ["", "of\nthe", "OF ­ the hoof theme", "Ére ère ère ere­", "nothing things, thing-thing", "of the of the of", "the of", "İstanbul istanbul", "a\tb  a b"]


@pytest.fixture(scope="module")
def pages(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return docs.unionByName(odd).cache()


@pytest.fixture(scope="module")
def index(pages, tmp_path_factory):
    return build(page_texts(pages), str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("how", [{}, {"match_case": True}, {"whole_word": True}])
@pytest.mark.parametrize("query", ["thing", "of the", "OF  the of", "ère", "b a", "istanbul", "zzzz", "the"])
def test_same_hits(pages, index, query, how):
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (index.hits(query, **how), hits(pages, query, **how)))
    assert got == want
    assert want or how or query == "zzzz"


def test_pages_are_few(pages, index):
    """Pages that the index leads to are those that hold the words next to each other."""
    found = {(r.doc_id, r.page) for r in index.pages("of the").collect()}
    want = {(r.doc_id, r.page) for r in hits(pages, "of the").collect()}
    assert want <= found and found - want == set()
    assert index.pages("zzzz").count() == 0


def test_only_shelves_of_hits_are_read(index):
    plan = index.hits("hoof theme")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 2 and "partitionFilters" in plan.replace("PartitionFilters", "partitionFilters")


def test_vocabulary(index):
    uses = {r.word: (r.pages, r.uses) for r in index.counts("thing").collect()}
    assert {"nothing", "things,", "thing-thing"} <= set(uses) and uses["thing-thing"] == (1, 1)
    assert folded_words(" ÉRE­  of ") == ["ere", "of"]
    with pytest.raises(ValueError, match="needs a word"):
        index.hits(" ­ ")


def test_only_words_are_shuffled(spark, tmp_path, monkeypatch):
    """Texts reach their shelves and places their words without a shuffle; postings go through one."""
    from pyspark.sql import DataFrameWriter

    plans, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: (plans.append(w._df._jdf.queryExecution().executedPlan().toString()), parquet(w, path, *a, **k))[1])
    docs = spark.createDataFrame([(1, "a b a\nc a"), (2, "b"), (None, "c c"), (3, ""), (4, None), (5, "b")], "doc_id long, text string")
    made = build(page_texts(docs), str(tmp_path / "index"))
    assert [p.count("Exchange") for p in plans[:2]] == [0, 1]
    got = sorted(((r.word, r.doc_id, r.page, r.places) for r in made._table("postings").collect()), key=repr)
    assert got == sorted([("a", 1, 0, [0, 2, 4]), ("b", 1, 0, [1]), ("c", 1, 0, [3]), ("b", 2, 0, [0]), ("c", None, 0, [0, 1]), ("b", 5, 0, [0])], key=repr)
