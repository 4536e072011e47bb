"""Every stage of the pipeline on its predecessor's result, against what its operator promises."""

import pandas as pd

import corpus_pipeline
from pagequarry.llm import jaccard
from pagequarry.llm.common import table, written

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    names, kept = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == names
        kept.append(docs.toPandas())
    quality, language, near, repeats = kept[1:]
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet")
    good, bad = (set(labels[labels.quality == q].doc_id) for q in (1, 0))
    assert len(good & set(quality.doc_id)) > 0.9 * len(good) and len(bad & set(quality.doc_id)) < 0.5 * len(bad)
    assert len(language) > 0.95 * len(quality)
    groups = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(language), jaccard.Measure(5, 80, 100)).collect()}
    assert sorted(near.doc_id) == sorted(set(groups.values()))
    assert sorted(repeats.doc_id) == sorted(near.doc_id) and (repeats.n_chars == repeats.text.str.len()).all()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).toPandas()
    assert set(packed.doc_id) == set(repeats.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, FOLDER, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, long and repeated rows, ties, no label and no language known, columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the bears in the dark old wood near here. "
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "one"), (5, "one"), (6, "Two words"), (7, long), (8, base * 4), (9, base * 4 + "end"), (None, base), (None, None), (10, "naïve Ünï ﬁ 漢字 😀 ́x"), (11, "!!! ???"), (12, base)]
    clash = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string, quality_score double, lang_pred string, removed_spans string, piece int, th long"
    spark.createDataFrame([(i, t, None, None, None, 1, "k", 0.5, "x", "y", 1, 2) for i, t in texts], clash).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.columns == clash.replace(",", "").split()[::2]
        if name == "language":
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(map(str, [4, 5, 5, 6, 7, 8, 9, None, 10, 12]))
        if name == "near_copies":
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(map(str, [4, 6, 7, 8, None, 10]))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[None] == base and kept[4] == "one" and kept[8].startswith(base[:100]) and len(kept[8]) < 3 * len(base) and len(kept[7]) < 2 * len(" ".join(f"word{i}" for i in range(997)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id.dropna()) == {4, 6, 7, 8, 10} and packed.doc_id.isna().sum() == 1
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
