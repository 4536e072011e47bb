"""Near-duplicate classes against all pairs."""

import re

import numpy as np
import pytest

from pagequarry.llm import minhash as op
from pagequarry.llm.jaccard import Measure
from pagequarry.llm.queries import op12_minhash_dedup

FOLDER = "/root/testdata/sf0.01"


def shingles(text, words):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def by_pairs(docs, words=4, num=80, den=100):
    """Set sizes and least ids of components, by all pairs that share a shingle."""
    sets = {d: shingles(t, words) for d, t in docs.items()}
    holders, root = {}, {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        met = {}
        for g in sets[d]:
            for other in holders.setdefault(g, []):
                met[other] = met.get(other, 0) + 1
            holders[g].append(d)
        for other, k in met.items():
            if den * k >= num * (len(sets[d]) + len(sets[other]) - k):
                a, b = sorted((top(d), top(other)))
                root[b] = a
    return {d: (len(sets[d]), top(d), top(d) == d) for d in docs}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = by_pairs(docs)
    assert result(op12_minhash_dedup(spark, FOLDER)) == want
    assert any(not kept for _, _, kept in want.values())


@pytest.mark.parametrize("long_list", [4, 1024])
def test_edited_copies(spark, monkeypatch, long_list):
    """Groups of copies with more and more edits, right around the measure, and a passage that all texts share."""
    monkeypatch.setattr(op, "LIST", long_list)
    rng = np.random.default_rng(12)
    passage, docs = [f"p{i}" for i in range(60)], {}
    for group in range(12):
        size = int(rng.choice([8, 40, 70, 300]))
        base = [f"w{rng.integers(0, 4000)}" for _ in range(size)]
        for _ in range(25):
            text, edits = list(base), int(rng.integers(0, max(2, size // 14)))
            for at in rng.integers(0, size, edits).tolist():
                text[at] = f"x{rng.integers(0, 4000)}"
            docs[len(docs)] = " ".join(text + (passage if group % 3 == 0 else []))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    assert result(op.near_duplicates(df, Measure(words=4, num=80, den=100))) == by_pairs(docs)


def test_union_of_sketches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.choice(10_000, 300, replace=False).astype(np.uint64)
        a, b = (np.sort(rng.choice(pool, int(rng.integers(1, 200)), replace=False)) for _ in range(2))
        k = int(rng.integers(1, 100))
        least = sorted(set(a.tolist()) | set(b.tolist()))[:k]
        assert op.shared_of_union(a[:k], b[:k], k) == (len(set(least) & set(a.tolist()) & set(b.tolist())), len(least))


@pytest.mark.parametrize("union", [256, 300, 500, 2_000, 100_000])
def test_few_links_are_lost(union):
    """How likely a pair right at the measure shares too few of ``K`` values drawn from its union: under one in ten million."""
    from math import comb

    c, shared = op.least_shared(Measure(words=4, num=80, den=100), op.K, union), -(-8 * union // 10)
    lost = sum(comb(shared, i) * comb(union - shared, op.K - i) for i in range(c) if op.K - i <= union - shared)
    assert lost * 10**7 < comb(union, op.K)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (5, "c d e f g"), (None, "a b"), (7, long), (8, long + " more"), (6, "c d e f g"), (6, "c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as component_id", "2 as id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op.near_duplicates(docs, Measure(words=4)).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 2, 5, True), (None, 1, None, None), (7, 49_997, 7, True), (8, 49_998, 7, False), (6, 2, 5, False), (6, 2, 5, False)]
    assert got == sorted(want, key=repr)
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_far_pairs_of_a_group_have_no_rows(spark, monkeypatch):
    """Of a group of texts that share half of their shingles, few pairs come to an estimate; the links right at the measure stay."""
    rng = np.random.default_rng(5)
    base, docs = [f"w{i}" for i in range(600)], {}
    for i in range(40):
        text = list(base)
        for at in rng.choice(600, 32, replace=False).tolist():
            text[at] = f"x{i}-{at}"
        docs[i] = " ".join(text)
        for at in rng.choice(600, 16, replace=False).tolist():
            text[at] = f"y{i}-{at}"
        docs[100 + i] = " ".join(text)
    seen, estimated = [], op._estimated
    monkeypatch.setattr(op, "_estimated", lambda pairs, *rest: (seen.append(pairs.count()), estimated(pairs, *rest))[1])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    want = by_pairs(docs)
    assert result(op.near_duplicates(df, Measure(words=4, num=80, den=100))) == want
    assert any(c != i for i, (_, c, _) in want.items()) and seen[1] < 400, seen
