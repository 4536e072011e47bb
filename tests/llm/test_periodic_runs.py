"""Periodic runs against a search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from pagequarry.llm import periodic_runs as op
from pagequarry.llm.queries import op11_periodic_runs

FOLDER = "/root/testdata/sf0.01"


def by_search(words, least=12):
    """All runs, by every period: stretches of equal words that far apart, unless a lesser period will do."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                piece = words[i : i + length]
                if not any(piece[r:] == piece[:-r] for r in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("rounds", [1, 3, 32])
@pytest.mark.parametrize("letters", [1, 2, 4])
def test_runs_equal_a_search(monkeypatch, rounds, letters):
    monkeypatch.setattr(op, "ROUNDS", rounds)
    rng = np.random.default_rng(letters)
    for _ in range(40):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 80))
            w = rng.integers(0, letters, n)
            if n and rng.random() < 0.5:
                a = int(rng.integers(0, n))
                p = 1 + (n - a) // int(rng.integers(2, 6))
                w = np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(n)])
            texts.append(w.tolist())
        least = int(rng.choice([2, 5, 12]))
        words = np.array([x for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found, many = op.runs(words, np.array([len(t) for t in texts]), least)
        ends = np.cumsum(many).tolist()
        assert [[tuple(r) for r in found[e - m : e].tolist()] for e, m in zip(ends, many.tolist(), strict=True)] == [by_search(t, least) for t in texts]


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_search(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_a_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    short = {d for d, t in docs.items() if len((t or "").split()) <= 600}  # the search is quadratic
    rows = op11_periodic_runs(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert any(r.n_runs for r in rows) and any(zlib.crc32(str(d).encode()) % 10 == 0 for d in short)
    for r in rows:
        if r.doc_id in short:
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected(r.doc_id, docs[r.doc_id])


def test_odd_rows(spark):
    long = " ".join(["w%d" % (i % 700) for i in range(30_000)])
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n ", 5), (None, "a " * 12, 5), (4, "a " * 12, 5), (4, "a " * 12, 5), (5, "é " * 11, 5), (6, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Runs` int")
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in op.periodic_runs(docs).collect()]
    assert sorted(found, key=repr) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 12, [(0, 12, 1)], "a"), (4, 12, [(0, 12, 1)], "a"), (4, 12, [(0, 12, 1)], "a"), (5, 11, [], " ".join("é" * 11)), (6, 30_000, [(0, 30_000, 700)], " ".join("w%d" % i for i in range(700)))], key=repr)
    assert op.digests(docs.limit(0)).count() == 0
    assert {r.n_runs for r in op.digests(op.with_planted_runs(docs)).where("doc_id = 1").collect()} == {0}


def test_rows_are_not_shuffled(spark):
    plan = op11_periodic_runs(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
