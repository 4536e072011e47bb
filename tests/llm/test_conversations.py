"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from pagequarry.llm import conversations as op
from pagequarry.llm.queries import op13_conversation_repair

FOLDER = "/root/testdata/sf0.01"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def by_search(roles, faults):
    """The cheapest edits and, of those, the least: best first over places, grammar's last initial and what is left."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, left = heapq.heappop(heap)
        if i == len(roles) and state in ("", "a"):
            return cost, audit, left
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for to in "ua":
            if (state, to) in GRAMMAR:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*left, (to, None))))
                if i < len(roles) and faults[i] not in ("blank", "duplicate"):
                    heapq.heappush(heap, (cost + 3 + 3 * (faults[i] == "truncated"), audit + "R", i + 1, to, (*left, (to, i))))
        if i < len(roles):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, left))
            if faults[i] not in ("blank", "duplicate") and (state, roles[i][:1]) in GRAMMAR:
                heapq.heappush(heap, (cost + 3 * (faults[i] == "truncated"), audit + "K", i + 1, roles[i][:1], (*left, (None, i))))


def expected(rows):
    """What the contract says of one conversation's rows ``turn, role, text`` after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    roles = [r for _, r, _ in rows]
    cost, audit, left = by_search(roles, faults)
    names = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{names[to] if to else roles[i]}:{'' if i is None else rows[i][2]}" for to, i in left)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        code = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    return out


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((turn, role, text))
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = by_conversation(damage(rows))
    want = {c: expected(damaged.get(c, [])) for c in {r[0] for r in rows}}
    got = result(op13_conversation_repair(spark, FOLDER))
    assert got == want
    assert len({a for *_, a, _ in want.values()}) > 10


def test_walk_and_transfer_equal_a_search():
    rng = np.random.default_rng(5)
    for _ in range(600):
        letters = "".join(rng.choice(list("suaxSUAX-"), int(rng.integers(0, 12))))
        names = [{"x": "tool", "-": "user"}.get(c.lower(), c.lower()) for c in letters]
        cost, audit, _ = by_search(names, ["blank" if c == "-" else "truncated" if c.isupper() else None for c in letters])
        assert op.walk(letters, op.START, op.FINISHED, True)[::2] == (audit, cost)
        cut = int(rng.integers(0, len(letters) + 1))
        first, second = op.transfer(letters[:cut]), op.transfer(letters[cut:])
        end = tuple(min(second[4 * s + t] + op.FINISHED[t] for t in range(4)) for s in range(4))
        if cut and cut < len(letters):
            one = op.walk(letters[:cut], op.START, end, False)
            two = op.walk(letters[cut:], one[1], op.FINISHED, True)
            assert (one[0] + two[0], one[2] + two[2]) == (audit, cost)
            assert cost == min(first[t] + end[t] for t in range(4))


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_conversations_in_many_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(op, "PIECE", piece)
    rng = np.random.default_rng(piece)
    rows = []
    for conv in range(12):
        for turn in range(int(rng.integers(1, 200 if conv == 3 else 9))):
            if rng.random() < 0.9:
                rows.append((conv, turn if conv != 3 else turn // 3 * 3 + turn % 3, str(rng.choice(["system", "user", "assistant", "tool"])), str(rng.choice(["a.", "b", " ", "c!", f"t{turn}?", f"q{turn}"]))))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {c: expected(r) for c, r in by_conversation(rows).items()}
    assert result(op.repair(docs)) == want
    left = op.repaired_turns(docs).orderBy("conv_id", "part", "piece", "place").collect()
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left if r.conv_id == conv).encode()).hexdigest() == row[-1]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "hi."), (2, 5, "", "x"), (None, 1, "user", "a."), (None, 2, "assistant", "b." * 100_000), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 9, "assistant", "end")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as Audit")
    got = result(op.repair(docs, spark.createDataFrame([(1,), (7,), (None,), (2,), (3,)], "conv_id long")))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[7] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[None] == expected([r[1:] for r in rows if r[0] is None])
    assert got[3] == expected([r[1:] for r in rows if r[0] == 3]) and got[3][:6] == (7, 0, 1, 1, 1, 7)
    assert got[1][:6] == (0, 1, 0, 0, 1, 7) and got[1][6] in ("DKI", "KDI")
    assert got[2][:4] == (0, 0, 0, 1)
    assert op.repair(docs.limit(0)).count() == 0 and op.repair(docs.limit(0), docs).count() == 4
    assert op.damaged(docs).count() <= 2 * len(rows)
