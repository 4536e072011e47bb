"""Repair of the structure of conversations by the cheapest edits of their turns.

Roles must read as an optional system turn and then pairs of user and assistant. A turn is kept
(0), given another role (3) or deleted (4, as blank and repeated turns must be), an empty turn is
inserted (3); a truncated turn that stays costs 3 more. Going backward over the turns, the cost of
finishing is found for each state of that grammar; going forward from the start, the edit with the
least letter (D, I, K, R) is taken among those that keep to the least cost. In every state the
grammar takes one user or assistant role, so edits and letters determine each other.

Turns are sorted over all partitions by conversation and turn, so that one conversation may lie in
many partitions, and are gathered to pieces of at most ``PIECE`` turns and about ``TEXT`` code
points. A piece as a whole takes costs of finishing after it to those before it: a four by four
matrix under minimum and sum. Only conversations of several pieces meet, with one matrix a piece,
to hand every piece the costs after it and the state before it; then each piece is walked by itself.
Repeated turns are found by digests of role and text, grouped without the texts.
What is one value a conversation, its audit, text and digest, is put together piece by piece in order.

Defined cases: a null role or text is one blank; a null conversation id is a conversation; null
turns come first; turns of one number are ordered by a hash of role and text; equal rows are repeated turns; a
conversation without rows has no faults, an empty audit and text; texts are worked on whole; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import written

#: Turns and code points of a piece.
PIECE, TEXT = 1024, 1 << 20
RETELL, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 60
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The initial that each takes, and the next state.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {"u": "user", "a": "assistant"}
#: Costs of finishing after the last turn.
FINISHED = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")



def _kept(letter: str, state: int) -> int | None:
    """The state after a turn that is kept, if the grammar takes it.

    A turn is one letter: its role's initial (s, u, a or x for others), upper case if truncated; "-" if it must go.
    """
    role = letter.lower()
    if state == START and role == "s":
        return SYSTEM
    return NEXT[state] if role == TAKES[state] else None


def _inserted(costs: tuple) -> tuple:
    """Costs of finishing from each state, where turns may be inserted first; two in a row come back to where they were."""
    c0, c1, c2, c3 = costs
    c2, c3 = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return min(c0, INSERT + c2), min(c1, INSERT + c2), c2, c3


def _before(letter: str, after: tuple) -> tuple:
    """Costs of finishing before a turn, out of those after it."""
    out = []
    for state in range(4):
        cost = DELETE + after[state]
        if letter != "-":
            more = CUT * letter.isupper()
            cost = min(cost, RETELL + more + after[NEXT[state]])
            to = _kept(letter, state)
            if to is not None:
                cost = min(cost, more + after[to])
        out.append(min(cost, FAR))
    return _inserted(tuple(out))


@lru_cache(maxsize=1 << 14)
def walk(letters: str, state: int, end: tuple, last: bool) -> tuple[str, int, int]:
    """The audit of a stretch of turns from ``state`` on, the state after it and its cost.

    ``end`` are the costs of finishing after it, where turns may be inserted first. What is inserted
    after the stretch belongs to what follows, unless it is the ``last`` one.
    """
    costs = [end]
    for letter in reversed(letters):
        costs.append(_before(letter, costs[-1]))
    costs.reverse()
    whole, audit, i = costs[0][state], [], 0
    while i < len(letters) or (last and end[state]):
        now = costs[i][state]
        if i < len(letters) and now == DELETE + costs[i + 1][state]:
            edit, i = "D", i + 1
        elif now == INSERT + costs[i][NEXT[state]]:
            edit, state = "I", NEXT[state]
        else:
            more, to = CUT * letters[i].isupper(), _kept(letters[i], state)
            if to is not None and now == more + costs[i + 1][to]:
                edit, state = "K", to
            else:
                edit, state = "R", NEXT[state]
            i += 1
        audit.append(edit)
    return "".join(audit), state, whole - end[state]


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that the edits leave, as role and text."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            out.append((NAMES[TAKES[state]], ""))
            state = NEXT[state]
            continue
        if edit == "K":
            out.append((roles[i], texts[i]))
            state = SYSTEM if state == START and roles[i][:1] == "s" else NEXT[state]
        elif edit == "R":
            out.append((NAMES[TAKES[state]], texts[i]))
            state = NEXT[state]
        i += 1
    return out


@lru_cache(maxsize=1 << 14)
def transfer(letters: str) -> tuple:
    """The least costs from each state before a stretch of turns to each after it, row by row; no turns are inserted at its end."""
    columns = []
    for to in range(4):
        costs = tuple(0 if s == to else FAR for s in range(4))
        for letter in reversed(letters):
            costs = _before(letter, costs)
        columns.append(costs)
    return tuple(columns[to][s] for s in range(4) for to in range(4))


# ---- pieces -------------------------------------------------------------------------------------

_SPACES = " \t\n\x0b\x0c\r"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _letters(roles: list[str], texts: list[str], again: set[int]) -> tuple[str, int, int]:
    """The letters of turns, and how many of them are blank and repeated."""
    out, blank, repeated = [], 0, 0
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        last = text.rstrip(_SPACES)[-1:]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        blank += not last
        repeated += bool(last) and i in again
        out.append("-" if not last or i in again else initial if last in ".!?" else initial.upper())
    return "".join(out), blank, repeated


def _batches(rows: list, kinds: dict, size: int = 4096):
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + size], strict=True), kinds.values(), strict=True)], list(kinds))


_L, _I, _S, _B = pa.int64(), pa.int32(), pa.string(), pa.bool_()


def pieces(turns: DataFrame) -> DataFrame:
    """Turns in order of conversation and turn, gathered to pieces; ``whole`` where a piece surely is a conversation."""
    kinds = {"conv_id": _L, "part": _I, "piece": _L, "whole": _B, "first_turn": _L, "last_turn": _L, "turns": _L, "initials": _S, "roles": pa.list_(_S), "texts": pa.list_(_S), "digests": pa.list_(pa.binary())}

    def run(batches):
        part, piece, size, held = TaskContext.get().partitionId(), 0, 0, 0
        now, first, starts_here = None, True, False  # where a partition starts, its conversation may have started before
        rows, out = [], []

        def close(ends_here: bool):
            nonlocal piece, size
            if rows:
                numbers, roles, texts, digests = (list(x) for x in zip(*rows, strict=True))
                seen = [x for x in numbers if x is not None]
                initials = "".join(r[:1] or "\0" for r in roles)
                out.append((now, part, piece, starts_here and ends_here, seen[0] if seen else None, seen[-1] if seen else None, len(set(seen)), initials, roles, texts, digests))
                piece, size = piece + 1, 0
                rows.clear()

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first:
                    now, first = conv, False
                elif conv != now:
                    close(True)
                    now, starts_here = conv, True
                elif len(rows) >= PIECE or size > TEXT:
                    close(False)
                    starts_here = False
                rows.append(row)
                size += len(row[2])
                held += len(row[2]) + 100
                if held > TEXT and out:
                    yield from _batches(out, kinds)
                    out.clear()
                    held = 0
        close(False)
        yield from _batches(out, kinds)

    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.char_length("role"), "role", "text").cast("binary"))))
    # Equal rows may be told apart by any number: it only lets them lie in several partitions.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    schema = "conv_id long, part int, piece long, whole boolean, first_turn long, last_turn long, turns long, initials string, roles array<string>, texts array<string>, digests array<binary>"
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place").mapInArrow(run, schema)


def _again(found: DataFrame) -> DataFrame:
    """``part, piece, again``: the places in a piece of turns whose role and text an earlier turn has."""
    each = found.select("conv_id", "part", "piece", F.posexplode("digests").alias("at", "digest"))
    place = F.struct("part", "piece", "at")
    several = written(each.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "conversation-repeats")
    met = each.alias("a").join(several.alias("b"), F.expr("a.digest = b.digest and a.conv_id <=> b.conv_id and struct(a.part, a.piece, a.at) <> b.first"))
    return met.groupBy("a.part", "a.piece").agg(F.collect_list("at").alias("again"))  # PIECE places at most


def _in_order(df: DataFrame, run, schema: str, latest_first: bool = False) -> DataFrame:
    """``run`` over the pieces of each conversation one after another, as a stream: it holds a state, never the pieces."""
    order = [F.col(c).desc() if latest_first else F.col(c) for c in ("part", "piece")]
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _told(base: DataFrame) -> DataFrame:
    """What a piece of a conversation that may be in several must know of the others.

    ``state`` before it, costs ``end`` after it, whether it is the ``last``, whether its first turn number is the
    ``same`` as the one before, and the initial before it, ``edge``.
    """
    known = ["conv_id", "part", "piece", "first_turn", "last_turn", "edges"]

    def lettered(batches):
        kinds = {"letters": _S, "matrix": pa.list_(_L)}
        for batch in batches:
            *rest, roles, texts, again = batch.columns
            rows = [_letters(r, t, set(a or ()))[0] for r, t, a in zip(roles.to_pylist(), texts.to_pylist(), again.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(rows, _S), pa.array([transfer(x) for x in rows], kinds["matrix"])], [*known, *kinds])

    edges = F.concat(F.left("initials", F.lit(1)), F.right("initials", F.lit(1))).alias("edges")
    cut = base.where("not whole").select(*known[:-1], edges, "roles", "texts", "again")
    cut = written(cut.mapInArrow(lettered, "conv_id long, part int, piece long, first_turn long, last_turn long, edges string, letters string, matrix array<long>"), "conversation-cuts")

    def backward(batches):
        now, first, after = None, True, FINISHED
        for batch in batches:
            out = []
            for conv, part, piece, matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = first or conv != now
                if last:
                    now, first, after = conv, False, FINISHED
                out.append((part, piece, list(after), last))
                after = tuple(min(FAR, *(matrix[4 * s + t] + after[t] for t in range(4))) for s in range(4))
            yield from _batches(out, {"part": _I, "piece": _L, "end": pa.list_(_L), "last": _B})

    ends = _in_order(cut.select("conv_id", "part", "piece", "matrix"), backward, "part int, piece long, end array<long>, last boolean", latest_first=True)

    def mapped(batches):
        for batch in batches:
            *rest, letters = batch.columns
            ends_, lasts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("end", "last"))
            to = [[walk(x, s, tuple(e), z)[1] for s in range(4)] for x, e, z in zip(letters.to_pylist(), ends_, lasts, strict=True)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(to, pa.list_(_I))], [*batch.schema.names[:-1], "to"])

    both = cut.join(ends, ["part", "piece"]).select(*known, "end", "last", "letters")
    maps = both.mapInArrow(mapped, "conv_id long, part int, piece long, first_turn long, last_turn long, edges string, end array<long>, last boolean, to array<int>")

    def forward(batches):
        now, first, state, turn, edge = None, True, START, None, None
        for batch in batches:
            out = []
            for conv, part, piece, begins, stops, edges_, end, last, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or conv != now:
                    now, first, state, turn, edge = conv, False, START, None, None
                out.append((part, piece, state, end, last, begins is not None and begins == turn, edge))
                state, turn, edge = to[state], turn if stops is None else stops, edges_[1:]
            yield from _batches(out, {"part": _I, "piece": _L, "state": _I, "end": pa.list_(_L), "last": _B, "same": _B, "edge": _S})

    return _in_order(maps, forward, "part int, piece long, state int, end array<long>, last boolean, same boolean, edge string")


def _placed(turns: DataFrame) -> DataFrame:
    """Pieces with all that their walk needs."""
    found = written(pieces(turns), "conversation-pieces")
    base = found.drop("digests").join(_again(found), ["part", "piece"], "left")
    return base.join(_told(base), ["part", "piece"], "left")


def _walked(batch: pa.RecordBatch):
    """Each piece of a batch as a dict, with its letters' counts, audit, cost and what the edits leave."""
    for row in batch.to_pylist():
        letters, blank, repeated = _letters(row["roles"], row["texts"], set(row["again"] or ()))
        state = row["state"] or START
        last = row["whole"] or row["last"]
        audit, _, cost = walk(letters, state, tuple(row["end"] or FINISHED), last)
        initials = (row["edge"] or "") + row["initials"]
        illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        counts = {"blank": blank, "duplicate": repeated, "truncated": sum(x.isupper() for x in letters), "illegal": illegal, "cost": cost}
        yield row | counts | {"audit": audit, "left": repaired(audit, state, row["roles"], row["texts"])}


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, part, piece, place, role, text``: the turns of all conversations after repair, in that order."""
    kinds = {"conv_id": _L, "part": _I, "piece": _L, "place": _L, "role": _S, "text": _S}

    def run(batches):
        for batch in batches:
            for row in _walked(batch):
                yield from _batches([(row["conv_id"], row["part"], row["piece"], i, *x) for i, x in enumerate(row["left"])], kinds)

    return _placed(turns).mapInArrow(run, "conv_id long, part int, piece long, place long, role string, text string")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row a conversation: gaps in its turn numbers, its faults, the cost and letters of the edits, a digest of what they leave.

    ``ids`` may name more conversations (``conv_id``) than have turns. One conversation's digest
    is one pass over its text in order, as SHA-256 has no other way; only pieces of
    conversations that are cut wait for it.
    """
    kinds = {"conv_id": _L, "part": _I, "piece": _L, "whole": _B, "same": _B, "first_turn": _L, "last_turn": _L, "turns": _L, **dict.fromkeys(_COUNTS, _L), "audit": _S, "text": _S, "repaired_sha256": _S}

    def run(batches):
        for batch in batches:
            out = []
            for row in _walked(batch):
                text = "\n".join(f"{a}:{b}" for a, b in row["left"])
                row |= {"text": None if row["whole"] else text if row["left"] else None, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest() if row["whole"] else None}
                out.append(tuple(row[k] for k in kinds))
            yield from _batches(out, kinds, 256)

    long = ", ".join(f"{c} long" for c in ("first_turn", "last_turn", "turns", *_COUNTS))
    walked = written(_placed(turns).mapInArrow(run, f"conv_id long, part int, piece long, whole boolean, same boolean, {long}, audit string, text string, repaired_sha256 string"), "conversation-walks")
    shown = ["conv_id", "gaps", *_COUNTS, "audit", "repaired_sha256"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")

    def merge(batches):
        now, sums, audit, digest, any_left = None, None, [], None, False
        done = {"conv_id": _L, "gaps": _L, **dict.fromkeys(_COUNTS, _L), "audit": _S, "repaired_sha256": _S}

        def row():
            low, high, numbers, *counts = sums
            return (now, 0 if low is None else high - low + 1 - numbers, *counts, "".join(audit), digest.hexdigest())

        for batch in batches:
            out = []
            for one in batch.to_pylist():
                if digest is None or one["conv_id"] != now:
                    if digest is not None:
                        out.append(row())
                    now, sums, audit, digest, any_left = one["conv_id"], [None, None, 0, *[0] * len(_COUNTS)], [], hashlib.sha256(), False
                sums[0] = one["first_turn"] if sums[0] is None else sums[0]
                sums[1] = sums[1] if one["last_turn"] is None else one["last_turn"]
                sums[2:] = [a + b for a, b in zip(sums[2:], [one["turns"] - bool(one["same"]), *(one[c] for c in _COUNTS)], strict=True)]
                audit.append(one["audit"])
                if one["text"] is not None:
                    digest.update((("\n" if any_left else "") + one["text"]).encode())
                    any_left = True
            yield from _batches(out, done)
        if digest is not None:
            yield from _batches([row()], done)

    merged = _in_order(walked.where("not whole").drop("whole", "repaired_sha256"), merge, ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in shown))
    every = walked.where("whole").select("conv_id", gaps, *shown[2:]).unionByName(merged)
    if ids is None:
        return every
    none = hashlib.sha256(b"").hexdigest()
    asked = ids.select(F.col("conv_id").cast("long").alias("asked")).distinct()
    filled = {c: F.lit(0).cast("long") for c in ("gaps", *_COUNTS)} | {"audit": F.lit(""), "repaired_sha256": F.lit(none)}
    return asked.join(every, F.col("asked").eqNullSafe(F.col("conv_id")), "left").select(F.col("asked").alias("conv_id"), *[F.coalesce(c, x).alias(c) for c, x in filled.items()])


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with some rows dropped, emptied, without their stops, repeated or given to the user, by a checksum; nulls are one blank."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
