"""Byte-level BPE over overlapping chunks, and its decoder.

Every text is cut into chunks that overlap. Each chunk is pre-tokenised on its own from its first
code point on; its first boundaries may be false, since it starts inside a pre-token. A match
depends on the text from its start on only (the pattern looks ahead, never behind), so two chunks
agree from the first boundary that both have: there they are stitched. A match that ends at or
just before a chunk's end may be cut short and is never used. Where an overlap holds no common
boundary (one pre-token longer than the overlap), the text from the last sure boundary on is
pre-tokenised again with the next chunk. The stitched pieces are then encoded one by one by the
ranks. Decoding joins the bytes of the ids.

A text of over ``DEALT`` code points is dealt over tasks in long chunks: these send the boundaries
in their overlaps only, find from them where they resynchronise, and encode what is theirs. The
ids of a text come together in order, chunk by chunk, where its digest is made. Only if an
overlap of such a text holds no common boundary one task goes through the whole of it.

Defined cases: null text is empty (no ids); very long texts as above; repeated rows and null ids
are kept, each row by itself; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import CACHES, written

#: Code points of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 1024, 64
#: Code points of a text from which on its chunks are dealt over tasks, and of the overlap then.
DEALT, DEALT_OVERLAP = 1 << 18, 1 << 10
#: A match that ends so near a chunk's end could differ if more text were seen ("'r" before "e").
LOOKAHEAD = 2
#: Distinct pieces that a worker keeps; beyond it the cache starts anew.
CACHED_PIECES = 400_000

_CODERS: dict[str, "ByteBpe"] = {}
CACHES.append(_CODERS.clear)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def coder(path: str) -> "ByteBpe":
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def spans(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Starts and ends of the overlapping chunks of a text of ``n`` code points."""
    out, at = [], 0
    while True:
        end = min(n, at + chunk)
        out.append((at, end))
        if end == n:
            return out
        at = end - overlap


class ByteBpe:
    """Ranks, the pre-token pattern, and a bounded cache from piece to ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.cache: dict[str, list[int]] = {}

    def pieces(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of ``text`` and where they end; the pattern leaves no gaps."""
        found = self.pattern.findall(text)
        return found, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHED_PIECES:
            cache.clear()
        for piece in {p for p in pieces if p not in cache}:
            cache[piece] = self.core.encode_single_piece(piece.encode("utf-8", "replace"))
        ids: list[int] = []
        for found in map(cache.__getitem__, pieces):
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def meeting(sure: np.ndarray, ends: np.ndarray, low: int, high: int) -> int | None:
    """The first boundary of both chunks in their overlap ``low .. high``; the later one starts at ``low``."""
    sure = sure[np.searchsorted(sure, low) : np.searchsorted(sure, high - LOOKAHEAD, side="right")]
    if len(sure) and sure[0] == low:
        return low
    both = sure[np.isin(sure, ends[: np.searchsorted(ends, high, side="right")])]
    return int(both[0]) if len(both) else None


def pre_tokens(bpe: ByteBpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yield the pre-tokens of one text, lists of them, stitched from its chunks."""
    parts = spans(len(text), chunk, overlap)
    found, ends = bpe.pieces(text[: parts[0][1]])
    for (_, stop), (low, high) in zip(parts, parts[1:], strict=False):
        more, new = bpe.pieces(text[low:high])
        new += low
        at = meeting(ends, new, low, stop)
        if at is None:
            keep = int(np.searchsorted(ends, stop - LOOKAHEAD, side="right"))
            at = int(ends[keep - 1]) if keep else stop - int(len("".join(found)))
            yield found[:keep]
            found, ends = bpe.pieces(text[at:high])
            ends += at
            continue
        yield found[: int(np.searchsorted(ends, at, side="right"))]
        cut = int(np.searchsorted(new, at, side="right"))
        found, ends = more[cut:], new[cut:]
    yield found


def encode_text(bpe: ByteBpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text, chunk by chunk."""
    ids: list[int] = []
    for found in pre_tokens(bpe, text, chunk, overlap):
        ids += bpe.encode_pieces(found)
    return ids


class Ids:
    """The ids of a text as little-endian 32-bit numbers, and how many."""

    schema, names, types = "doc_id long, ids binary, n_tokens long", ["doc_id", "ids", "n_tokens"], [pa.int64(), pa.binary(), pa.int64()]

    def __init__(self, bpe: ByteBpe) -> None:
        self.parts: list[bytes] = []

    def add(self, ids: list[int]) -> None:
        self.parts.append(np.array(ids, "<u4").tobytes())

    def row(self) -> tuple:
        whole = b"".join(self.parts)
        return whole, len(whole) // 4


class Digests:
    """How many ids, the digest of the decimal ids, and that of the bytes that they decode to."""

    schema, names, types = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.n, self.text, self.raw = bpe, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.text.update((" " * (self.n > 0) + " ".join(map(self.bpe.decimal.__getitem__, ids))).encode())
            self.raw.update(self.bpe.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.text.hexdigest(), self.raw.hexdigest()


def _rows(rows: list[tuple], form) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), form.types, strict=True)], form.names)


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, form=Ids, dealt: int = DEALT, dealt_overlap: int = DEALT_OVERLAP) -> DataFrame:
    """``doc_id`` and what ``form`` makes of the ids of each text."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = _whole(rows.where(F.length("text") <= dealt), path, chunk, overlap, form)
    return whole.unionByName(_dealt(rows.where(F.length("text") > dealt), path, chunk, overlap, form, dealt, dealt_overlap))


def _whole(rows: DataFrame, path: str, chunk: int, overlap: int, form) -> DataFrame:
    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    one = form(bpe)
                    one.add(encode_text(bpe, text, chunk, overlap))
                    out.append((doc, *one.row()))
                yield _rows(out, form)

    return rows.mapInArrow(run, form.schema)


def _dealt(rows: DataFrame, path: str, chunk: int, overlap: int, form, size: int, common: int) -> DataFrame:
    """Long texts in chunks of ``size`` that overlap by ``common``, over all tasks."""
    step = size - common
    cut = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("length", F.length("text").cast("long"))
        .select("row", "doc_id", "text", "length", F.explode(F.expr(f"sequence(0, cast(ceil((length - {size}) / {step}) as int))")).alias("k"))
        .select("row", "doc_id", "length", "k", (F.col("k") * step).cast("long").alias("start"), F.expr(f"substring(text, k * {step} + 1, {size})").alias("chunk"))
    )
    cut = written(cut.repartition("row", "k"), "bpe-chunks")

    def edges(batches):
        """Boundaries of each chunk in its overlaps with the one before and the one after."""
        bpe = coder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                start, text = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                ends, at = [np.zeros(0, np.int64)], start
                for found in pre_tokens(bpe, text, chunk, overlap):
                    ends.append(at + np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))
                    at = int(ends[-1][-1]) if len(found) else at
                ends, stop = np.concatenate(ends), start + len(text)
                head = ends[: np.searchsorted(ends, start + common, side="right")]
                tail = ends[np.searchsorted(ends, stop - common) : np.searchsorted(ends, stop - LOOKAHEAD, side="right")]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, 1) for x in (0, 1)), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (head, tail))], ["row", "k", "head", "tail"])

    found = cut.select("row", "k", "start", "chunk").mapInArrow(edges, "row long, k int, head array<long>, tail array<long>")
    # Small arrays only: where each chunk meets the next one, null where it does not.
    turn = Window.partitionBy("row").orderBy("k")
    both = found.withColumn("after", F.lead("head").over(turn)).withColumn("low", F.lit(step).cast("long") * (F.col("k") + 1))
    meets = F.when(F.array_contains("tail", F.col("low")), F.col("low")).otherwise(F.array_min(F.array_intersect("tail", "after")))
    both = both.withColumn("to", F.when(F.col("after").isNotNull(), meets)).withColumn("lost", F.max(F.col("after").isNotNull() & meets.isNull()).over(Window.partitionBy("row")))
    both = both.withColumn("from", F.lag("to").over(turn)).select("row", "k", "from", "to", "lost")
    own = cut.join(both, ["row", "k"]).select("row", "doc_id", "k", "start", "chunk", "from", "to", "lost")

    def ids(batches):
        bpe = coder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                start, text, low, high = (batch.column(x)[i].as_py() for x in (3, 4, 5, 6))
                # Pre-tokens up to the next meeting place, which lies within the chunk: what follows is looked at.
                low, coded = start if low is None else low, []
                for found in pre_tokens(bpe, text[low - start :], chunk, overlap):
                    ends = low + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
                    keep = len(found) if high is None else int(np.searchsorted(ends, high, side="right"))
                    coded += bpe.encode_pieces(found[:keep])
                    if keep < len(found):
                        break
                    low = int(ends[-1]) if keep else low
                blob = np.array(coded, "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, 1) for x in range(3)), pa.array([blob], pa.binary()), pa.array([None], pa.string())], ["row", "doc_id", "k", "ids", "chunk"])

    coded = own.where("not lost").mapInArrow(ids, "row long, doc_id long, k int, ids binary, chunk string")
    lost = own.where("lost").select("row", "doc_id", "k", F.lit(None).cast("binary").alias("ids"), F.when(F.col("k") == 0, F.col("chunk")).otherwise(F.expr(f"substring(chunk, {common} + 1)")).alias("chunk"))

    def fold(batches):
        bpe, name, one, texts = coder(path), None, None, []

        def end():
            if texts:
                one.add(encode_text(bpe, "".join(texts), chunk, overlap))
                texts.clear()
            return _rows([(name[1], *one.row())], form)

        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if at != name:
                    if name is not None:
                        yield end()
                    name, one = at, form(bpe)
                if batch.column(3)[i].is_valid:
                    one.add(np.frombuffer(batch.column(3)[i].as_buffer(), "<u4").tolist())
                else:
                    texts.append(batch.column(4)[i].as_py())
        if name is not None:
            yield end()

    return coded.unionByName(lost).repartition("row").sortWithinPartitions("row", "k").mapInArrow(fold, form.schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, bytes``: what the ids stand for."""
    path = path or default_path()

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                raw = [bpe.decode(np.frombuffer(x.as_buffer(), "<u4").tolist()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "n_tokens", "bytes"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, n_tokens long, bytes binary")
