"""Token-id output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their frequency rank in the corpus (0 is the most frequent) and stored in
as few whole bytes as they need. The byte counts stand apart, in control bytes: one bit an id
(one or two bytes) while every rank fits two bytes, else two bits an id (one to four bytes).
The reader looks a control byte up in a table of 256 rows, so a block decodes in numpy only.

A file set is a Parquet folder of blocks in ascending ``doc_id`` order (``part``, ``block``),
each with a self-contained payload, and a vocabulary table from rank to id. Blocks keep
documents whole; a block has about ``BLOCK_IDS`` ids unless one document has more.

Defined cases: null text is an empty document (the end id alone); null ``doc_id`` sorts first;
repeated ids and rows are all kept, ordered by a hash of their text; an empty table gives an
empty file set; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import word_tokens
from pagequarry.llm.common import dropped, scratch_path, written

BLOCK_IDS = 1 << 20
MAGIC = b"PQSV"
HEADER = "<4sBxxxIQQ"  # magic, bits an id, documents, control bytes, data bytes
BLOCKS = "part int, block int, before long, n_docs int, n_ids long, payload binary"  # before: ids of the part before the block
STAGED = "doc_id long, tie long, n_ids long, ids binary, counts binary"
SAMPLED = 64  # ids a part, to find where parts begin


def control_bits(size: int) -> int:
    """Bits of control an id for a vocabulary of ``size`` ids."""
    return 1 if size <= 1 << 16 else 2


def length_table(bits: int) -> np.ndarray:
    """Byte counts that each control byte stands for: 256 rows of 8 // bits ids."""
    shifts = np.arange(0, 8, bits)
    return ((np.arange(256)[:, None] >> shifts & ((1 << bits) - 1)) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ``ranks``."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8)
    if bits == 2:
        extra = extra + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    keep = np.arange(1 << bits, dtype=np.uint8) <= extra[:, None]
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 1 << bits]
    per = 8 // bits
    padded = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    padded[: len(ranks)] = extra
    control = (padded.reshape(-1, per) << np.arange(0, 8, bits, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), raw[keep].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, int]:
    """The first ``n`` ranks, and how many data bytes they took."""
    lengths = length_table(bits)[control].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[starts].astype(np.uint32)
    for i in range(1, 1 << bits):
        more = np.flatnonzero(lengths > i)
        if not len(more):
            break
        out[more] |= data[starts[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out, int(ends[-1]) if n else 0


@dataclass
class TokenFiles:
    """Where a file set is: blocks, and the vocabulary from rank to id."""

    blocks: str
    vocabulary: str


def token_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, tie, n_ids, ids``: a row a document, ids as little-endian bytes.

    Each task adds a row with its ``counts`` of all ids of the vocabulary and nothing else.
    """

    def tokenise(batches):
        enc = word_tokens.encoder(path)
        size = max(enc.size, end_id + 1)
        kind = "<u2" if control_bits(size) == 1 else "<u4"
        total = np.zeros(size, np.int64)
        names = ["doc_id", "tie", "n_ids", "ids", "counts"]
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            first, held, ids, counts = 0, 0, [], []
            for i, one in enumerate(enc.documents(texts, end_id)):
                ids.append(one.astype(kind).tobytes())
                counts.append(len(one))
                held += len(one)
                if held > 1 << 20 or i + 1 == len(texts):
                    total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=size)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), batch.column(1).slice(first, len(ids)), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
                    first, held, ids, counts = i + 1, 0, [], []
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(tokenise, STAGED)


def _frequency_order(staged: DataFrame, size: int) -> np.ndarray:
    """Ids from the most to the least frequent, from the counts that the tasks left."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(blob.as_buffer(), np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = staged.where("counts is not null").select("counts").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    got = counts.toPandas()  # a row an id of the vocabulary at most
    total[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.lexsort((np.arange(size), -total)).astype(np.uint32)


def _key(doc_id: int | None, tie: int) -> tuple:
    return (doc_id is not None, doc_id or 0, tie)


def _part_starts(staged: DataFrame, parts: int) -> list[tuple]:
    """Where each part but the first begins, from about ``SAMPLED`` ids a part."""
    keys = staged.where("counts is null").select("doc_id", "tie")
    n = keys.count()
    if n > SAMPLED * parts:
        keys = keys.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(1 << 20)) < max(1, int((1 << 20) * SAMPLED * parts / n)))
    found = sorted({_key(r["doc_id"], r["tie"]) for r in keys.collect()})
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = 1, target: str | None = None, block_ids: int = BLOCK_IDS) -> TokenFiles:
    """Tokenise ``docs`` and write a file set; ``target`` is a folder that Spark can write."""
    spark = docs.sparkSession
    path = path or word_tokens.default_path()
    size = max(word_tokens.encoder(path).size, end_id + 1)
    bits, width = control_bits(size), 2 if control_bits(size) == 1 else 4
    ids = written(token_ids(docs, path, end_id), "token-ids")
    order = _frequency_order(ids, size)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = spark.sparkContext.broadcast(_part_starts(ids, n))
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)  # one entry an id of the vocabulary

    def encode(batches):
        for batch in batches:
            controls, datas = [], []
            parts = [bisect.bisect_right(starts.value, _key(*k)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for blob in batch.column(3):
                c, d = encode_ranks(ranks.value[np.frombuffer(blob.as_buffer(), f"<u{width}")], bits)
                controls.append(c)
                datas.append(d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(controls, pa.binary()), pa.array(datas, pa.binary()), pa.array(parts, pa.int32())], ["doc_id", "tie", "n_ids", "control", "data", "part"])

    def blocks(batches):
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs_, counts, controls, datas, total = [], [], [], [], 0

        def row():
            control, data = b"".join(controls), b"".join(datas)
            known = np.array([x is not None for x in docs_], np.uint8)
            names = np.array([x or 0 for x in docs_], "<i8")
            payload = struct.pack(HEADER, MAGIC, bits, len(docs_), len(control), len(data)) + names.tobytes() + known.tobytes() + np.array(counts, "<u4").tobytes() + control + data
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(docs_)], pa.int32()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "before", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for doc, n, control, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if docs_ and total + n > block_ids:
                    yield row()
                    block, before, total = block + 1, before + total, 0
                    for x in (docs_, counts, controls, datas):
                        x.clear()
                docs_.append(doc)
                counts.append(n)
                controls.append(control.as_py())
                datas.append(data.as_py())
                total += n
        if docs_:
            yield row()

    target = target or scratch_path(spark, "token-files")
    files = TokenFiles(f"{target}/blocks", f"{target}/vocabulary")
    coded = ids.where("counts is null").select("doc_id", "tie", "n_ids", "ids").mapInArrow(encode, "doc_id long, tie long, n_ids long, control binary, data binary, part int")
    (coded.repartitionById(n, F.col("part")).sortWithinPartitions("doc_id", "tie").mapInArrow(blocks, BLOCKS)
        .write.option("compression", "uncompressed").parquet(files.blocks))
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(files.vocabulary)
    dropped(ids)
    return files


def read_tokens(spark: SparkSession, files: TokenFiles, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a file set; ids as little-endian uint32 bytes.

    With ``digest`` their unsigned crc32, ``ids_crc32``, takes the place of ``ids``.
    """
    blocks = spark.read.schema(BLOCKS).parquet(files.blocks)
    vocabulary = spark.read.schema("rank int, id int").parquet(files.vocabulary).orderBy("rank").toPandas()
    ids = spark.sparkContext.broadcast(vocabulary["id"].to_numpy(np.uint32))
    # One row a part: 16 bytes for each of as many parts as the writer had shuffle partitions.
    base, at = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]] = at
        at += r["n"]
    bases = spark.sparkContext.broadcast(base)
    out = "ids_crc32 long" if digest else "ids binary"

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                magic, bits, n, n_control, n_data = struct.unpack_from(HEADER, raw)
                if magic != MAGIC:
                    raise ValueError("not a block of token ids")
                at = struct.calcsize(HEADER)
                names, at = raw[at : at + 8 * n].view("<i8"), at + 8 * n
                known, at = raw[at : at + n].astype(bool), at + n
                counts, at = np.frombuffer(raw[at : at + 4 * n].tobytes(), "<u4").astype(np.int64), at + 4 * n
                control, data = raw[at : at + n_control], raw[at + n_control : at + n_control + n_data]
                blobs, c, d = [], 0, 0
                for k in counts.tolist():
                    took = -(-k * bits // 8)
                    ranks, used = decode_ranks(control[c : c + took], data[d : d + k * (1 << bits)], k, bits)
                    found = ids.value[ranks].astype("<u4")
                    blobs.append(zlib.crc32(found) if digest else found.tobytes())
                    c, d = c + took, d + used
                starts = bases.value[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py() + np.cumsum(counts) - counts
                columns = [pa.array(names, pa.int64(), mask=~known), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.int64() if digest else pa.binary())]
                for j in range(0, n, 2000):
                    yield pa.RecordBatch.from_arrays([x.slice(j, 2000) for x in columns], ["doc_id", "start", "n_tokens", out.split()[0]])

    return blocks.select("part", "before", "payload").mapInArrow(decode, f"doc_id long, start long, n_tokens long, {out}")
