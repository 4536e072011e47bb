"""Exact top-k by inner product: a dual-tree search over cover trees.

Queries and data are indexed together. The top level of the cover tree is a bounded number of
pivots, drawn from the rows; every vector belongs to the nearest one. Below, the vectors of a
pivot are packed into blocks, and each block is written with a cover tree of its own: every node
has a centre that is one of its vectors, a covering radius, and children around centres that lie
far from each other. Blocks of queries are indexed in the same way around the same pivots.

For a query node around q (radius s, norms up to a) and a data node around d (radius r, norms up
to b) no inner product exceeds any of <q, d> + |q| r + |d| s + r s, a b, and
(a^2 + b^2 - max(0, |q - d| - r - s)^2) / 2. A pair of nodes is left out when the least of them is
below the worst kth score of the query node's queries; equal scores are never left out, so ties
go to the smaller id exactly. Pairs are opened level by level, for pivots, blocks and nodes alike.

The first pass searches one block near each query block, which gives kth scores to start from.
The second one meets each query block with the blocks of all pivots that the bounds let through,
dealt over lanes: a task holds a group of neighbouring query blocks and reads data blocks one after
another, each for all of the group that it may hold answers for, so that a data block moves once a group. Of the
trees' pruning only what the vectors allow is saved: on directions drawn at random nothing can
be left out, and the work is that of blockwise matrix products.

Defined cases: vectors that are null, hold null or non-finite components, are empty or have a
null id take no part; a vector meets vectors of its own length only; candidates with the query's
own id take no part for it; repeated rows are candidates each, and every query row is answered by
itself, so a query row that is there twice gives its answer twice; fewer than k candidates give
fewer rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import flat_gather, written

K, SCALE, PIVOTS, LEAF, FANOUT = 20, 64, 1024, 512, 8
LEAST_LEAF, NARROWER = 8, 0.65
#: Vectors a block holds: at most, and at least where there are few (so that tasks stay busy).
DATA_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 16_384, 4_096, 1_024
LANE = 256  # data blocks that a task reads one after another, at most about
GROUP = 16  # query blocks that a task holds while it reads them
CHUNK = 1_024  # data vectors that a query leaf meets before its worst scores are looked at again
BLOCK = "node long, part long, n long, radius double, most double, payload binary"
FOUND = "node long, part long, row int, query_id long, vec_id long, score long"
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Tree:
    """A cover tree over whole-number vectors; nodes are ranges of rows, level after level."""

    ARRAYS = ("ids", "vectors", "start", "end", "first", "last", "centre", "radius", "norm")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order, rng = np.arange(len(ids)), np.random.default_rng(len(ids))
        v = vectors.astype(np.float64)
        begin = int(np.argmin(((v - v.mean(axis=0)) ** 2).sum(1)))
        start, end, centres, radius, first, last = [0], [len(ids)], [begin], [], [], []
        node = 0
        while node < len(start):
            a, b, c = start[node], end[node], centres[node]
            rows = order[a:b]
            near = np.sqrt(((v[rows] - v[c]) ** 2).sum(1))
            radius.append(float(near.max()))
            first.append(len(start))
            if b - a > LEAST_LEAF and near.max() > 0:
                # The node's own centre and others drawn by their squared distance from those before;
                # all rows go to the nearest one.
                best, found = np.zeros(b - a, np.int64), [c]
                while len(found) < FANOUT and near.max() > radius[node] / 4:
                    run = np.cumsum(near**2)
                    far = int(np.searchsorted(run, rng.random() * run[-1], side="right"))
                    found.append(int(rows[min(far, len(rows) - 1)]))
                    d = np.sqrt(((v[rows] - v[found[-1]]) ** 2).sum(1))
                    best[d < near] = len(found) - 1
                    near = np.minimum(near, d)
                sort = np.argsort(best, kind="stable")
                cuts = np.searchsorted(best[sort], np.arange(len(found) + 1))
                # Small nodes are split only where that makes their parts much narrower.
                if np.count_nonzero(np.diff(cuts)) > 1 and (b - a > LEAF or near.mean() < NARROWER * radius[node]):
                    order[a:b] = rows[sort]
                    for i in np.flatnonzero(np.diff(cuts)).tolist():
                        start.append(a + int(cuts[i]))
                        end.append(a + int(cuts[i + 1]))
                        centres.append(found[i])
            last.append(len(start))
            node += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.start, self.end, self.first, self.last = (np.array(x, np.int64) for x in (start, end, first, last))
        self.centre, self.radius = v[centres], np.array(radius)
        norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.norm = np.array([norms[a:b].max() for a, b in zip(start, end, strict=True)])

    def packed(self) -> bytes:
        out = io.BytesIO()
        small = np.iinfo(np.int16)
        kind = np.int16 if self.vectors.min() >= small.min and self.vectors.max() <= small.max else np.int64
        np.savez(out, **{k: getattr(self, k) for k in self.ARRAYS if k not in ("vectors", "centre")}, vectors=self.vectors.astype(kind), centre=self.centre.astype(kind))
        return out.getvalue()

    @classmethod
    def unpacked(cls, payload: bytes) -> "Tree":
        held, tree = np.load(io.BytesIO(payload)), cls.__new__(cls)
        for k in cls.ARRAYS:
            setattr(tree, k, held[k])
        tree.vectors, tree.centre = tree.vectors.astype(np.int64), tree.centre.astype(np.float64)
        tree.floats = tree.vectors.astype(np.float64)
        return tree


def bounds(qc, qr, qn, dc, dr, dn) -> np.ndarray:
    """No inner product of pairs of nodes exceeds this; centres, radii and greatest norms of both, broadcast."""
    inner = (qc * dc).sum(-1)
    qq, dd = (qc**2).sum(-1), (dc**2).sum(-1)
    apart = np.maximum(np.sqrt(np.maximum(qq + dd - 2 * inner, 0)) - qr - dr, 0)
    top = np.minimum(np.minimum(inner + np.sqrt(qq) * dr + np.sqrt(dd) * qr + qr * dr, qn * dn), (qn**2 + dn**2 - apart**2) / 2)
    return top + 1e-9 * (np.abs(top) + qn * dn) + 1e-6


def products(q: Tree, rows: slice, d: Tree, at: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: by floats where all sums fit 2**53."""
    if float(q.norm[0]) * float(d.norm[0]) < 2.0**52:
        return (q.floats[rows] @ d.floats[at].T).astype(np.int64)
    return q.vectors[rows] @ d.vectors[at].T


class Best:
    """The k best candidates of each query so far; ``worst`` is a score that k candidates reach."""

    def __init__(self, n: int, k: int, worst: np.ndarray | None = None) -> None:
        self.k = k
        self.score, self.id = np.full((n, k), _LOW, np.int64), np.full((n, k), _HIGH, np.int64)
        self.worst = np.full(n, -np.inf) if worst is None else worst.copy()

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """``scores`` of the queries from ``first`` on with candidates ``ids``, where ``valid``."""
        n, many = scores.shape
        own = slice(first, first + n)
        level = self.worst[own]
        if many > self.k:
            shown = np.where(valid, scores, _LOW)
            level = np.maximum(level, np.partition(shown, many - self.k, axis=1)[:, many - self.k].astype(np.float64))
        row, col = np.nonzero(valid & (scores >= level[:, None]))
        if not len(row):
            return
        old_row, old_col = np.nonzero(self.id[own] != _HIGH)
        s = np.concatenate([scores[row, col], self.score[own][old_row, old_col]])
        i = np.concatenate([ids[col], self.id[own][old_row, old_col]])
        r = np.concatenate([row, old_row])
        order = np.lexsort((i, -s, r))
        s, i, r = s[order], i[order], r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        s, i, r, place = s[keep], i[keep], r[keep], place[keep]
        some = np.unique(r)
        self.score[first + some], self.id[first + some] = _LOW, _HIGH
        self.score[first + r, place], self.id[first + r, place] = s, i
        last = self.score[own, -1]
        self.worst[own] = np.maximum(self.worst[own], np.where(self.id[own, -1] == _HIGH, -np.inf, last.astype(np.float64)))


def search(q: Tree, d: Tree, best: Best) -> int:
    """Search ``d`` for all of ``q``; returns how many inner products it took."""

    def level(i):  # the worst kth score of each query node
        return np.array([best.worst[a:b].min() for a, b in zip(q.start[i], q.end[i], strict=True)])

    i, j, leaves_i, leaves_j, tops = np.zeros(1, np.int64), np.zeros(1, np.int64), [], [], []
    while len(i):
        top = np.concatenate([bounds(q.centre[x], q.radius[x], q.norm[x], d.centre[y], d.radius[y], d.norm[y]) for x, y in zip(np.array_split(i, len(i) // 8192 + 1), np.array_split(j, len(i) // 8192 + 1), strict=True)])
        names, at = np.unique(i, return_inverse=True)
        keep = top >= level(names)[at]
        i, j, top = i[keep], j[keep], top[keep]
        more_i, more_j = q.last[i] - q.first[i], d.last[j] - d.first[j]
        done = (more_i == 0) & (more_j == 0)
        leaves_i.append(i[done]), leaves_j.append(j[done]), tops.append(top[done])
        i, j, more_i, more_j = i[~done], j[~done], more_i[~done], more_j[~done]
        # Open the wider node of each pair.
        wide = (more_j > 0) & ((more_i == 0) | (d.radius[j] >= q.radius[i]))
        count = np.where(wide, more_j, more_i)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        i, j, wide = np.repeat(i, count), np.repeat(j, count), np.repeat(wide, count)
        i, j = np.where(wide, i, q.first[i] + step), np.where(wide, d.first[j] + step, j)
    i, j, top = np.concatenate(leaves_i), np.concatenate(leaves_j), np.concatenate(tops)
    order, work = np.lexsort((-top, i)), 0
    i, j, top = i[order], j[order], top[order]
    cuts = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i)) if len(i) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows = slice(int(q.start[i[a]]), int(q.end[i[a]]))
        while a < b and top[a] >= best.worst[rows].min():  # the most promising leaves first
            sizes = np.cumsum(d.end[j[a:b]] - d.start[j[a:b]])
            c = a + max(1, int(np.searchsorted(sizes, CHUNK, side="right")))
            at = flat_gather(d.start[j[a:c]], d.end[j[a:c]] - d.start[j[a:c]])
            ids = d.ids[at]
            best.add(rows.start, products(q, rows, d, at), ids, q.ids[rows, None] != ids[None, :])
            work += (rows.stop - rows.start) * len(at)
            a = c
    return work


def _nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    size = (pivots**2).sum(1)
    return np.concatenate([np.argmin(size - 2 * x @ pivots.T, axis=1) for x in np.array_split(v, len(v) // 4096 + 1)])


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Rows (``node, vec_id, v``) in blocks of about ``size`` with a tree each; full nodes are split by a hash."""
    parts = np.ones(len(pivots), np.int64)
    for r in rows.groupBy("node").count().collect():  # a row a pivot
        parts[r["node"]] = -(-r["count"] // size)
    many = F.array(*[F.lit(int(x)) for x in parts])
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", "row"), many[F.col("node").cast("int")]))

    def pack(table: pa.Table) -> pa.Table:
        tree = Tree(table["vec_id"].to_numpy(), np.stack(table["v"].to_numpy(zero_copy_only=False)))
        centre = pivots[table["node"][0].as_py()]
        away = float(np.sqrt(((tree.vectors - centre) ** 2).sum(1)).max())
        return pa.table([table["node"].slice(0, 1), table["part"].slice(0, 1), pa.array([len(tree.ids)]), pa.array([away]), pa.array([float(tree.norm[0])]), pa.array([tree.packed()], pa.binary())], ["node", "part", "n", "radius", "most", "payload"])

    return dealt.select("node", "part", "vec_id", "v").groupBy("node", "part").applyInArrow(pack, BLOCK)


def _of_one_length(clean: DataFrame, queries, n: int, k: int, pivots_most: int) -> DataFrame:
    spark = clean.sparkSession
    size = int(min(DATA_BLOCK, max(LEAST_BLOCK, n // 64)))
    most = int(min(pivots_most, max(1, n // size)))
    drawn = clean.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).select("v").collect()  # at most PIVOTS rows
    drawn = np.array([r["v"] for r in drawn], np.float64)
    pivots = np.unique(drawn, axis=0)
    # Fewer query blocks, as full as may be: each of them meets every data block that is not left out.
    q_pivots = np.unique(drawn[: max(1, clean.where(queries).count() // QUERY_BLOCK)], axis=0)

    def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
        def to_nodes(batches):
            for batch in batches:
                if batch.num_rows:
                    v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(_nearest(v, centres)), *batch.columns], ["node", "vec_id", "v", "row"])

        # The number of a row only deals repeated rows over blocks: any number will do when a task runs again.
        return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(to_nodes, "node long, vec_id long, v array<long>, row long")

    data = written(_blocks(placed(clean, pivots), pivots, size), "topk-data")
    asked = written(_blocks(placed(clean.where(queries), q_pivots), q_pivots, QUERY_BLOCK), "topk-queries")

    def run(batches):
        name, held = None, {}

        def rows():
            for (node, part), (q, best) in held.items():
                row, col = np.nonzero(best.id != _HIGH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), node)), pa.array(np.full(len(row), part)), pa.array(row.astype(np.int32)), pa.array(q.ids[row]), pa.array(best.id[row, col]), pa.array(best.score[row, col])], FOUND.replace(",", "").split()[::2])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                at, payload = tuple(batch.column(x)[i].as_py() for x in range(2)), batch.column(4)[i].as_py()
                if at != name:
                    yield from rows()
                    name = at
                if batch.column(6)[i].as_py() is None:  # a query block: they come first
                    q, known = Tree.unpacked(payload), batch.column(5)[i].as_py()
                    held[batch.column(2)[i].as_py(), batch.column(3)[i].as_py()] = q, Best(len(q.ids), k, None if known is None else np.frombuffer(known, np.float64))
                else:
                    block = Tree.unpacked(payload)
                    for who in batch.column(6)[i].as_py():
                        q, best = held[who["node"], who["part"]]
                        search(q, block, best)
        yield from rows()

    def searched(pairs: DataFrame, levels: DataFrame | None, together: int) -> DataFrame:
        """Pairs ``node, part, lane, turn, d_node, d_part``: in a lane a group of query blocks, then the data blocks that any of them meets."""
        nothing = F.lit(None).cast("binary")
        pairs = pairs.join(F.broadcast(numbers), "node").withColumn("group", F.floor((F.col("number") + F.col("part")) / together)).drop("number")
        q = pairs.select("group", "lane", "node", "part").distinct().join(asked.select("node", "part", "payload"), ["node", "part"])
        q = q.join(levels, ["node", "part"], "left") if levels is not None else q.withColumn("known", nothing)
        met = pairs.groupBy("group", "lane", "d_node", "d_part").agg(F.min("turn").alias("turn"), F.collect_list(F.struct("node", "part")).alias("who"))  # the blocks of a group at most
        d = met.join(data.select(F.col("node").alias("d_node"), F.col("part").alias("d_part"), "payload"), ["d_node", "d_part"])
        q = q.select("group", "lane", F.lit(-1).alias("turn"), "node", "part", "payload", "known", F.lit(None).cast("array<struct<node:bigint,part:bigint>>").alias("who"))
        d = d.select("group", "lane", "turn", F.col("d_node").alias("node"), F.col("d_part").alias("part"), "payload", nothing.alias("known"), "who")
        dealt = q.unionByName(d).repartition("group", "lane").sortWithinPartitions("group", "lane", "turn")
        return dealt.drop("turn").mapInArrow(run, FOUND)

    # First pass: the part of the nearest pivot with data that comes first, for every query block.
    sides = []
    for side in (data, asked):
        summary = side.groupBy("node").agg(F.max("radius").alias("radius"), F.max("most").alias("most"), F.count("*").alias("parts")).toPandas()  # a row a pivot
        sides.append(summary.sort_values("node"))
    found, ours = sides
    d_nodes, q_nodes = (x["node"].to_numpy(np.int64) for x in sides)
    if not len(q_nodes):
        return spark.createDataFrame([], FOUND)
    # Query blocks in a row, those of a pivot next to each other: a group is a stretch of them.
    firsts = np.cumsum(ours["parts"].to_numpy()) - ours["parts"].to_numpy()
    numbers = spark.createDataFrame(list(zip(q_nodes.tolist(), firsts.tolist(), strict=True)), "node long, number long")  # a row a pivot
    tops = np.stack([bounds(q_pivots[i], r, m, pivots[d_nodes], found["radius"].to_numpy(), found["most"].to_numpy()) for i, r, m in ours[["node", "radius", "most"]].itertuples(index=False)])
    gone = asked.select("node", "part", "n")
    nearest = d_nodes[_nearest(q_pivots[q_nodes], pivots[d_nodes])]
    begin = spark.createDataFrame(list(zip(q_nodes.tolist(), nearest.tolist(), strict=True)), "node long, begin long")
    near = gone.join(F.broadcast(begin), "node").select("node", "part", F.lit(0).alias("lane"), F.lit(0).alias("turn"), F.col("begin").alias("d_node"), F.lit(0).cast("long").alias("d_part"))
    own = written(searched(near, None, 1), "topk-own")
    rank = Window.partitionBy("node", "part", "row").orderBy(F.desc("score"), "vec_id")
    kth = own.withColumn("rank", F.row_number().over(rank)).where(f"rank = {k}").select("node", "part", "row", F.col("score").cast("double").alias("s"))

    def as_levels(table: pa.Table) -> pa.Table:
        known = np.full(table["n"][0].as_py(), -np.inf)
        row = table["row"].to_numpy()
        has = ~np.isnan(row.astype(np.float64))
        known[row[has].astype(np.int64)] = table["s"].to_numpy()[has]
        return pa.table([table["node"].slice(0, 1), table["part"].slice(0, 1), pa.array([known.min()]), pa.array([known.tobytes()], pa.binary())], ["node", "part", "low", "known"])

    levels = written(gone.join(kth, ["node", "part"], "left").groupBy("node", "part").applyInArrow(as_levels, "node long, part long, low double, known binary"), "topk-levels")

    # Second pass: pairs of a query block and a pivot that the bound lets through.
    shared = spark.sparkContext.broadcast((q_nodes, d_nodes, tops))  # pivots times pivots

    def reach(batches):
        q_, d_, t = shared.value
        for batch in batches:
            for node, part, low in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                top = t[int(np.searchsorted(q_, node))]
                use = np.flatnonzero(top >= low)
                use = use[np.argsort(-top[use], kind="stable")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), node)), pa.array(np.full(len(use), part)), pa.array(np.arange(len(use), dtype=np.int32)), pa.array(d_[use])], ["node", "part", "turn", "d_node"])

    pairs = levels.select("node", "part", "low").mapInArrow(reach, "node long, part long, turn int, d_node long")
    pairs = pairs.join(data.select(F.col("node").alias("d_node"), F.col("part").alias("d_part")), "d_node")
    pairs = pairs.join(F.broadcast(begin), "node").where("d_node <> begin or d_part <> 0").drop("begin")
    blocks, busy = int(found["parts"].sum()), 2 * spark.sparkContext.defaultParallelism // -(-int(ours["parts"].sum()) // GROUP)
    lanes = max(1, -(-blocks // LANE), min(blocks, busy))
    pairs = written(pairs.withColumn("lane", F.pmod(F.xxhash64("d_node", "d_part"), F.lit(lanes)).cast("int")), "topk-pairs")
    return own.unionByName(searched(pairs, levels.select("node", "part", "known"), GROUP))


def top_k(data: DataFrame, queries=None, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` best candidates.

    ``queries`` is a condition on ``vec_id``; by default ids divisible by 20.
    """
    queries = F.col("vec_id") % 20 == 0 if queries is None else queries
    x = F.col(vector_column)
    sound = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    clean = data.where(sound).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    lengths = clean.groupBy(F.size("v").alias("length")).count().where("length > 0").collect()  # a row a length of vectors
    found = [_of_one_length(clean.where(F.size("v") == r["length"]), queries, r["count"], k, pivots) for r in sorted(lengths)]
    if not found:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = Window.partitionBy("length", "node", "part", "row").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, [f.withColumn("length", F.lit(i)) for i, f in enumerate(found)])
    return every.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
