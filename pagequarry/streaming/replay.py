"""Streams of edits and searches (R2, R4-R9), and the same over finished tables."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.operators.sequences import folded
from pagequarry.plans.registry import query
from pagequarry.sources.views import table

GAP = "30 minutes"
UNDO_DEPTH = 100


def debounced(events: DataFrame, gap: str = GAP) -> DataFrame:
    """The last event of every burst: one burst a user while the pauses stay under ``gap``.

    Batch or streaming; a stream needs a watermark on ``ts``.
    """
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), last.alias("event_id")).select("user_id", F.col("w.start").alias("start"), "n", "event_id")


@query("WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS start, count(*) AS n, arg_max(event_id, ts) AS event_id FROM g GROUP BY user_id, k")
def debounced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounced(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"))


@query("SELECT event_id, user_id, event_id % 5 AS generation FROM (SELECT *, max(event_id % 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS newest FROM events) WHERE event_id % 5 = newest")
def stale_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are not older than the newest generation seen so far."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 5).alias("generation"))
    return e.withColumn("newest", F.max("generation").over(over)).where("generation = newest").select("event_id", "user_id", "generation")


def undo_step(state: tuple[list[int], list[int]], i: int, kind: str, depth: int = UNDO_DEPTH) -> tuple[list[int], list[int]]:
    """Undo and redo stacks after one more action; a new one clears redo, the oldest goes beyond ``depth``."""
    done, undone = state
    if kind == "undo":
        if done:
            undone.append(done.pop())
    elif kind == "redo":
        if undone:
            done.append(undone.pop())
    else:
        done.append(i)
        undone.clear()
        del done[:-depth]
    return done, undone


_STEPS = "s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_STEPS}, f AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.k, CASE WHEN event_id % 4 = 3 THEN done[1:len(done) - 1] WHEN event_id % 9 = 8 THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE list_append(done, event_id)[-{UNDO_DEPTH}:] END,
  CASE WHEN event_id % 4 = 3 THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN event_id % 9 = 8 THEN undone[1:len(undone) - 1] ELSE [] END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
 SELECT f.user_id, len(done) AS can_undo, len(undone) AS can_redo, done[-1] AS top FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k AND s.k = s.n""")
def undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo and redo depths of each user; one in four events undoes, one in nine redoes."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 3, "undo").when(i % 9 == 8, "redo").otherwise("do")
    e = table(spark, sf_dir, "events").select("user_id", "ts", i, kind.alias("kind"))
    return folded(e, "user_id", ["ts", "event_id"], ["event_id", "kind"], lambda: ([], []), undo_step, lambda s: (len(s[0]), len(s[1]), s[0][-1] if s[0] else None), "can_undo long, can_redo long, top long")


@dataclass
class Kept:
    """What a cache of least recent use holds, the newest last, and what happened so far."""

    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    evicted: int = 0


def kept_after(state: Kept, key: int, size: int, most: int) -> Kept:
    """One more use of ``key``; the oldest go while ``size`` of all is beyond ``most``, but one always stays."""
    if key in state.entries:
        state.hits += 1
        state.entries.move_to_end(key)
    else:
        state.entries[key] = size
    while len(state.entries) > 1 and sum(state.entries.values()) > most:
        state.entries.popitem(last=False)
        state.evicted += 1
    return state


def cache_use(uses: DataFrame, most: int) -> DataFrame:
    """``user_id, hits, evicted, held, newest`` after all uses (``user_id, ts, event_id, key, size``) in order."""
    return folded(uses, "user_id", ["ts", "event_id"], ["key", "size"], Kept, lambda s, k, n: kept_after(s, k, n, most), lambda s: (s.hits, s.evicted, len(s.entries), next(reversed(s.entries))), "hits long, evicted long, held long, newest long")


def _cache_sql(size: str, most: int) -> str:
    return f"""WITH RECURSIVE {_STEPS}, u AS (SELECT *, event_id * 7 % 23 AS key, {size} AS size FROM s),
 f AS (SELECT user_id, 0::BIGINT AS k, []::STRUCT(key BIGINT, size BIGINT)[] AS held, 0::BIGINT AS hits, 0::BIGINT AS evicted FROM s WHERE k = 1 UNION ALL
  SELECT x.user_id, x.k, list_filter(x.every, lambda e, i: i = 1 OR list_sum(list_transform(x.every[1:i], lambda y: y.size)) <= {most}), x.hits + x.hit, x.evicted + len(x.every) - len(list_filter(x.every, lambda e, i: i = 1 OR list_sum(list_transform(x.every[1:i], lambda y: y.size)) <= {most}))
  FROM (SELECT u.user_id, u.k, f.hits, f.evicted, (len(list_filter(f.held, lambda e: e.key = u.key)) > 0)::INT AS hit, list_prepend({{'key': u.key, 'size': u.size}}, list_filter(f.held, lambda e: e.key <> u.key)) AS every FROM f JOIN u ON u.user_id = f.user_id AND u.k = f.k + 1) x)
 SELECT f.user_id, hits, evicted, len(held) AS held, held[1].key AS newest FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k AND s.k = s.n"""


def _uses(spark: SparkSession, sf_dir: str, size) -> DataFrame:
    key = F.col("event_id") * 7 % 23
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", key.alias("key"), size(key).alias("size"))


@query(_cache_sql("1::BIGINT", 8))
def lru_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of eight pages a user: hits, and what the last use leaves."""
    return cache_use(_uses(spark, sf_dir, lambda key: F.lit(1).cast("long")), 8)


@query(_cache_sql("20 + event_id * 7 % 23 * 13 % 90", 300))
def lru_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of 300 bytes a user: pictures of several sizes, one of which always stays."""
    return cache_use(_uses(spark, sf_dir, lambda key: 20 + key * 13 % 90), 300)


@query("SELECT path, ts FROM (SELECT lower(p) AS key, max(ts) AS ts, arg_max(p, ts) AS path FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'Doc' ELSE 'DOC' END || user_id || '.pdf' AS p, ts FROM events) GROUP BY 1) ORDER BY ts DESC, key LIMIT 30")
def recents_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent files after three micro-batches in order of time, thirty at most (the feature's limit)."""
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 2 == 0, "Doc").otherwise("DOC"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("path"), "ts")
    cuts = e.agg(F.expr("percentile_approx(ts, array(0.33D, 0.66D))").alias("c")).first()["c"]
    kept = None
    for low, high in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        batch = e if low is None else e.where(F.col("ts") > F.lit(low))
        kept = upsert_recents(batch if high is None else batch.where(F.col("ts") <= F.lit(high)), kept)
    return kept


def upsert_recents(batch: DataFrame, kept: DataFrame | None, most: int = 30) -> DataFrame:
    """The newest ``most`` paths after a micro-batch; for ``foreachBatch``."""
    every = batch if kept is None else kept.unionByName(batch)
    newest = every.groupBy(F.lower("path").alias("key")).agg(F.max("ts").alias("ts"), F.max_by("path", "ts").alias("path"))
    return newest.orderBy(F.desc("ts"), "key").limit(most).select("path", "ts")


def forwarded(spark: SparkSession, folder: str) -> DataFrame:
    """Files that other instances ask to open, as a stream of JSON lines put into ``folder``; broken ones are passed over."""
    return spark.readStream.schema("path string, ts timestamp").option("mode", "DROPMALFORMED").json(folder).where("path is not null")
