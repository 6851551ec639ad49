"""Queries of tracks over frames, batch and stream, with their SQL. Events stand for frames: session user_id % 7, track user_id, frame event_id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import tracking
from facetflow.plans.analogues import table
from facetflow.plans.lifting_queries import rounded
from facetflow.session import shared_dir
from facetflow.sources import frames as frame_source
from facetflow.streaming import tracks


def frames(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 7).alias("session"), F.col("user_id").alias("obj"), F.col("event_id").alias("frame"), F.col("event_type").isin("view", "click").alias("matched"))


def _frames(spark, sf_dir):
    return frames(table(spark, sf_dir, "events"))


def _pairs(spark, sf_dir):
    """Overlaps (session, frame, trk, det, iou, score) from lineitem: an order is a frame."""
    return _overlaps(table(spark, sf_dir, "lineitem")).groupBy("session", "frame", "trk", "det").agg(F.max("iou").alias("iou"))


def _overlaps(line):
    return line.select((F.col("l_orderkey") % 5).alias("session"), F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 6).alias("trk"), (F.col("l_suppkey") % 6).alias("det"), (F.pmod(F.col("l_partkey") * 13 + F.col("l_suppkey") * 7, F.lit(101)) / 100.0).alias("iou"))


def _detections(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("session", "frame", "det").agg((F.pmod(F.first("frame") * 17 + F.col("det") * 29, F.lit(100)) / 100.0).alias("score"))


def _tracks(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("session", "frame", "trk").agg(F.pmod(F.first("frame") + F.col("trk"), F.lit(4)).alias("area"))


PAIRS_SQL = """WITH RECURSIVE pr AS (SELECT l_orderkey % 5 AS session, l_orderkey AS frame, l_partkey % 6 AS trk, l_suppkey % 6 AS det, max(((l_partkey * 13 + l_suppkey * 7) % 101) / 100.0::DOUBLE) AS iou FROM lineitem GROUP BY ALL),
de AS (SELECT DISTINCT session, frame, det, ((frame * 17 + det * 29) % 100) / 100.0::DOUBLE AS score FROM pr), tr AS (SELECT DISTINCT session, frame, trk, (frame + trk) % 4 AS area FROM pr)"""
FRAMES_SQL = "WITH f AS (SELECT user_id % 7 AS session, user_id AS obj, event_id AS frame, event_type IN ('view', 'click') AS matched FROM events)"
CONFIRM_SQL = FRAMES_SQL + """, m AS (SELECT *, sum((NOT matched)::INT) OVER (PARTITION BY session, obj ORDER BY frame) AS k FROM f),
r AS (SELECT *, sum(matched::INT) OVER (PARTITION BY session, obj, k ORDER BY frame)::INT AS run FROM m), c AS (SELECT session, obj, frame, matched, run, max(run) OVER (PARTITION BY session, obj ORDER BY frame) >= 3 AS confirmed FROM r)"""
ALIVE_SQL = FRAMES_SQL + """, l AS (SELECT session, obj, list(frame ORDER BY frame) AS fr, list_transform(list(matched ORDER BY frame), lambda x: CASE WHEN x THEN 1 ELSE -1 END) AS d FROM f GROUP BY ALL),
a AS (SELECT session, obj, fr, d, list_reduce(list_prepend([0], list_transform(d, lambda x: [x])), lambda acc, x: list_append(acc, greatest(-1, least(5, acc[len(acc)] + x[1])))) AS s FROM l),
k AS (SELECT session, obj, unnest(fr) AS frame, unnest(d) = 1 AS matched, unnest(s[2:])::INT AS alive FROM a)"""


def keep_alive(spark, sf_dir):
    return tracking.keep_alive(_frames(spark, sf_dir), 0, 5, -1)


def confirmation(spark, sf_dir):
    return tracking.confirmed(_frames(spark, sf_dir), 3)


def delayed(spark, sf_dir):
    return tracking.delayed(tracking.confirmed(_frames(spark, sf_dir), 3), 4).select("session", "obj", "frame", "shown")


def removals(spark, sf_dir):
    return tracking.removals(_frames(spark, sf_dir), 3, 2000)


def hidden_by_counter(spark, sf_dir):
    return tracking.hidden_by_counter(keep_alive(spark, sf_dir)).select("session", "obj", "frame")


def duplicates(spark, sf_dir):
    pairs = tracking.matches(_pairs(spark, sf_dir), 0.5).select("session", "frame", "det", F.col("trk").alias("obj"))
    return tracking.duplicates(pairs, pairs.groupBy("session", "obj").agg(F.min("frame").alias("first")), 3)


def _occluded(spark, sf_dir):
    return _frames(spark, sf_dir).withColumn("occluded", F.col("frame") % 5 == 0)


def last_occluded(spark, sf_dir):
    return tracking.last_occluded(_occluded(spark, sf_dir)).select("session", "obj", "frame", "last")


def hidden_by_overlap(spark, sf_dir):
    tr = _tracks(spark, sf_dir).select("session", F.col("trk").alias("obj"), "frame", (F.col("area") == 1).alias("occluded"))
    pairs = _tracks(spark, sf_dir).select("session", "frame", F.col("trk").alias("a")).join(_tracks(spark, sf_dir).select("session", "frame", F.col("trk").alias("b")), ["session", "frame"]).where("a < b").withColumn("iou", F.pmod(F.col("a") * 7 + F.col("b") * 3 + F.col("frame"), F.lit(10)) / 10)
    return tracking.hidden_by_overlap(pairs, tracking.last_occluded(tr), 0.7)


OVERLAP_SQL = PAIRS_SQL + """, oc AS (SELECT session, trk AS obj, frame, coalesce(max(CASE WHEN area = 1 THEN frame END) OVER (PARTITION BY session, trk ORDER BY frame), -1) AS last FROM tr),
ab AS (SELECT a.session, a.frame, a.obj AS a, b.obj AS b, a.last AS la, b.last AS lb FROM oc a JOIN oc b ON a.session = b.session AND a.frame = b.frame AND a.obj < b.obj WHERE ((a.obj * 7 + b.obj * 3 + a.frame) % 10) / 10 >= 0.7::DOUBLE)
SELECT DISTINCT session, frame, CASE WHEN la > lb THEN a ELSE b END AS obj FROM ab WHERE la > lb AND lb > -1 OR lb > la AND la > -1"""


def unmatched(spark, sf_dir):
    return tracking.unmatched_tracks(_tracks(spark, sf_dir), _pairs(spark, sf_dir), 0.5)


def new_detections(spark, sf_dir):
    return tracking.new_ids(tracking.capped(tracking.new_detections(_detections(spark, sf_dir), _pairs(spark, sf_dir), 0.3, 0.6), 2))


NEW_SQL = PAIRS_SQL + """, nd AS (SELECT * FROM de WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.session = de.session AND pr.frame = de.frame AND pr.det = de.det AND iou >= 0.6::DOUBLE)),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, frame ORDER BY score DESC, det) AS r FROM nd) WHERE r <= 2) SELECT session, frame, det, score, row_number() OVER (PARTITION BY session ORDER BY frame, det) - 1 AS obj FROM cp"""


def sure_pairs(spark, sf_dir):
    return tracking.sure_pairs(_detections(spark, sf_dir), _pairs(spark, sf_dir), 0.6, 0.6)


def assigned(spark, sf_dir):
    """Number and total IoU of each frame's best one-to-one assignment."""
    return rounded(tracking.assigned(_pairs(spark, sf_dir), 0.0).groupBy("session", "frame").agg(F.sum("iou").alias("total")), 6)


ASSIGN_SQL = PAIRS_SQL + """, w AS (SELECT session, frame, [trk] AS t, [det] AS d, iou AS total FROM pr UNION ALL SELECT w.session, w.frame, list_append(t, pr.trk), list_append(d, pr.det), total + iou FROM w JOIN pr ON pr.session = w.session AND pr.frame = w.frame AND pr.trk > t[len(t)] AND NOT list_contains(d, pr.det))
SELECT session, frame, round(max(total), 6) AS total FROM w GROUP BY ALL"""


def least_loaded(spark, sf_dir):
    loads = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("worker")).agg((F.sum("n_nationkey") % 7).alias("load")).withColumn("session", F.lit(0))
    return tracking.least_loaded(loads, 12)


def dense_index(spark, sf_dir):
    return tracking.dense_index(_frames(spark, sf_dir).where("obj % 3 <> 0"))


def _history(spark, sf_dir):
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("session"), F.col("event_id").alias("frame"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 100.0).alias("score"))
    return own.select("session", F.col("frame").alias("q")), own.where("frame % 11 = 0").select("session", "frame"), own


def closest_frames(spark, sf_dir):
    q, f, _ = _history(spark, sf_dir)
    return tracking.closest_frames(q, f, 4)


def scored_history(spark, sf_dir):
    q, _, own = _history(spark, sf_dir)
    return tracking.scored_history(q, own.where("frame % 3 = 0"), 5, 0.5)


def strided_history(spark, sf_dir):
    q, _, own = _history(spark, sf_dir)
    return tracking.strided_history(q, own.select("session", "frame"), 6, 3)


def evicted(spark, sf_dir):
    own = _frames(spark, sf_dir).select("session", "obj", "frame")
    return tracking.evicted(own, own.where("frame % 50 = 0").select("session", "obj", F.col("frame").alias("at")), 400)


def reconditioned(spark, sf_dir):
    return rounded(tracking.reconditioned(_pairs(spark, sf_dir).join(_detections(spark, sf_dir), ["session", "frame", "det"]), 4, 0.3, 0.5), 6)


def in_order(spark, sf_dir):
    return tracking.in_order(_frames(spark, sf_dir), 500, 40, reverse=True)


def _outputs(spark, sf_dir):
    own = _frames(spark, sf_dir)
    return own.select("session", "obj", "frame", F.when(F.col("frame") % 5 == 0, "cond").otherwise("non").alias("kind"), (F.col("frame") % 9).alias("area"))


def consolidated(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    temp = own.where("frame % 10 = 0").select("session", "obj", "frame", F.lit("temp").alias("kind"), (F.col("area") + 100).alias("area"))
    return tracking.consolidated(own.unionByName(temp), own.where("obj % 4 = 0"), own.where("frame % 25 = 0"))


def shown(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    return tracking.shown(own, own.where("obj % 10 = 0").select("session", "obj").distinct(), own.where("frame % 7 = 0").select("session", "obj", "frame"), own.where("frame < 20").select("session", "obj", "frame"))


def by_priority(spark, sf_dir):
    own = _outputs(spark, sf_dir).select("session", "obj", "frame", "area")
    return tracking.by_priority([own.where("frame % 2 = 0").withColumn("area", F.col("area") + 1000), own.where("frame % 3 = 0").withColumn("area", F.col("area") + 100), own], ["session", "obj", "frame"])


def action_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "propagate").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "refine").otherwise("add")
    return tracking.action_plan(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") % 9).alias("obj"))).select("session", "mode", F.array_join(F.col("objs").cast("array<string>"), ",").alias("objs"))


ACTIONS_SQL = """WITH a AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'propagate' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'refine' ELSE 'add' END AS type, event_id % 9 AS obj FROM events),
l AS (SELECT session, max(seq) FILTER (type = 'propagate') AS last FROM a GROUP BY ALL), s AS (SELECT a.session, any_value(last) AS last, count(*) FILTER (seq > coalesce(last, -1)) AS n, count(*) FILTER (seq > coalesce(last, -1) AND type = 'remove') AS gone, list_sort(list(DISTINCT obj) FILTER (seq > coalesce(last, -1) AND type IN ('add', 'refine'))) AS objs FROM a JOIN l USING (session) GROUP BY a.session),
m AS (SELECT *, CASE WHEN last IS NULL OR gone > 0 THEN 'full' WHEN n = 0 THEN 'fetch' ELSE 'partial' END AS mode FROM s) SELECT session, mode, CASE WHEN mode = 'partial' THEN coalesce(array_to_string(objs, ','), '') ELSE '' END AS objs FROM m"""


def prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "purchase", "mask").otherwise("points")
    return tracking.prompts(e.select((F.col("user_id") % 7).alias("session"), F.col("user_id").alias("obj"), F.lit(0).alias("frame"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_type") == "signup").alias("replace"), (F.col("event_id") % 3 + 1).alias("n")))


PROMPTS_SQL = """WITH i AS (SELECT user_id % 7 AS session, user_id AS obj, event_id AS seq, CASE event_type WHEN 'error' THEN 'clear' WHEN 'purchase' THEN 'mask' ELSE 'points' END AS kind, event_type = 'signup' AS rep, event_id % 3 + 1 AS n FROM events),
g AS (SELECT *, sum((rep OR kind <> coalesce(pk, ''))::INT) OVER (PARTITION BY session, obj ORDER BY seq) AS g FROM (SELECT *, lag(kind) OVER (PARTITION BY session, obj ORDER BY seq) AS pk FROM i))
SELECT session, obj, 0 AS frame, any_value(kind) AS kind, sum(n)::BIGINT AS n_points FROM g x WHERE g = (SELECT max(g) FROM g y WHERE y.session = x.session AND y.obj = x.obj) GROUP BY session, obj HAVING any_value(kind) <> 'clear'"""


def capped_points(spark, sf_dir):
    own = _frames(spark, sf_dir).select("session", "obj", F.lit(0).alias("frame"), F.col("frame").alias("seq"))
    return tracking.capped_points(own, 8)


def dense_records(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    return tracking.dense_records(own, own.where("obj % 8 = 0"), own.where("frame % 20 = 0")).select("session", "obj", F.array_join(F.col("areas").cast("array<string>"), ",").alias("areas"))


def _stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def tracking_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return tracks.run_once(tracks.tracked(frames(_stream(spark, sf_dir)), 0, 5, -1, 3), f"{shared_dir(spark)}/tracks-{uuid.uuid4().hex}")


def _boxes(line):
    """Detections from lineitem: an order is a frame, two hundred of them a session, a line a box that stays about its place."""
    x, y = F.col("l_linenumber") * 20 + F.col("l_partkey") % 12, F.col("l_suppkey") % 12
    return line.select(F.expr("l_orderkey div 200").alias("session"), F.col("l_orderkey").alias("frame"), F.timestamp_seconds(F.col("l_orderkey") + 1_000_000_000).alias("ts"), F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey").cast("long").alias("det"), (F.col("l_discount") * 10).alias("score"), *[c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + 30, "x1"), (y + 30, "y1"))])


def step_stream(spark, sf_dir):
    """Association, new ids, removal, expiry, confirmation and delayed output of detections as they come; a session's last frame is known from the table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ends = _boxes(table(spark, sf_dir, "lineitem")).groupBy("session").agg(F.max("frame").alias("end"))
    rows = _boxes(_stream(spark, sf_dir, "lineitem")).join(ends, "session")
    return tracks.run_once(tracks.stepped(rows, tracks.Rules(score=0.3, most=6)), f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}")


#: The same rules, frame by frame, with a session's tracks as one list.
STEP_SQL = """
WITH RECURSIVE bx AS (SELECT l_orderkey // 200 AS session, l_orderkey AS frame, (l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey)::BIGINT AS det, l_discount * 10 AS score, (l_linenumber * 20 + l_partkey % 12)::DOUBLE AS x0, (l_suppkey % 12)::DOUBLE AS y0 FROM lineitem),
fr AS (SELECT session, frame, list({'det': det, 'score': score, 'x0': x0, 'y0': y0} ORDER BY det) AS ds, row_number() OVER (PARTITION BY session ORDER BY frame) AS k FROM bx GROUP BY session, frame),
st AS (SELECT session, 0::BIGINT AS k, 0::BIGINT AS frame, 1::BIGINT AS nxt, []::STRUCT(obj BIGINT, x0 DOUBLE, y0 DOUBLE, fst BIGINT, misses INT, alive INT, run INT, sure BOOLEAN, gone INT, mates BIGINT[])[] AS ts FROM (SELECT DISTINCT session FROM fr)
UNION ALL SELECT session, k, frame, nxt + len(fresh), list_concat(moved, list_transform(fresh, lambda d, i: {'obj': nxt + i - 1, 'x0': d.x0, 'y0': d.y0, 'fst': frame, 'misses': 0, 'alive': 0, 'run': 1, 'sure': false, 'gone': 0, 'mates': []::BIGINT[]})) FROM (
  SELECT session, k, frame, nxt, list_transform(t2, lambda t: {'obj': t.obj, 'x0': t.x0, 'y0': t.y0, 'fst': t.fst, 'misses': t.misses, 'alive': t.alive, 'run': t.run, 'sure': t.sure,
      'gone': CASE WHEN frame - t.fst < 15 AND (len(list_filter(t.mates, lambda m: len(list_filter(t.mates, lambda q: q = m)) >= 3)) > 0 OR (t.run = 0 AND t.misses >= 3)) THEN 1 WHEN t.run = 0 AND t.alive <= -4 THEN 2 ELSE 0 END, 'mates': t.mates}) AS moved,
    list_sort(list_transform(list_sort(list_transform(fresh0, lambda d: {'s': -d.score, 'det': d.det, 'd': d}))[:greatest(0, 6 - len(live))], lambda e: {'det': e.det, 'x0': e.d.x0, 'y0': e.d.y0})) AS fresh FROM (
    SELECT *, list_transform(hit, lambda h: CASE WHEN len(h.ds) > 0
        THEN {'obj': h.t.obj, 'x0': h.ds[1].x0, 'y0': h.ds[1].y0, 'fst': h.t.fst, 'misses': h.t.misses, 'alive': least(h.t.alive + 1, 8), 'run': h.t.run + 1, 'sure': h.t.sure OR h.t.run + 1 >= 3, 'gone': 0, 'mates': list_concat(h.t.mates, h.elders)}
        ELSE {'obj': h.t.obj, 'x0': h.t.x0, 'y0': h.t.y0, 'fst': h.t.fst, 'misses': h.t.misses + 1, 'alive': greatest(h.t.alive - 1, -4), 'run': 0, 'sure': h.t.sure, 'gone': 0, 'mates': h.t.mates} END) AS t2,
      list_filter(ds, lambda d: d.score >= 0.3::DOUBLE AND len(list_filter(pairs, lambda p: p.det = d.det)) = 0) AS fresh0 FROM (
      SELECT *, list_transform(live, lambda t: {'t': t, 'ds': list_sort(list_transform(list_filter(pairs, lambda p: p.obj = t.obj), lambda p: {'o': -p.iou, 'det': p.det, 'x0': p.x0, 'y0': p.y0})),
          'elders': list_filter(list_transform(list_filter(pairs, lambda p: p.obj = t.obj), lambda p: list_sort(list_transform(list_filter(pairs, lambda q: q.det = p.det), lambda q: {'f': q.fst, 'o': q.obj}))[1].o), lambda e: e <> t.obj)}) AS hit FROM (
        SELECT session, k, frame, nxt, ds, live, list_filter(flatten(list_transform(live, lambda t: list_transform(ds, lambda d: {'obj': t.obj, 'fst': t.fst, 'det': d.det, 'x0': d.x0, 'y0': d.y0,
            'iou': (greatest(30 - abs(t.x0 - d.x0), 0) * greatest(30 - abs(t.y0 - d.y0), 0)) / (1800 - greatest(30 - abs(t.x0 - d.x0), 0) * greatest(30 - abs(t.y0 - d.y0), 0))}))), lambda p: p.iou >= 0.5) AS pairs FROM (
          SELECT fr.session, fr.k, fr.frame, nxt, ds, list_filter(ts, lambda t: t.gone = 0) AS live FROM st JOIN fr ON fr.session = st.session AND fr.k = st.k + 1)))))),
tr AS (SELECT session, k, frame, unnest(ts) AS t FROM st WHERE k > 0),
o AS (SELECT session, k, frame, t.obj AS obj, t.run AS run, t.alive <= 0 AND t.run = 0 AS hidden, t.sure AS sure, t.gone AS gone FROM tr),
fate AS (SELECT session, obj, min(CASE WHEN sure THEN k END) AS sure_at, min(CASE WHEN gone = 1 THEN k END) AS removed_at FROM o GROUP BY ALL), last AS (SELECT session, max(k) AS n FROM fr GROUP BY ALL)
SELECT fr.session, fr.frame, o.obj, o.run::INT AS run, o.hidden, CASE WHEN o.obj IS NOT NULL THEN coalesce(sure_at <= least(fr.k + 3, n), false) AND NOT coalesce(removed_at <= least(fr.k + 3, n), false) END AS shown, false AS late
FROM fr JOIN last USING (session) LEFT JOIN (SELECT * FROM o WHERE gone = 0) o ON o.session = fr.session AND o.k = fr.k LEFT JOIN fate ON fate.session = o.session AND fate.obj = o.obj"""


def frame_stream(spark, sf_dir):
    """Pages written as frames' files, five folders, read as a stream of frames."""
    folder = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("session"), F.col("page_id").alias("frame"), F.encode("html", "UTF-8").alias("content"))
    frame_source.write_frames(pages, f"{folder}/in")
    frame_source.register(spark)
    stream = spark.readStream.format("frames").option("framesPerSecond", 4).load(f"{folder}/in")
    rows = tracks.run_once(stream.select(F.col("session").cast("int").alias("session"), "frame", (F.unix_micros("ts") / 1e6).alias("second"), F.md5("content").alias("digest")), folder)
    return rows


def session_stream(spark, sf_dir):
    """Sessions that the watermark has closed; the last ones of the stream stay open."""
    events = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = tracks.run_once(tracks.per_session(events), f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}")
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


SESSION_SQL = """WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
g AS (SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS last, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(first) AS "start", epoch_us(last) AS "end", n FROM g WHERE last <= (SELECT max(ts::TIMESTAMP) - INTERVAL 1 HOUR FROM events)"""


QUERIES = {
    "keep_alive": keep_alive, "confirmation": confirmation, "delayed_emit": delayed, "early_removals": removals, "hidden_by_counter": hidden_by_counter, "duplicate_tracks": duplicates, "last_occluded": last_occluded, "hidden_by_overlap": hidden_by_overlap,
    "matched_pairs": lambda s, d: rounded(tracking.matches(_pairs(s, d), 0.5), 6), "unmatched_tracks": unmatched, "new_detections": new_detections, "sure_pairs": sure_pairs, "optimal_assignment": assigned, "least_loaded": least_loaded, "dense_index": dense_index,
    "closest_frames": closest_frames, "scored_history": scored_history, "strided_history": strided_history, "evicted_outputs": evicted, "reconditioned": reconditioned, "frames_in_order": in_order, "consolidated": consolidated, "shown_outputs": shown, "result_priority": by_priority,
    "action_plan": action_plan, "prompt_state": prompts, "capped_points": capped_points, "dense_records": dense_records, "frame_shards": lambda s, d: _frames(s, d).groupBy(tracking.shard(F.col("frame"), 4).alias("worker")).agg(F.count("*").alias("n")), "tracking_stream": tracking_stream, "step_stream": step_stream, "frame_stream": frame_stream, "session_stream": session_stream,
}
OUT_SQL = FRAMES_SQL + ", o AS (SELECT session, obj, frame, CASE WHEN frame % 5 = 0 THEN 'cond' ELSE 'non' END AS kind, frame % 9 AS area FROM f)"
HISTORY_SQL = "WITH h AS (SELECT user_id % 7 AS session, event_id AS frame, ((event_id * 37) % 100) / 100.0::DOUBLE AS score FROM events), q AS (SELECT session, frame AS q FROM h)"
ORACLES = {
    "session_stream": SESSION_SQL, "step_stream": STEP_SQL, "frame_stream": "SELECT (page_id % 5)::INT AS session, page_id AS frame, page_id / 4.0::DOUBLE AS second, md5(html) AS digest FROM pages",
    "keep_alive": ALIVE_SQL + " SELECT * FROM k", "hidden_by_counter": ALIVE_SQL + " SELECT session, obj, frame FROM k WHERE alive <= 0", "confirmation": CONFIRM_SQL + " SELECT * FROM c",
    "delayed_emit": CONFIRM_SQL + " SELECT session, obj, frame, coalesce(lead(confirmed, 3) OVER (PARTITION BY session, obj ORDER BY frame), last_value(confirmed) OVER (PARTITION BY session, obj ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS shown FROM c",
    "early_removals": FRAMES_SQL + ", m AS (SELECT *, min(frame) OVER (PARTITION BY session, obj) AS first, sum((NOT matched)::INT) OVER (PARTITION BY session, obj ORDER BY frame) AS misses FROM f) SELECT session, obj, min(frame) AS frame FROM m WHERE misses >= 3 AND frame - first < 2000 GROUP BY ALL",
    "duplicate_tracks": PAIRS_SQL + ", p AS (SELECT session, frame, det, trk AS obj FROM pr WHERE iou >= 0.5), t AS (SELECT session, obj, min(frame) AS first FROM p GROUP BY ALL), o AS (SELECT p.*, first, first_value(p.obj) OVER (PARTITION BY p.session, p.frame, p.det ORDER BY first, p.obj) AS first_obj FROM p JOIN t USING (session, obj)) SELECT session, obj, first_obj, count(*) AS frames FROM o WHERE obj <> first_obj GROUP BY ALL HAVING count(*) >= 3",
    "last_occluded": FRAMES_SQL + " SELECT session, obj, frame, coalesce(max(CASE WHEN frame % 5 = 0 THEN frame END) OVER (PARTITION BY session, obj ORDER BY frame), -1) AS last FROM f",
    "hidden_by_overlap": OVERLAP_SQL, "matched_pairs": PAIRS_SQL + " SELECT session, frame, trk, det, round(iou, 6) AS iou FROM pr WHERE iou >= 0.5",
    "unmatched_tracks": PAIRS_SQL + " SELECT session, frame, trk FROM tr WHERE area > 0 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.session = tr.session AND pr.frame = tr.frame AND pr.trk = tr.trk AND iou >= 0.5)",
    "new_detections": NEW_SQL,
    "sure_pairs": PAIRS_SQL + " SELECT session, frame, trk, det FROM (SELECT pr.*, row_number() OVER (PARTITION BY pr.session, pr.frame, trk ORDER BY iou DESC, pr.det) AS r FROM pr JOIN de ON de.session = pr.session AND de.frame = pr.frame AND de.det = pr.det WHERE iou >= 0.6::DOUBLE AND score >= 0.6::DOUBLE) WHERE r = 1",
    "optimal_assignment": ASSIGN_SQL,
    "least_loaded": "WITH l AS (SELECT n_regionkey AS worker, sum(n_nationkey) % 7 AS load FROM nation GROUP BY ALL) SELECT 0 AS session, (row_number() OVER (ORDER BY load + k, worker) - 1)::INT AS item, worker FROM l, range(12) t(k) QUALIFY item < 12",
    "dense_index": FRAMES_SQL + " SELECT session, obj, (row_number() OVER (PARTITION BY session ORDER BY obj) - 1)::INT AS idx FROM (SELECT DISTINCT session, obj FROM f WHERE obj % 3 <> 0)",
    "closest_frames": HISTORY_SQL + ", c AS (SELECT q.session, q, frame, abs(frame - q) AS d, frame < q AS b FROM q JOIN h USING (session) WHERE frame % 11 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY session, q, b ORDER BY d) = 1 AS near FROM c) SELECT session, q, frame FROM (SELECT *, row_number() OVER (PARTITION BY session, q ORDER BY near DESC, d, frame) AS r FROM n) WHERE r <= 4",
    "scored_history": HISTORY_SQL + " SELECT session, q, frame FROM (SELECT q.session, q, frame, row_number() OVER (PARTITION BY q.session, q ORDER BY frame DESC) AS r FROM q JOIN h USING (session) WHERE frame % 3 = 0 AND frame < q AND (score > 0.5 OR frame = q - 1)) WHERE r <= 5",
    "strided_history": HISTORY_SQL + ", w AS (SELECT session, q, q - 1 AS frame FROM q UNION SELECT session, q, (floor((q - 2) / 3)::BIGINT - (i - 1)) * 3 FROM q, range(1, 6) t(i)) SELECT session, q, frame FROM w WHERE EXISTS (SELECT 1 FROM h WHERE h.session = w.session AND h.frame = w.frame)",
    "evicted_outputs": FRAMES_SQL + " SELECT session, obj, frame FROM f WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.session = f.session AND c.obj = f.obj AND c.frame % 50 = 0 AND abs(c.frame - f.frame) <= 400)",
    "reconditioned": PAIRS_SQL + " SELECT pr.session, pr.frame, trk, pr.det, round(iou, 6) AS iou, score FROM pr JOIN de ON de.session = pr.session AND de.frame = pr.frame AND de.det = pr.det WHERE score >= 0.5 AND (pr.frame % 4 = 0 OR iou < 0.3::DOUBLE)",
    "frames_in_order": FRAMES_SQL + " SELECT session, frame, step::INT AS step FROM (SELECT session, frame, row_number() OVER (PARTITION BY session ORDER BY frame DESC) - 1 AS step FROM (SELECT DISTINCT session, frame FROM f WHERE frame <= 500)) WHERE step <= 40",
    "consolidated": OUT_SQL + ", u AS (SELECT * FROM o UNION ALL SELECT session, obj, frame, 'temp', area + 100 FROM o WHERE frame % 10 = 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, obj, frame ORDER BY CASE kind WHEN 'temp' THEN 0 WHEN 'cond' THEN 1 ELSE 2 END) AS r FROM u) WHERE r = 1), gr AS (SELECT a.session, frame, obj FROM (SELECT DISTINCT session, obj FROM o WHERE obj % 4 = 0) a JOIN (SELECT DISTINCT session, frame FROM o WHERE frame % 25 = 0) c USING (session)) SELECT gr.session, gr.frame, gr.obj, coalesce(kind, 'absent') AS kind, coalesce(area, 0) AS area FROM gr LEFT JOIN b ON b.session = gr.session AND b.frame = gr.frame AND b.obj = gr.obj",
    "shown_outputs": OUT_SQL + " SELECT * FROM o WHERE area > 0 AND obj % 10 <> 0 AND frame % 7 <> 0 AND frame >= 20",
    "result_priority": OUT_SQL + " SELECT session, obj, frame, area + CASE WHEN frame % 2 = 0 THEN 1000 WHEN frame % 3 = 0 THEN 100 ELSE 0 END AS area FROM o",
    "action_plan": ACTIONS_SQL, "prompt_state": PROMPTS_SQL,
    "capped_points": FRAMES_SQL + " SELECT session, obj, 0 AS frame, frame AS seq FROM (SELECT *, row_number() OVER (PARTITION BY session, obj ORDER BY frame) AS r, count(*) OVER (PARTITION BY session, obj) AS n FROM f) WHERE n <= 8 OR r <= 4 OR r > n - 4",
    "dense_records": OUT_SQL + ", gr AS (SELECT a.session, frame, obj FROM (SELECT DISTINCT session, obj FROM o WHERE obj % 8 = 0) a JOIN (SELECT DISTINCT session, frame FROM o WHERE frame % 20 = 0) c USING (session)) SELECT gr.session, gr.obj, string_agg(coalesce(area, 0)::VARCHAR, ',' ORDER BY gr.frame) AS areas FROM gr LEFT JOIN o ON o.session = gr.session AND o.frame = gr.frame AND o.obj = gr.obj GROUP BY gr.session, gr.obj",
    "frame_shards": "SELECT (event_id % 4)::INT AS worker, count(*) AS n FROM events GROUP BY ALL",
    "tracking_stream": ALIVE_SQL.replace("WITH f", "WITH RECURSIVE f") + ", m AS (SELECT *, sum((NOT matched)::INT) OVER (PARTITION BY session, obj ORDER BY frame) AS g FROM f), r AS (SELECT *, sum(matched::INT) OVER (PARTITION BY session, obj, g ORDER BY frame)::INT AS run FROM m) SELECT k.session, k.obj, k.frame, alive, run, max(run) OVER (PARTITION BY k.session, k.obj ORDER BY k.frame) >= 3 AS confirmed FROM k JOIN r ON r.session = k.session AND r.obj = k.obj AND r.frame = k.frame",
}
