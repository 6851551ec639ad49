"""Tracks over frames as batch queries: association, counters, removal, confirmation, delays, history, prompts.

Rows carry the session columns `by`; windows and groups are within a session and mostly within a track.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.session import cut

BY = ("session",)
BLOCK = 1000  # frames that an object meets at once


# --- association ----------------------------------------------------------------------------------

def matches(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (by, frame, trk, det, iou) of an IoU of at least `least`; many tracks may share a detection."""
    return pairs.where(F.col("iou") >= least)


def unmatched_tracks(tracks: DataFrame, pairs: DataFrame, least: float, by=BY) -> DataFrame:
    """(by, frame, trk) of tracks (.., area) that are not empty and match nothing."""
    return tracks.where("area > 0").join(matches(pairs, least), [*by, "frame", "trk"], "left_anti").select(*by, "frame", "trk")


def new_detections(detections: DataFrame, pairs: DataFrame, least_score: float, least: float, by=BY) -> DataFrame:
    """(by, frame, det, score) of detections of at least this score that overlap no track by `least`."""
    return detections.where(F.col("score") >= least_score).join(matches(pairs, least), [*by, "frame", "det"], "left_anti").select(*by, "frame", "det", "score")


def sure_pairs(detections: DataFrame, pairs: DataFrame, least_score: float = 0.8, least: float = 0.8, by=BY) -> DataFrame:
    """Pairs of a high score and a high IoU, each track's best detection (ties: the smaller)."""
    own = matches(pairs, least).join(detections.where(F.col("score") >= least_score), [*by, "frame", "det"])
    return own.groupBy(*by, "frame", "trk").agg(F.max_by("det", F.struct("iou", -F.col("det"))).alias("det"))


def _assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """Rows and columns of a cheapest one-to-one assignment, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return [(b, a) for a, b in _assigned(cost.T)]
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, column, far = start, -1, 0.0
        while True:
            step = far + cost[row] - row_price[row] - column_price
            better = ~done & (step < reach)
            reach[better], before[better] = step[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            far, done[column] = reach[column], True
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[start] += far
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += far - reach[j]
            column_price[j] -= far - reach[j]
        while column >= 0:
            last = before[column]
            owner[column] = owner[last] if last >= 0 else start
            column = last
    return [(int(r), j) for j, r in enumerate(owner) if r >= 0]


def assigned(pairs: DataFrame, least: float, by=BY) -> DataFrame:
    """(by, frame, trk, det, iou): a one-to-one assignment of greatest total IoU, then those of at least `least`; of pairs without overlap as many as others leave room for. A frame's pairs are one array."""

    @F.pandas_udf("array<int>")
    def chosen(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Places of the chosen pairs in a frame's array."""
        for part in parts:
            out = []
            for rows in part:
                tracks, dets = sorted({r["trk"] for r in rows}), sorted({r["det"] for r in rows})
                cost, place = np.ones((len(tracks), len(dets))), {}
                for i, r in enumerate(rows):
                    a, b = tracks.index(r["trk"]), dets.index(r["det"])
                    if 1 - r["iou"] <= cost[a, b]:
                        cost[a, b], place[a, b] = 1 - r["iou"], i
                own = [at for at in _assigned(cost) if at in place]
                # tracks and detections left over may have pairs without overlap, which cost as much as none: as many of these as can be
                left = sorted(at for at in place if at[0] not in {a for a, _ in own} and at[1] not in {b for _, b in own})
                if left:
                    at_row, at_column = sorted({a for a, _ in left}), sorted({b for _, b in left})
                    none = np.ones((len(at_row), len(at_column)))
                    for a, b in left:
                        none[at_row.index(a), at_column.index(b)] = 0
                    own += [(at_row[a], at_column[b]) for a, b in _assigned(none) if not none[a, b]]
                out.append([place[at] for at in own])
            yield pd.Series(out)

    rows = pairs.groupBy(*by, "frame").agg(F.array_sort(F.collect_list(F.struct("trk", "det", F.col("iou").cast("double").alias("iou")))).alias("rows"))
    picked = rows.withColumn("at", F.explode(chosen("rows"))).withColumn("r", F.get("rows", F.col("at")))
    return picked.select(*by, "frame", "r.trk", "r.det", "r.iou").where(F.col("iou") >= least)


# --- counters and statuses of a track: frames (by, obj, frame, matched) ---------------------------

def keep_alive(frames: DataFrame, start: int, most: int, least: int, chunk: int = 256, by=BY) -> DataFrame:
    """frames with alive: a counter from `start`, up by one on a match to `most`, down by one on a miss to `least`.

    Add-and-clamp steps compose to one such step (shift, low, high). A track's frames are cut into chunks of bounded size; the steps of
    chunks give each chunk's first value, from which its frames are counted. least <= start <= most.
    """
    keys = [*by, "obj"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    rows = frames.select(*keys, "frame", "matched", F.floor(place / chunk).alias("chunk")).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("frame", "matched"))).alias("all"))
    up, clamp = "IF(r.matched, 1, -1)", lambda v: f"greatest({least}, least({most}, {v}))"
    step = f"named_struct('shift', f.shift + {up}, 'low', {clamp(f'f.low + {up}')}, 'high', {clamp(f'f.high + {up}')})"
    rows = cut(rows.withColumn("f", F.expr(f"aggregate(all, named_struct('shift', 0, 'low', {least}, 'high', {most}), (f, r) -> {step})")))
    steps = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("steps"))
    after = "least(s.f.high, greatest(s.f.low, element_at(done, -1) + s.f.shift))"
    firsts = steps.select(*keys, "steps", F.expr(f"aggregate(steps, array({start}), (done, s) -> concat(done, array({after})))").alias("first"))
    firsts = firsts.select(*keys, F.posexplode("steps").alias("i", "s"), "first").select(*keys, F.col("s.chunk").alias("chunk"), F.get("first", F.col("i")).alias("first"))
    last = "element_at(done, -1).alive"
    fold = F.expr(
        f"slice(aggregate(all, array(named_struct('frame', cast(null as bigint), 'matched', false, 'alive', first)), (done, r) -> concat(done, array(named_struct('frame', cast(r.frame as bigint), 'matched', r.matched, 'alive', {clamp(f'{last} + {up}')})))), 2, size(all))"
    )
    return rows.join(firsts, [*keys, "chunk"]).select(*keys, F.explode(fold).alias("r")).select(*keys, "r.frame", "r.matched", "r.alive")


def confirmed(frames: DataFrame, needed: int, by=BY) -> DataFrame:
    """frames with run (matches in a row) and confirmed (whether run has ever reached `needed`)."""
    w = Window.partitionBy(*by, "obj").orderBy("frame")
    own = frames.withColumn("_misses", F.sum(F.when(F.col("matched"), 0).otherwise(1)).over(w))
    island = Window.partitionBy(*by, "obj", "_misses").orderBy("frame")
    own = own.withColumn("run", F.sum(F.col("matched").cast("int")).over(island).cast("int"))
    return own.withColumn("confirmed", F.max(F.col("run") >= needed).over(w)).drop("_misses")


def removals(frames: DataFrame, needed: int, delay: int, by=BY) -> DataFrame:
    """(by, obj, frame): the first frame at which a track has missed `needed` frames while first seen less than `delay` frames ago."""
    w = Window.partitionBy(*by, "obj").orderBy("frame")
    own = frames.withColumn("first", F.min("frame").over(Window.partitionBy(*by, "obj"))).withColumn("misses", F.sum(F.when(F.col("matched"), 0).otherwise(1)).over(w))
    return own.where((F.col("misses") >= needed) & (F.col("frame") - F.col("first") < delay)).groupBy(*by, "obj").agg(F.min("frame").alias("frame"))


def hidden_by_counter(alive: DataFrame) -> DataFrame:
    """Frames at which a track is suppressed, as its counter is used up."""
    return alive.where("alive <= 0")


def duplicates(pairs: DataFrame, tracks: DataFrame, needed: int, by=BY) -> DataFrame:
    """(by, obj, first_obj, frames): tracks that shared a detection with an earlier one (by first frame, then id) in at least `needed` frames; pairs (by, frame, det, obj), tracks (by, obj, first)."""
    own = pairs.join(tracks, [*by, "obj"])
    oldest = own.groupBy(*by, "frame", "det").agg(F.min(F.struct("first", "obj")).alias("o"))
    shared = own.join(oldest, [*by, "frame", "det"]).where(F.col("obj") != F.col("o.obj"))
    return shared.groupBy(*by, "obj", F.col("o.obj").alias("first_obj")).agg(F.count("*").alias("frames")).where(F.col("frames") >= needed)


def delayed(frames: DataFrame, look_ahead: int, by=BY) -> DataFrame:
    """frames (.., confirmed) with shown: the status look_ahead - 1 frames later, or the last one there is."""
    w = Window.partitionBy(*by, "obj").orderBy("frame")
    last = F.last("confirmed").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn("shown", F.coalesce(F.lead("confirmed", look_ahead - 1).over(w), last))


def last_occluded(frames: DataFrame, by=BY) -> DataFrame:
    """frames (.., occluded) with last: the latest frame up to now at which the track was occluded, -1 if never."""
    w = Window.partitionBy(*by, "obj").orderBy("frame")
    return frames.withColumn("last", F.coalesce(F.last(F.when(F.col("occluded"), F.col("frame")), ignorenulls=True).over(w), F.lit(-1)))


def hidden_by_overlap(pairs: DataFrame, occluded: DataFrame, least: float, by=BY) -> DataFrame:
    """(by, frame, obj): of two tracks (a < b) that overlap, the more recently occluded one, if the other was ever occluded; occluded (by, obj, frame, last)."""
    a, b = [occluded.select(*by, "frame", F.col("obj").alias(c), F.col("last").alias(f"last_{c}")) for c in "ab"]
    own = matches(pairs, least).join(a, [*by, "frame", "a"]).join(b, [*by, "frame", "b"])
    out = F.when((F.col("last_a") > F.col("last_b")) & (F.col("last_b") > -1), F.col("a")).when((F.col("last_b") > F.col("last_a")) & (F.col("last_a") > -1), F.col("b"))
    return own.select(*by, "frame", out.alias("obj")).where(F.col("obj").isNotNull()).distinct()


# --- ids and capacity -----------------------------------------------------------------------------

def capped(detections: DataFrame, room: int, by=BY) -> DataFrame:
    """Of each frame's new detections the `room` of highest score (ties: the smaller)."""
    order = Window.partitionBy(*by, "frame").orderBy(F.desc("score"), "det")
    return detections.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= room).drop("_r")


def new_ids(detections: DataFrame, by=BY) -> DataFrame:
    """detections with obj: numbers in order of frame and detection, never used again; first numbers of a frame follow those of all frames before."""
    sizes = detections.groupBy(*by, "frame").count()
    before = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "frame", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*by, "frame").orderBy("det")) - 1
    return detections.join(offsets, [*by, "frame"]).withColumn("obj", F.col("offset") + rank).drop("offset")


def least_loaded(loads: DataFrame, items: int, by=BY) -> DataFrame:
    """(by, item, worker): items 0, 1, ... in order, each to the worker with fewest so far (ties: the lowest), given loads (by, worker, load).

    A worker's k-th new item comes when all have load + k, so sorting those places gives the same as dealing one by one.
    """
    places = loads.select(*by, "worker", "load", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("k"))
    order = Window.partitionBy(*by).orderBy(F.col("load") + F.col("k"), "worker")
    return places.withColumn("item", F.row_number().over(order) - 1).where(F.col("item") < items).select(*by, "item", "worker")


def running_count(rows: DataFrame, keys: list[str], order: list[Column], counted: Column, name: str) -> DataFrame:
    """rows with `name`: how many counted rows of its keys come before and with it in the order, which tells all rows apart.

    Rows are dealt out by range, so that a key's spread over tasks; of each range only its sum meets others.
    """
    parts = cut(rows.withColumn("_one", counted.cast("long")).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_one").alias("_sum")).select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn(name, F.sum("_one").over(within))
    return own.join(sums, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_one", "_part", "_before")


def dense_index(objects: DataFrame, by=BY) -> DataFrame:
    """(by, obj, idx): live objects numbered in order of id; removing one closes the gap."""
    return running_count(objects.select(*by, "obj").distinct(), list(by), [F.col("obj")], F.lit(1), "n").select(*by, "obj", (F.col("n") - 1).cast("int").alias("idx"))


# --- history --------------------------------------------------------------------------------------

def _numbered(queries: DataFrame, frames: DataFrame, by) -> tuple[DataFrame, DataFrame]:
    """(queries (by, q, r): how many frames of its session come before q; frames (by, frame, i): numbered from 1)."""
    rows = queries.select(*by, F.col("q").alias("at"), F.lit(0).alias("is_frame")).distinct().unionByName(frames.select(*by, F.col("frame").alias("at"), F.lit(1).alias("is_frame")).distinct())
    rows = running_count(rows, list(by), [F.col("at"), F.col("is_frame")], F.col("is_frame"), "n")
    return rows.where("is_frame = 0").select(*by, F.col("at").alias("q"), F.col("n").alias("r")), rows.where("is_frame = 1").select(*by, F.col("at").alias("frame"), F.col("n").alias("i"))


def closest_frames(queries: DataFrame, frames: DataFrame, k: int, by=BY) -> DataFrame:
    """(by, q, frame): k conditioning frames nearest to q: the closest before, the closest at or after, then by distance (ties: the earlier).

    Only the k frames on either side of q can be among them; they are found by their numbers in the session's order.
    """
    asked, own = _numbered(queries, frames, by)
    own = asked.withColumn("i", F.explode(F.sequence(F.col("r") - k + 1, F.col("r") + k))).join(own, [*by, "i"]).withColumn("d", F.abs(F.col("frame") - F.col("q")))
    near = F.col("i").isin(F.col("r"), F.col("r") + 1).cast("int")
    order = Window.partitionBy(*by, "q").orderBy(F.desc(near), "d", "frame")
    return own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*by, "q", "frame")


def strided_history(queries: DataFrame, frames: DataFrame, k: int, stride: int, by=BY) -> DataFrame:
    """(by, q, frame): the frame before q, then those of the stride's multiples before that, k in all."""
    wanted = F.concat(F.array(F.col("q") - 1), F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: (F.floor((F.col("q") - 2) / stride) - (i - 1)) * stride)) if k > 1 else F.array(F.col("q") - 1)
    return queries.select(*by, "q", F.explode(F.array_distinct(wanted)).alias("frame")).join(frames, [*by, "frame"], "left_semi").select(*by, "q", "frame")


def scored_history(queries: DataFrame, frames: DataFrame, k: int, least: float, by=BY) -> DataFrame:
    """(by, q, frame): the last k frames before q of a score above `least`; the one just before always."""
    asked, own = _numbered(queries, frames.where(F.col("score") > least), by)
    good = asked.withColumn("i", F.explode(F.sequence(F.col("r") - k + 1, F.col("r")))).join(own, [*by, "i"]).select(*by, "q", "frame")
    just = queries.select(*by, "q", (F.col("q") - 1).alias("frame")).join(frames, [*by, "frame"], "left_semi")
    order = Window.partitionBy(*by, "q").orderBy(F.desc("frame"))
    return good.unionByName(just).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*by, "q", "frame")


def evicted(outputs: DataFrame, corrections: DataFrame, reach: int, by=BY) -> DataFrame:
    """outputs (by, obj, frame, ..) without those within `reach` frames of a correction (by, obj, at) of the same object: of the last one before and the next one after."""
    keys = [*by, "obj"]
    rows = outputs.select(*keys, "frame", F.lit(False).alias("fix"), F.struct(*outputs.columns).alias("row"))
    both = rows.unionByName(corrections.select(*keys, F.col("at").alias("frame"), F.lit(True).alias("fix")).distinct(), allowMissingColumns=True)
    at, w = F.when(F.col("fix"), F.col("frame")), Window.partitionBy(*keys).orderBy("frame")
    before, after = F.max(at).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(at).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = (F.col("frame") - F.col("before") <= reach) | (F.col("after") - F.col("frame") <= reach)
    return both.withColumns({"before": before, "after": after}).where(~F.col("fix") & ~F.coalesce(near, F.lit(False))).select("row.*")


def reconditioned(pairs: DataFrame, every: int, least_iou: float, least_score: float) -> DataFrame:
    """Matched pairs (.., frame, iou, score) at which a track is conditioned anew: each `every` frames, or where boxes drift apart under a good score."""
    return pairs.where((F.col("score") >= least_score) & ((F.col("frame") % every == 0) | (F.col("iou") < least_iou)))


def in_order(frames: DataFrame, start: int, count: int | None, reverse: bool, by=BY) -> DataFrame:
    """(by, frame, step): frames from `start` on, forward or in reverse, at most count + 1."""
    own = frames.where(F.col("frame") <= start if reverse else F.col("frame") >= start)
    own = running_count(own.select(*by, "frame").distinct(), list(by), [F.desc("frame") if reverse else F.asc("frame")], F.lit(1), "n").select(*by, "frame", (F.col("n") - 1).cast("int").alias("step"))
    return own if count is None else own.where(F.col("step") <= count)


# --- results and prompts --------------------------------------------------------------------------

def by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key, of the first part that has it: overrides before new before kept results."""
    rows = None
    for i, p in enumerate(parts):
        own = p.withColumn("_p", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in (*keys, "_p")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct("_p", *values)).alias("r")).select(*keys, "r.*")


def _places(frames: DataFrame, by) -> DataFrame:
    """(by, frame, _at): a session's frames numbered from 1."""
    return running_count(frames.select(*by, "frame").distinct(), list(by), [F.col("frame")], F.lit(1), "_at")


def _partitions(rows: DataFrame) -> int:
    """Partitions of what grows once it is dealt out, so that its size before tells nothing."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def consolidated(outputs: DataFrame, objects: DataFrame, frames: DataFrame, by=BY) -> DataFrame:
    """(by, frame, obj, kind, area): each object's temporary, else conditioning, else other result at a frame, else absent with area 0; outputs (.., kind) of temp, cond, non."""
    order = F.when(F.col("kind") == "temp", 0).when(F.col("kind") == "cond", 1).otherwise(2)
    wanted, places = objects.select(*by, "obj").distinct(), _places(frames, by).withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK).cast("int"))
    own = outputs.join(wanted, [*by, "obj"], "left_semi").join(places.drop("_at"), [*by, "frame"])
    best = own.groupBy(*by, "frame", "obj", "_block").agg(F.min_by(F.struct("kind", "area"), order).alias("r"))
    there = best.select(*by, "frame", "obj", F.coalesce("r.kind", F.lit("absent")).alias("kind"), F.coalesce("r.area", F.lit(0)).alias("area"))
    # absent cells are made where a block of frames meets an object, last of all, so that none of them is moved between tasks
    blocks = places.groupBy(*by, "_block").agg(F.flatten(F.collect_list(F.array("frame"))).alias("_all"))
    seen = best.groupBy(*by, "obj", "_block").agg(F.collect_list("frame").alias("_seen"))
    rows = wanted.join(blocks.select(*by, "_block"), list(by)).join(seen, [*by, "obj", "_block"], "left")
    rows = rows.repartition(_partitions(rows), *by, "_block").join(blocks, [*by, "_block"])
    missing = F.explode(F.array_except("_all", F.coalesce("_seen", F.array().cast(blocks.schema["_all"].dataType)))).alias("frame")
    absent = rows.select(*by, "obj", missing).select(*by, "frame", "obj", F.lit("absent").alias("kind"), F.lit(0).cast(there.schema["area"].dataType).alias("area"))
    return there.unionByName(absent)


def shown(outputs: DataFrame, removed: DataFrame, hidden: DataFrame, unconfirmed: DataFrame, by=BY) -> DataFrame:
    """outputs with pixels of objects that are not removed (by, obj), and not hidden or unconfirmed at the frame (by, obj, frame)."""
    out = outputs.where("area > 0").join(removed, [*by, "obj"], "left_anti")
    for rows in (hidden, unconfirmed):
        out = out.join(rows, [*by, "obj", "frame"], "left_anti")
    return out


def action_plan(actions: DataFrame, by=BY) -> DataFrame:
    """(by, mode, objs): fetch if nothing came after the last propagation, partial if only additions and refinements did (with their objects), full if there was none before or an object was removed; actions (by, seq, type, obj)."""
    last = actions.where("type = 'propagate'").groupBy(*by).agg(F.max("seq").alias("last"))
    own = actions.join(last, list(by), "left")
    after = F.col("seq") > F.coalesce("last", F.lit(-1))
    sums = own.groupBy(*by).agg(F.max("last").alias("last"), F.count_if(after).alias("n"), F.count_if(after & (F.col("type") == "remove")).alias("gone"), F.array_sort(F.collect_set(F.when(after & F.col("type").isin("add", "refine"), F.col("obj")))).alias("objs"))
    mode = F.when(F.col("last").isNull() | (F.col("gone") > 0), "full").when(F.col("n") == 0, "fetch").otherwise("partial")
    return sums.select(*by, mode.alias("mode"), F.when(mode == "partial", F.col("objs")).otherwise(F.array().cast(sums.schema["objs"].dataType)).alias("objs"))


def prompts(inputs: DataFrame, by=BY) -> DataFrame:
    """(by, obj, frame, kind, n_points): state of each object's prompts at a frame after inputs (.., seq, kind, replace, n): the last kind holds; points of the same kind add up since the last replacement or other kind; clear leaves none."""
    w = Window.partitionBy(*by, "obj", "frame").orderBy("seq")
    fresh = F.col("replace") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit("")))
    own = inputs.withColumn("_g", F.sum(fresh.cast("int")).over(w))
    last = own.groupBy(*by, "obj", "frame").agg(F.max("_g").alias("_g"))
    return own.join(last, [*by, "obj", "frame", "_g"]).groupBy(*by, "obj", "frame").agg(F.first("kind").alias("kind"), F.sum("n").alias("n_points")).where("kind <> 'clear'")


def after_clearing(outputs: DataFrame, inputs: DataFrame, cleared: DataFrame, shared: bool = False, by=BY) -> DataFrame:
    """outputs (by, obj, frame, kind, ..) after the prompts of cleared (by, obj, frame) are gone: a conditioning output (cond) there is a plain one (non) from now on, and no longer counts as tracked.

    shared: the frame is downgraded, for all objects, only where none of them has inputs (by, obj, frame) left, and a session with no
    conditioning output left loses all its outputs.
    """
    keys = [*by, "obj", "frame"]
    cleared = cleared.select(*keys).distinct()
    if not shared:
        return outputs.join(cleared.withColumn("_c", F.lit(True)), keys, "left").withColumn("kind", F.when(F.col("_c") & (F.col("kind") == "cond"), "non").otherwise(F.col("kind"))).drop("_c")
    left = inputs.join(cleared, keys, "left_anti").select(*by, "frame").distinct()
    bare = cleared.select(*by, "frame").distinct().join(left, [*by, "frame"], "left_anti").withColumn("_c", F.lit(True))
    out = outputs.join(bare, [*by, "frame"], "left").withColumn("kind", F.when(F.col("_c") & (F.col("kind") == "cond"), "non").otherwise(F.col("kind"))).drop("_c")
    kept = out.where("kind = 'cond'").select(*by).distinct()
    untouched = outputs.select(*by).distinct().join(bare.select(*by).distinct(), list(by), "left_anti")
    return out.join(kept.unionByName(untouched).distinct(), list(by), "left_semi").select(*outputs.columns)


def after_resets(rows: DataFrame, resets: DataFrame, objects: bool = False, by=BY) -> DataFrame:
    """rows (by, seq, ..) without those before their session's last reset: resets (by, seq, everything). objects: rows are the objects' ids, which only a reset of everything takes."""
    last = (resets.where("everything") if objects else resets).groupBy(*by).agg(F.max("seq").alias("_last"))
    return rows.join(last, list(by), "left").where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def without_objects(outputs: DataFrame, objects: DataFrame, removed: DataFrame, by=BY) -> DataFrame:
    """outputs (by, obj, ..) without the removed objects (by, obj), at every frame; one that is not among objects (by, obj) raises ValueError."""
    keys = [*by, "obj"]
    unknown = removed.select(*keys).distinct().join(objects.select(*keys), keys, "left_anti").take(1)
    if unknown:
        raise ValueError(f"no such object: {unknown[0].asDict()}")
    return outputs.join(removed.select(*keys).distinct(), keys, "left_anti")


def trimmed_outputs(outputs: DataFrame, last: DataFrame, pointers: int = 16, by=BY) -> DataFrame:
    """outputs (by, obj, frame, kind) that a session still needs at its frame `last` (by, last): all conditioning ones, and plain ones of the last 20 * pointers frames."""
    own = outputs.join(last, list(by))
    return own.where((F.col("kind") == "cond") | (F.col("frame") > F.col("last") - 20 * pointers)).drop("last")


def capped_points(points: DataFrame, most: int, by=BY) -> DataFrame:
    """points (by, obj, frame, seq) of which, beyond `most`, the first and the last halves stay."""
    keys = [*by, "obj", "frame"]
    w = Window.partitionBy(*keys)
    own = points.withColumn("_r", F.row_number().over(w.orderBy("seq"))).withColumn("_n", F.count("*").over(w))
    first = most // 2
    return own.where((F.col("_n") <= most) | (F.col("_r") <= first) | (F.col("_r") > F.col("_n") - (most - first))).drop("_r", "_n")


def dense_records(outputs: DataFrame, objects: DataFrame, frames: DataFrame, by=BY) -> DataFrame:
    """(by, obj, areas): each object's area at all frames of its session in order, 0 where it has none."""
    wanted, places = objects.select(*by, "obj").distinct(), _places(frames, by)
    own = outputs.select(*by, "obj", "frame", F.coalesce("area", F.lit(0)).alias("area")).join(wanted, [*by, "obj"], "left_semi").join(places, [*by, "frame"])
    seen = own.groupBy(*by, "obj").agg(F.array_sort(F.collect_list(F.struct("_at", "area"))).alias("_seen"))
    rows = wanted.join(places.groupBy(*by).agg(F.count("*").alias("_n")), list(by)).join(seen, [*by, "obj"], "left")
    rows = rows.withColumn("_seen", F.coalesce("_seen", F.array().cast(seen.schema["_seen"].dataType))).repartition(_partitions(rows), F.xxhash64(*by, "obj"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast(own.schema["area"].dataType), F.greatest(n, F.lit(0)).cast("int"))
    runs = F.transform("_seen", lambda s, i: F.concat(zeros(s["_at"] - F.coalesce(F.get("_seen", i - 1)["_at"], F.lit(0)) - 1), F.array(s["area"])))
    rest = zeros(F.col("_n") - F.coalesce(F.get("_seen", F.size("_seen") - 1)["_at"], F.lit(0)))
    return rows.select(*by, "obj", F.flatten(F.concat(runs, F.array(rest))).alias("areas"))


def shard(frame: Column, workers: int) -> Column:
    """Frames dealt to workers in turn."""
    return F.pmod(frame, F.lit(workers)).cast("int")


def session_states(requests: DataFrame, by=BY) -> DataFrame:
    """(by, open, objs): after requests (by, seq, type, obj) of start, add, remove, reset and close, whether a session is open, and its objects.

    A start opens a session (an open one goes on); reset and close leave no objects, close is idempotent and what comes after it
    before the next start counts for nothing. An object is there if its last add is after the last reset, close and its last remove.
    """
    w = Window.partitionBy(*by).orderBy("seq")
    turn = F.last(F.when(F.col("type").isin("start", "close"), F.col("type")), ignorenulls=True)
    own = requests.withColumn("_on", F.coalesce(turn.over(w) == "start", F.lit(False)))
    emptied = own.groupBy(*by).agg(F.max_by("_on", "seq").alias("open"), F.max(F.when(F.col("type").isin("reset", "close"), F.col("seq"))).alias("_e"))
    last = own.where("_on").groupBy(*by, "obj").agg(F.max(F.when(F.col("type") == "add", F.col("seq"))).alias("_a"), F.max(F.when(F.col("type") == "remove", F.col("seq"))).alias("_r"))
    there = last.join(emptied, list(by)).where((F.col("_a") > F.coalesce("_e", F.lit(-1))) & (F.col("_a") > F.coalesce("_r", F.lit(-1))))
    objs = there.groupBy(*by).agg(F.array_sort(F.collect_list("obj")).alias("objs"))
    return emptied.join(objs, list(by), "left").select(*by, "open", F.coalesce("objs", F.array().cast(objs.schema["objs"].dataType)).alias("objs"))
