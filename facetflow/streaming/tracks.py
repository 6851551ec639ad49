"""Tracks as a stream: counters and confirmation of each track kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType


class TrackState(StatefulProcessor):
    """Per (session, obj): keep-alive counter, matches in a row, whether ever confirmed. Frames must come in order over batches; within a batch they are sorted."""

    def __init__(self, start: int, most: int, least: int, needed: int):
        self.limits = (start, most, least, needed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField(c, IntegerType()) for c in ("alive", "run", "confirmed")])
        self.state = handle.getValueState("track", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, most, least, needed = self.limits
        frames = pd.concat(list(rows)).sort_values("frame")
        alive, run, sure = self.state.get() if self.state.exists() else (start, 0, 0)
        out = []
        for matched in frames["matched"]:
            alive = max(least, min(most, alive + (1 if matched else -1)))
            run = run + 1 if matched else 0
            sure = int(sure or run >= needed)
            out.append((alive, run, bool(sure)))
        self.state.update((alive, run, sure))
        done = pd.DataFrame(out, columns=["alive", "run", "confirmed"])
        yield pd.DataFrame({"session": key[0], "obj": key[1], "frame": frames["frame"].to_numpy(), "alive": done["alive"], "run": done["run"], "confirmed": done["confirmed"]})

    def close(self) -> None:
        pass


@dataclass(frozen=True)
class Rules:
    """Of the step: overlaps, scores and the cap of new tracks; frames that confirm, remove or end a track; frames held back."""

    least: float = 0.5  # IoU of a match
    score: float = 0.5  # of a detection that may start a track
    most: int = 100  # tracks of a session
    needed: int = 3  # matches in a row that confirm a track
    unmatched: int = 3  # misses that remove a young track
    shared: int = 3  # frames that a young track shares its detection with an elder one, and is removed
    young: int = 15  # frames from its first that a track is young
    start: int = 0  # the counter: its first value, and its bounds; at the lower one a track ends
    high: int = 8
    low: int = -4
    look_ahead: int = 4


TRACK = "x0 double, y0 double, x1 double, y1 double, first bigint, misses int, alive int, run int, sure boolean, gone int, until bigint"
STEP_SCHEMA = "session bigint, frame bigint, obj bigint, run int, hidden boolean, shown boolean, late boolean"


class StepState(StatefulProcessor):
    """Per session: tracks as a map by id, frames held back as a list, pairs of tracks that share detections as a map, and a few numbers.

    Each frame's detections are matched with the boxes that tracks had last (many tracks may share one); a track takes the box of its best.
    Detections of a good score that overlap no track start tracks, the best of them up to the cap, with ids that are never used again. Young tracks that
    miss, or share with an elder one, are removed: no frame shows them, nor those held back. A track whose counter is at its
    lower bound ends. A frame is given out when look_ahead - 1 later ones are there, or at the session's end: at its last frame where that is
    known (`end`), else by a timer once the watermark is `gap` past its last frame. Then all of the session's state is cleared. What is gone leaves the state with the
    last frame held that it was in, so the state holds the cap's tracks, look_ahead frames of them, and pairs of young ones.

    A batch is sorted by frame; a frame that comes after a later one of an earlier batch is given out as late, without tracks.
    """

    def __init__(self, rules: Rules, gap_ms: int):
        self.rules, self.gap = rules, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "obj bigint", TRACK)
        self.pairs = handle.getMapState("pairs", "elder bigint, obj bigint", "frames int")
        self.held = handle.getListState("held", "frame bigint, obj bigint, run int, hidden boolean")
        self.session = handle.getValueState("session", "next bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["frame", "det"])
        found = found[found["frame"].notna()]
        old = self.session.exists()  # else no state is asked for
        following, last = self.session.get() if old else (1, -(1 << 62))
        tracks = {k[0]: list(v) for k, v in self.tracks.iterator()} if old else {}
        pairs = {tuple(k): v[0] for k, v in self.pairs.iterator()} if old else {}
        held = [tuple(r) for r in self.held.get()] if old and self.held.exists() else []
        known_tracks, known_pairs, out = set(tracks), set(pairs), []
        ended = False
        numbers = found["frame"].to_numpy()
        starts = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist() if len(numbers) else []
        boxes, scores = found[["x0", "y0", "x1", "y1"]].to_numpy(dtype=float).tolist(), found["score"].to_numpy(dtype=float).tolist()
        ends = found["end"].to_numpy(dtype=object, na_value=None).tolist()
        ends = [None if e is None or e != e else e for e in ends]
        for a, b in zip(starts, [*starts[1:], len(numbers)], strict=True):
            frame = int(numbers[a])
            if frame <= last:
                out.append((key[0], frame, None, None, None, None, True))
                continue
            last = frame
            following = self.advance(tracks, pairs, boxes[a:b], scores[a:b], last, following)
            held += [(last, obj, t[7], bool(t[6] <= 0 and t[7] == 0)) for obj, t in sorted(tracks.items()) if not t[9]] or [(last, None, None, None)]
            end = max((e for e in ends[a:b] if e is not None), default=None)
            ended = end is not None and last >= end
            waiting = sorted({r[0] for r in held})
            ready = set(waiting if ended else waiting[: max(0, len(waiting) - self.rules.look_ahead + 1)])
            out += self.given(key, [r for r in held if r[0] in ready], tracks)
            held = [r for r in held if r[0] not in ready]
            for obj in [o for o, t in tracks.items() if t[9] and (not held or held[0][0] > t[10])]:
                del tracks[obj]
            for pair in [p for p in pairs if p[1] not in tracks or p[0] not in tracks]:
                del pairs[pair]
        if old:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if ended and old:
            self.clear()
        elif not ended and (old or len(numbers)):
            self.session.update((following, last))
            self.held.put(held) if held else self.held.clear()
            for obj in known_tracks - set(tracks):
                self.tracks.removeKey((obj,))
            for obj, t in tracks.items():
                self.tracks.updateValue((obj,), tuple(t))
            for pair in known_pairs - set(pairs):
                self.pairs.removeKey(pair)
            for pair, n in pairs.items():
                self.pairs.updateValue(pair, (n,))
            self.handle.registerTimer(int(found["ts"].max().timestamp() * 1000) + self.gap)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    def advance(self, tracks: dict, pairs: dict, boxes: list[list[float]], scores: list[float], frame: int, following: int) -> int:
        """Move tracks on by the detections of one frame, in order; the next free id. A frame has few of either, so plain numbers take less time than arrays."""
        r = self.rules
        live = sorted(o for o, t in tracks.items() if not t[9])
        areas = [(x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes]
        meets: list[list[int]] = [[] for _ in boxes]  # tracks that each detection overlaps
        for obj in live:
            t = tracks[obj]
            best, at = -1.0, -1
            u0, v0, u1, v1 = t[:4]
            own = (u1 - u0) * (v1 - v0)
            for j, (x0, y0, x1, y1) in enumerate(boxes):
                w, h = min(u1, x1) - max(u0, x0), min(v1, y1) - max(v0, y0)
                both = w * h if w > 0 and h > 0 else 0.0
                whole = own + areas[j] - both
                overlap = both / whole if whole > 0 else 0.0
                if overlap >= r.least:
                    meets[j].append(obj)
                    if overlap > best:  # of equal ones the first detection's
                        best, at = overlap, j
            if at >= 0:
                t[:4] = boxes[at]
                t[6], t[7] = min(t[6] + 1, r.high), t[7] + 1
                t[8] = bool(t[8] or t[7] >= r.needed)
            else:
                t[5], t[6], t[7] = t[5] + 1, max(t[6] - 1, r.low), 0
        for met in meets:
            if len(met) > 1:
                elder, *others = sorted((tracks[obj][4], obj) for obj in met)
                for _, obj in others:
                    pairs[elder[1], obj] = pairs.get((elder[1], obj), 0) + 1
        shared = {obj for (_, obj), n in pairs.items() if n >= r.shared}
        for obj in live:
            t = tracks[obj]
            young = frame - t[4] < r.young
            if young and (obj in shared or (t[7] == 0 and t[5] >= r.unmatched)):
                t[9], t[10] = 1, frame
            elif t[7] == 0 and t[6] <= r.low:
                t[9], t[10] = 2, frame
        fresh = [i for i, score in enumerate(scores) if score >= r.score and not meets[i]]
        fresh = sorted(sorted(fresh, key=lambda i: (-scores[i], i))[: max(0, r.most - len(live))])
        for obj, i in enumerate(fresh, following):
            tracks[obj] = [*boxes[i], frame, 0, r.start, 1, r.needed <= 1, 0, 0]
        return following + len(fresh)

    def given(self, key, rows: list[tuple], tracks: dict) -> list[tuple]:
        return [(key[0], frame, obj, run, hidden, bool(tracks[obj][8] and tracks[obj][9] != 1) if obj is not None else None, False) for frame, obj, run, hidden in rows]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracks = {k[0]: list(v) for k, v in self.tracks.iterator()}
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self.clear()
        yield pd.DataFrame(self.given(key, held, tracks), columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    def clear(self) -> None:
        for state in (self.tracks, self.pairs, self.held, self.session):
            state.clear()

    def close(self) -> None:
        pass


def stepped(detections: DataFrame, rules: Rules | None = None, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Tracks of a streaming table of detections (session, frame, ts, det, score, x0, y0, x1, y1, end): a row a frame and track, or one without a track, each frame once; see StepState. Needs the RocksDB state store.

    end is the session's last frame where it is known, else null. shown: whether the track is confirmed and not removed once the frame is given out; hidden: missed with its counter used up. A batch of a session meets in one task: the source's maxFilesPerTrigger or maxBytesPerTrigger bounds it.
    """
    names = ["session", "frame", "ts", "det", "score", "x0", "y0", "x1", "y1", "end"]
    return detections.select(*names).withWatermark("ts", late).groupBy("session").transformWithStateInPandas(StepState(rules or Rules(), int(pd.Timedelta(gap).total_seconds() * 1000)), STEP_SCHEMA, outputMode="append", timeMode="eventTime")


SCHEMA = "session bigint, obj bigint, frame bigint, alive int, run int, confirmed boolean"


def tracked(frames: DataFrame, start: int = 0, most: int = 30, least: int = -1, needed: int = 3) -> DataFrame:
    """A streaming frame table (session, obj, frame, matched) with alive, run and confirmed; needs the RocksDB state store."""
    return frames.groupBy("session", "obj").transformWithStateInPandas(TrackState(start, most, least, needed), SCHEMA, outputMode="append", timeMode="none")


def per_session(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of a stream (ts timestamp, user_id): a bounded state, as late rows beyond the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Work off what is there, exactly once a row (checkpoint and file sink), and read it back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
