"""Streams that are stopped, resumed and ended by the watermark."""

import datetime

from facetflow.streaming import tracks

ROWS = "session bigint, frame bigint, ts timestamp, det bigint, score double, x0 double, y0 double, x1 double, y1 double, end bigint"


def boxes(session, frames, second, end=None, at=0.0):
    return [(session, f, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second + i), 1, 0.9, at, 0.0, at + 10, 10.0, end) for i, f in enumerate(frames)]


def test_step_flushes_by_timer_and_resumes(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame(boxes(1, range(1, 7), 0), ROWS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: tracks.stepped(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source), tracks.Rules(needed=2), gap="5 seconds", late="1 second")
    first = [tuple(r) for r in tracks.run_once(stream(), f"{tmp_path}/run").collect()]
    assert sorted(r[1] for r in first) == [1, 2, 3]  # look_ahead - 1 = 3 frames are held
    # another session moves the watermark past the gap, more frames of a third are late
    spark.createDataFrame(boxes(2, [1, 2], 100, end=2), ROWS).coalesce(1).write.mode("append").parquet(source)
    found = [tuple(r) for r in tracks.run_once(stream(), f"{tmp_path}/run").collect()]
    assert sorted(r[:2] for r in found) == [(1, f) for f in range(1, 7)] + [(2, 1), (2, 2)]
    assert all(r[5] for r in found if r[0] == 1) and {r[2] for r in found} == {1}


def test_step_gives_late_frames_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    for rows in (boxes(1, [1, 2, 5], 0), boxes(1, [3], 3) + boxes(1, [6], 4, end=6)):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        out = tracks.run_once(tracks.stepped(spark.readStream.schema(ROWS).parquet(source), gap="1 hour"), f"{tmp_path}/run")
    found = sorted((r["frame"], r["late"]) for r in out.collect())
    assert found == [(1, False), (2, False), (3, True), (5, False), (6, False)]


def test_step_removes_and_ends(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = boxes(1, [1], 0, 60) + boxes(1, range(2, 61), 1, 60, at=500.0)
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(source)
    out = tracks.run_once(tracks.stepped(spark.readStream.schema(ROWS).parquet(source)), f"{tmp_path}/run").collect()
    assert {r["frame"] for r in out} == set(range(1, 61))
    assert max(r["frame"] for r in out if r["obj"] == 1) == 3  # the third miss removes it
    assert not any(r["shown"] for r in out if r["obj"] == 1) and all(r["shown"] for r in out if r["obj"] == 2)
