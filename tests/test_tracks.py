"""Tracks of detections, in batch and as a stream."""

from __future__ import annotations

import random

import pytest

from rasterlark.operators import tracking
from rasterlark.streaming.tracks import stream_tracks

SEEN = "scene_id string, frame_id long, id long, x double, y double"


def crossing(scene="a", frames=40, seed=1):
    """Three objects on their ways, some frames without them, one false alarm."""
    rng, rows, identity = random.Random(seed), [], 0
    for f in range(frames):
        for k, (x0, vx, y0, vy) in enumerate(((0, 1, 0, 0.5), (60, -1, 7, 0.5), (0, 0, 90, 0))):
            identity += 1
            if (rng.random() < 0.7 or f % 3 == 0) and not (k == 2 and 10 <= f < 20):
                rows.append((scene, f, identity, x0 + vx * f + rng.gauss(0, 0.1), y0 + vy * f + rng.gauss(0, 0.1)))
    return [*rows, (scene, 7, 10_000, -500.0, 0.0)]


def numbers(found):
    return {(r.scene_id, r.frame_id, r.id): (r.track, r.hits, r.confirmed) for r in found}


def test_objects_keep_their_tracks(spark):
    rows = crossing()
    found = numbers(tracking.track_objects(spark.createDataFrame(rows, SEEN).repartition(4)).collect())
    assert len(found) == len(rows)
    for k in range(2):
        own = [found["a", f, i] for _, f, i, *_ in rows if i < 10_000 and i % 3 == (k + 1) % 3]
        assert len({t for t, _, _ in own}) == 1 and own[-1][2]
        assert [h for _, h, _ in sorted(own)] == list(range(1, len(own) + 1))
    third = [found["a", f, i][0] for _, f, i, *_ in rows if i < 10_000 and i % 3 == 0]
    assert len(set(third)) == 2  # not seen for ten frames
    assert found["a", 7, 10_000][1:] == (1, False)


def test_awkward_detections(spark):
    rows = [("a", 1, 1, 0.0, 0.0), ("a", 1, 1, 0.0, 0.0), ("a", None, 2, 0.0, 0.0), (None, 1, 3, 0.0, 0.0)]
    rows += [("a", 2, None, 0.0, 0.0), ("a", 2, 4, None, 0.0), ("a", 2, 5, float("nan"), 0.0), ("a", 5, 6, 0.1, 0.0)]
    rows += [("a", 9, 7, 0.1, 0.0), ("b", 1, 8, 0.0, 0.0)]
    found = tracking.track_objects(spark.createDataFrame(rows, SEEN)).collect()
    assert sorted((r.scene_id, r.frame_id, r.track, r.hits) for r in found) == [
        ("a", 1, 0, 1), ("a", 1, 1, 1), ("a", 5, 2, 1), ("a", 9, 3, 1), ("b", 1, 0, 1),
    ]
    assert tracking.track_objects(spark.createDataFrame([], SEEN)).count() == 0


def test_state_survives_as_text():
    tracker = tracking.Tracker()
    for f in range(5):
        tracker.see(f, [(f, 0.1 * f, 1 / 3), (f + 10, 20.0, f / 7)], tracking.Motion(), tracking.Rules())
    assert tracking.Tracker.of(tracker.text()) == tracker


@pytest.mark.parametrize("cuts", [[], [13], [5, 6, 21, 30]])
def test_stream_equals_batch(spark, tmp_path, cuts):
    """Files taken one by one, the query stopped and started between them."""
    rows = [*crossing("a"), *crossing("b", seed=2)]
    timed = spark.createDataFrame(rows, SEEN).selectExpr("*", "timestamp_seconds(frame_id * 10) AS at")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    edges = [0, *cuts, 1000]
    try:
        for low, high in zip(edges, edges[1:]):
            part = timed.where(f"frame_id >= {low} AND frame_id < {high}")
            part.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(timed.schema).parquet(source)
            query = (
                stream_tracks(stream, "at", "30 seconds")
                .writeStream.format("parquet")
                .option("path", out)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    finally:
        spark.conf.unset(provider)
    streamed = numbers(spark.read.parquet(out).collect())
    batch = numbers(tracking.track_objects(timed).collect())
    assert streamed == {k: v for k, v in batch.items() if k[1] <= 36}
