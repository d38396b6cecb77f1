from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlark import SceneSpec, generate_frame, generate_frames, points_to_bev, sample_points_for_box
from rasterlark.operators import generate
from rasterlark.spec import BACKGROUND_RANGES


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), "frame_id STRING, seed BIGINT")


@pytest.fixture(scope="module")
def built_in(spark):
    return generate_frame(spark)[0].orderBy("point_id").toPandas()


def test_built_in_frame_layout(built_in):
    assert len(built_in) == 8240
    assert list(built_in.point_id) == list(range(8240))
    assert set(built_in.frame_id) == {"000001"}
    assert set(map(str, built_in.dtypes[["x", "y", "z", "intensity"]])) == {"float32"}


def test_background_follows_the_default_generator(built_in):
    stream = np.random.default_rng(7)
    for name, (low, high) in BACKGROUND_RANGES.items():
        expected = stream.uniform(low, high, 6000).astype(np.float32)
        assert (built_in[name].to_numpy()[:6000] == expected).all()


def test_last_object_follows_the_default_generator(built_in):
    # Three boxes of 900, 900 and 220 points come between, four numbers each.
    stream = np.random.default_rng(7)
    stream.random(4 * (6000 + 900 + 900 + 220))
    tail = built_in[-220:]
    drawn = {
        "x": 8.0 + stream.uniform(-0.25, 0.25, 220),
        "y": -8.0 + stream.uniform(-0.25, 0.25, 220),
        "z": stream.uniform(-0.8, 1.2, 220),
        "intensity": stream.uniform(0.4, 1.0, 220),
    }
    for name, values in drawn.items():
        assert np.abs(tail[name].to_numpy() - values).max() < 1e-6


@pytest.mark.parametrize("mode", ["hashed", "sequential"])
def test_counts_ranges_and_gray_levels(spark, mode):
    table = generate_frames(frames(spark, ("p", 7), ("q", 8)), mode=mode)
    assert table.count() == 2 * 8240
    counted = table.groupBy("frame_id").agg(F.count_distinct("point_id").alias("n"))
    assert {r.n for r in counted.collect()} == {8240}
    back = table.filter("point_id < 6000")
    for name, (low, high) in BACKGROUND_RANGES.items():
        r = back.agg(F.min(name).alias("a"), F.max(name).alias("b"), F.avg(name).alias("m")).first()
        assert np.float32(low) <= r.a and r.b <= np.float32(high)
        assert abs(r.m - (low + high) / 2) < 0.02 * (high - low)
    levels = points_to_bev(table).filter("gray BETWEEN 90 AND 101 OR gray < 12")
    assert levels.count() == 0
    both = table.groupBy("point_id").agg(F.count_distinct("x").alias("n")).filter("n = 1")
    assert both.count() < 10


@pytest.mark.parametrize("mode", ["hashed", "sequential"])
def test_chunks_and_partitions_do_not_change_the_points(spark, monkeypatch, mode):
    rows = frames(spark, ("p", 7), ("q", 7), ("r", 3))
    scene = SceneSpec(background_points=1000)

    def points():
        table = generate_frames(rows, scene, mode).orderBy("frame_id", "point_id")
        return [tuple(r) for r in table.collect()]

    whole = points()
    monkeypatch.setattr(generate, "CHUNK_POINTS", 77)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert points() == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(whole) == 3 * (1000 + 2240)


def test_own_objects_and_unknown_class(spark):
    table = frames(spark, ("p", 1)).select(
        "*",
        F.expr(
            "array(named_struct('class_name', 'truck', 'x', 5D, 'y', 1D, 'length', 2D, "
            "'width', 1D, 'yaw', 0D))"
        ).alias("objects"),
    )
    drawn = generate_frames(table, SceneSpec(background_points=0))
    r = drawn.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert r.n == 220
    assert 4 <= r[1] < 4.2 and 5.8 < r[2] <= 6 and 0.5 <= r[3] < 0.6 and 1.4 < r[4] <= 1.5


def test_one_large_box_becomes_many_tasks(spark):
    box = spark.createDataFrame(
        [("p", 0, "car", 5.0, 1.0, 4.0, 2.0, 0.3)],
        "frame_id STRING, draw_ord INT, class_name STRING, x DOUBLE, y DOUBLE, "
        "length DOUBLE, width DOUBLE, yaw DOUBLE",
    )
    drawn = sample_points_for_box(box, 1_000_000)
    tasks = drawn.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 1_000_000 and len(tasks) > 1
    assert drawn.agg(F.count_distinct("sample")).first()[0] == 1_000_000


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        generate_frames(frames(spark, ("p", 1)), mode="other")
