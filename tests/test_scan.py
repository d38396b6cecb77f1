"""Rays, visible sides, ground."""

from __future__ import annotations

import math
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from rasterlark.operators import scan

POINT = "frame_id long, point_id long, x double, y double, z double"
BOX = "frame_id long, draw_ord long, class_name string, x double, y double, length double, width double, yaw double"


def hidden_free(rows, sensor, azimuths, elevations, thickness):
    seen = []
    for f, i, *place in rows:
        if any(v is None or v != v for v in place):
            continue
        x, y, z = (a - b for a, b in zip(place, sensor))
        reach = math.sqrt((x * x + y * y) + z * z)
        if reach:
            a = math.floor((math.atan2(y, x) + math.pi) / (2 * math.pi) * azimuths) % azimuths
            e = math.floor((math.atan2(z, math.sqrt(x * x + y * y)) + math.pi / 2) / math.pi * elevations)
            seen.append((f, i, math.floor(reach * 1000), a, min(e, elevations - 1)))
    nearest = {}
    for f, _, r, a, e in seen:
        nearest[f, a, e] = min(r, nearest.get((f, a, e), r))
    return sorted((s for s in seen if s[2] <= nearest[s[0], s[3], s[4]] + 1000 * thickness), key=str)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
@pytest.mark.parametrize("thickness", [0.0, 0.5])
def test_nearest_points_are_seen(spark, broadcast_rows, thickness):
    rng = random.Random(1)
    rows = [(i % 2, i, *(rng.uniform(-9, 9) for _ in range(3))) for i in range(800)]
    # Bin edges, straight up and down, the place of the sensor, ties, nulls.
    rows += [(0, 900 + k, *p) for k, p in enumerate([(1, 1, 2), (-4, 1, 2), (1, 5, 2), (1, 1, 9), (1, 1, -9)])]
    rows += [(0, 910, 3.0, 3.0, 2.0), (0, 911, 3.0, 3.0, 2.0), (None, 912, 3.0, 3.0, 2.0)]
    rows += [(0, 913, None, 1.0, 1.0), (0, 914, math.nan, 1.0, 1.0)]
    rows = [(f, i, *(None if v is None else float(v) for v in p)) for f, i, *p in rows]
    points = spark.createDataFrame(rows, POINT)
    found = scan.visible_points(points, (1.0, 1.0, 2.0), 16, 8, thickness, broadcast_rows)
    got = sorted((tuple(r)[:2] + tuple(r)[5:] for r in found.collect()), key=str)
    assert got == hidden_free(rows, (1.0, 1.0, 2.0), 16, 8, thickness)


def test_one_exchange(spark):
    points = spark.range(100).selectExpr("0L AS frame_id", "id AS point_id", "id * 1D AS x", "1D AS y", "0D AS z")
    text = plan(scan.visible_points(points))
    assert text.count("hashpartitioning") == 1 and "NestedLoop" not in text


def box_side(box, x, y):
    """Side of the box a place lies on, and how far along."""
    _, _, _, cx, cy, length, width, yaw = box
    along = (x - cx) * math.cos(yaw) + (y - cy) * math.sin(yaw)
    across = (y - cy) * math.cos(yaw) - (x - cx) * math.sin(yaw)
    gaps = [abs(along - length / 2), abs(along + length / 2), abs(across - width / 2), abs(across + width / 2)]
    assert abs(along) <= length / 2 + 1e-4 and abs(across) <= width / 2 + 1e-4
    return {k for k, gap in enumerate(gaps) if gap < 1e-4}


def test_samples_lie_on_the_sides_that_face_the_sensor(spark):
    boxes = [
        (0, 1, "car", 10.0, 0.0, 4.0, 2.0, 0.0),
        (0, 2, "car", 10.0, 8.0, 4.0, 2.0, 0.2),
        (0, 3, None, -6.0, -6.0, 3.0, 1.0, 2.0),
        (1, 1, "car", 0.5, 0.0, 4.0, 2.0, 0.0),  # around the sensor
        (1, 2, "car", 2.0, 0.0, 4.0, 2.0, 0.0),  # the sensor on an edge
        (1, 3, "car", None, 0.0, 4.0, 2.0, 0.0),
        (1, 4, "car", 9.0, 0.0, 4.0, 0.0, 0.0),  # the only visible side has no length
    ]
    found = scan.sample_visible_sides(spark.createDataFrame(boxes, BOX), num_points=2000).collect()
    shares = {}
    for r in found:
        box = next(b for b in boxes if b[:2] == (r.frame_id, r.draw_ord))
        assert r.side in box_side(box, r.x, r.y)
        shares[r.frame_id, r.draw_ord, r.side] = shares.get((r.frame_id, r.draw_ord, r.side), 0) + 1
    assert set(shares) == {(0, 1, 1), (0, 2, 1), (0, 2, 3), (0, 3, 0), (0, 3, 3)}
    assert shares[0, 1, 1] == 2000
    assert shares[0, 2, 3] == pytest.approx(2000 * 4 / 6, rel=0.1)
    assert shares[0, 2, 1] + shares[0, 2, 3] == 2000


def test_sides_do_not_depend_on_partitions(spark):
    boxes = spark.createDataFrame([(f, n, "car", 9.0 + n, 3.0, 4.0, 2.0, 0.1 * n) for f in range(3) for n in range(5)], BOX)
    one = scan.sample_visible_sides(boxes.coalesce(1), num_points=20).collect()
    many = scan.sample_visible_sides(boxes.repartition(7), num_points=20).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 300


def heights(spark, places, seed=3):
    rows = spark.createDataFrame([(float(x), float(y), seed) for x, y in places], "x double, y double, seed long")
    return {(r.x, r.y): r.z for r in scan.with_ground(rows.repartition(3)).collect()}


def test_ground_is_a_continuous_function_of_place_and_seed(spark):
    line = [(5.0 * k + d, 2.5) for k in (-1, 0, 1, 2) for d in (-1e-6, 0.0, 1e-6)]
    line += [(2.5, 5.0 * k + d) for k in (-1, 0, 1, 2) for d in (-1e-6, 0.0, 1e-6)]
    found = heights(spark, line)
    for a, b in zip(line[::3], line[2::3]):
        assert found[a] == pytest.approx(found[b], abs=1e-5)
    assert found == heights(spark, line[::-1])
    other = heights(spark, line, seed=4)
    assert sum(other[p] != found[p] for p in line) > len(line) // 2
    low, high = scan.GROUND_LEVEL - scan.GROUND_RELIEF / 2, scan.GROUND_LEVEL + scan.GROUND_RELIEF / 2
    assert all(low - 1e-6 <= z <= high + 1e-6 for z in found.values())


def test_ground_points_keep_place_and_intensity(spark):
    frames = spark.createDataFrame([(1, 5), (2, 5)], "frame_id long, seed long")
    from rasterlark.operators.generate import background_points

    flat = background_points(frames).drop("z")
    raised = scan.ground_points(frames)
    assert raised.columns == ["frame_id", "point_id", "x", "y", "z", "intensity"]
    assert raised.drop("z").exceptAll(flat).count() == flat.exceptAll(raised.drop("z")).count() == 0
    assert raised.agg(F.count_distinct("z")).first()[0] > 5000
