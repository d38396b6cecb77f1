"""Tile index, points in boxes, overlaps, suppression."""

from __future__ import annotations

import math
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from rasterlark.operators import overlap, tiles

BOX = "frame_id long, id long, x double, y double, length double, width double, yaw double"
RANKED = BOX + ", score double, class_name string"


def inside(box, x, y):
    _, _, cx, cy, length, width, yaw = box[:7]
    along = (x - cx) * math.cos(yaw) + (y - cy) * math.sin(yaw)
    across = (y - cy) * math.cos(yaw) - (x - cx) * math.sin(yaw)
    return abs(along) <= length / 2 and abs(across) <= width / 2


def clipped(a, b):
    """Common area of two boxes by cutting one polygon with the sides of the other."""

    def corners(box):
        _, _, cx, cy, length, width, yaw = box[:7]
        return [
            (
                cx + i * length / 2 * math.cos(yaw) - j * width / 2 * math.sin(yaw),
                cy + i * length / 2 * math.sin(yaw) + j * width / 2 * math.cos(yaw),
            )
            for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))
        ]

    shape, frame = corners(a), corners(b)
    for (px, py), (qx, qy) in zip(frame, frame[1:] + frame[:1]):
        side = [(qx - px) * (y - py) - (qy - py) * (x - px) for x, y in shape]
        cut = []
        for k, (x, y) in enumerate(shape):
            (x0, y0), s0, s1 = shape[k - 1], side[k - 1], side[k]
            if s0 * s1 < 0:
                t = s0 / (s0 - s1)
                cut.append((x0 + t * (x - x0), y0 + t * (y - y0)))
            if s1 >= 0:
                cut.append((x, y))
        shape = cut
    return abs(sum(shape[k - 1][0] * y - x * shape[k - 1][1] for k, (x, y) in enumerate(shape))) / 2


def random_boxes(n, seed, frames=2, spread=12.0, largest=6.0):
    rng = random.Random(seed)
    return [
        (
            i % frames,
            i,
            rng.uniform(-spread, spread),
            rng.uniform(-spread, spread),
            rng.uniform(0.1, largest),
            rng.uniform(0.1, largest),
            rng.uniform(-4, 4),
        )
        for i in range(n)
    ]


# -- points -----------------------------------------------------------------------


@pytest.mark.parametrize("settings", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "hot_rows": 5}])
def test_points_in_boxes_of_any_size(spark, settings):
    rng = random.Random(4)
    boxes = random_boxes(30, 1, largest=3) + [(0, 90, 0.0, 0.0, 900.0, 0.2, 0.3), (1, 91, 5.0, 5.0, 40.0, 30.0, 1.0)]
    boxes += [(0, 92, -7.25, 3.0, 0.0, 0.0, 0.0), (1, 93, 1.0, 1.0, -2.0, 2.0, 0.0), (1, 94, None, 1.0, 2.0, 2.0, 0.0)]
    rows = [(i % 3, i, rng.uniform(-14, 14), rng.uniform(-14, 14)) for i in range(600)]
    rows += [(0, 600, -7.25, 3.0), (None, 601, 0.0, 0.0), (0, 602, None, 0.0), (0, 603, math.nan, 0.0), (0, 604, 0.0, 0.0)] * 2
    points = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double")
    kept = overlap.remove_inside(points, spark.createDataFrame(boxes, BOX), **settings)
    assert kept.columns == points.columns
    expected = [
        r
        for r in rows
        if None in r or not any(b[0] == r[0] and None not in b and b[4] >= 0 and inside(b, *r[2:]) for b in boxes)
    ]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected))
    assert 100 < len(expected) < 560


def test_edges_and_margin(spark):
    boxes = spark.createDataFrame([(0, 1, 2.0, 0.0, 4.0, 2.0, 0.0)], BOX)
    rows = [(0, x, y) for x in (0.0, -0.5, 4.0, 4.25) for y in (1.0, 1.25, -1.0)]
    points = spark.createDataFrame(rows, "frame_id long, x float, y float")
    kept = {(r.x, r.y) for r in overlap.remove_inside(points, boxes).collect()}
    assert kept == {(x, y) for _, x, y in rows if not (0 <= x <= 4 and abs(y) <= 1)}
    kept = {(r.x, r.y) for r in overlap.remove_inside(points, boxes, margin=0.25).collect()}
    assert kept == {(-0.5, 1.0), (-0.5, 1.25), (-0.5, -1.0)}


def test_boxes_as_large_as_numbers_go(spark):
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.7e308, 1.7e308, 0.7), (1, 2, 1e300, 0.0, 2.0, 2.0, 0.0)], BOX)
    rows = [(0, 3.0, -1e200), (1, 3.0, 0.0), (1, 1e300, 0.5)]
    points = spark.createDataFrame(rows, "frame_id long, x double, y double")
    assert [tuple(r) for r in overlap.remove_inside(points, boxes).collect()] == [rows[1]]


def test_points_are_not_exchanged_and_never_looped_over(spark):
    points = spark.range(1000).selectExpr("id % 3 AS frame_id", "id * 0.01D AS x", "id * 0.02D AS y")
    boxes = spark.createDataFrame(random_boxes(20, 2), BOX)
    small = plan(overlap.remove_inside(points, boxes))
    assert "NestedLoop" not in small and "hashpartitioning" not in small
    assert "NestedLoop" not in plan(overlap.remove_inside(points, boxes, broadcast_rows=0))


def test_a_hot_tile_is_many_tasks(spark):
    """A third of all points in one tile is dealt over parts."""
    points = spark.range(3000).selectExpr("0L AS frame_id", "IF(id % 3 = 0, 1D, id * 8D) AS x", "1D AS y")
    keyed = points.withColumn("tile", tiles.tile_of("x", F.lit(3)))
    few = keyed.select("tile").distinct()
    many, copies = tiles.split_hot(keyed.withColumn("n", F.monotonically_increasing_id()), few, ["tile"], F.col("n"), 100)
    sizes = [r["count"] for r in many.groupBy("tile", "part").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 3000
    assert many.join(copies, ["tile", "part"]).count() == 3000


# -- overlaps ---------------------------------------------------------------------


@pytest.mark.parametrize("settings", [{}, {"hot_rows": 3}, {"base": 0}])
def test_areas_equal_clipping(spark, settings):
    boxes = random_boxes(80, 3) + [(0, 900, 0.0, 0.0, 50.0, 40.0, 0.5), (1, 901, 3.0, 3.0, 200.0, 0.5, 2.0)]
    found = overlap.box_overlaps(spark.createDataFrame(boxes, BOX), **settings).collect()
    expected = {}
    for i, a in enumerate(boxes):
        for b in boxes[i + 1 :]:
            if a[0] == b[0] and (area := clipped(a, b)) > overlap.LEAST_AREA:
                expected[a[0], a[1], b[1]] = area, area / (a[4] * a[5] + b[4] * b[5] - area)
    assert len(found) == len(expected) > 100
    for r in found:
        area, iou = expected[r.frame_id, r.id_a, r.id_b]
        assert r.intersection == pytest.approx(area, abs=1e-9)
        assert r.iou == pytest.approx(iou, abs=1e-9)


def overlaps(spark, *boxes):
    rows = [(0, i, *b) for i, b in enumerate(boxes)]
    found = overlap.box_overlaps(spark.createDataFrame(rows, BOX)).collect()
    return {(r.id_a, r.id_b): (r.intersection, r.iou) for r in found}


@pytest.mark.parametrize("yaw", [0.0, 0.3, math.pi / 2, 2.5, -math.pi])
def test_identical_nested_and_touching_boxes(spark, yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    found = overlaps(
        spark,
        (1.0, 2.0, 4.0, 2.0, yaw),
        (1.0, 2.0, 4.0, 2.0, yaw),
        (1.0, 2.0, 2.0, 4.0, yaw + math.pi / 2),
        (1.0, 2.0, 1.0, 0.5, yaw),
        (1.0 + 4.0 * c, 2.0 + 4.0 * s, 4.0, 2.0, yaw),
        (1.0 - 1.5 * c, 2.0 - 1.5 * s, 1.0, 2.0, yaw),
    )
    same = {(0, 1), (0, 2), (1, 2)}
    assert {p for p in found if 4 in p} == set()
    for pair in same:
        assert found[pair] == (pytest.approx(8.0, abs=1e-9), pytest.approx(1.0, abs=1e-9))
    assert found[0, 3][0] == pytest.approx(0.5, abs=1e-9)
    assert found[0, 5] == (pytest.approx(2.0, abs=1e-9), pytest.approx(0.25, abs=1e-9))


def test_degenerate_and_broken_boxes_overlap_nothing(spark):
    good = (0.0, 0.0, 4.0, 4.0, 0.0)
    bad = [(0.0, 0.0, 0.0, 4.0, 0.2), (0.0, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, -4.0, 4.0, 0.0)]
    bad += [(None, 0.0, 1.0, 1.0, 0.0), (0.0, math.nan, 1.0, 1.0, 0.0), (math.inf, 0.0, 1.0, 1.0, 0.0)]
    assert overlaps(spark, good, *bad) == {}
    assert overlaps(spark, *bad) == {} and overlaps(spark, (1e300, 0.0, 1.0, 1.0, 0.0)) == {}


# -- suppression --------------------------------------------------------------------


def greedy(boxes, least, by_class=True):
    kept = []
    for b in sorted(boxes, key=lambda b: (-(b[7] if b[7] is not None and b[7] == b[7] else -math.inf), b[1])):
        rivals = (k for k in kept if k[0] == b[0] and (not by_class or k[8] == b[8]))
        areas = ((k, clipped(k, b)) for k in rivals)
        if not any(a / (k[4] * k[5] + b[4] * b[5] - a) > least for k, a in areas if a > 0):
            kept.append(b)
    return {(b[0], b[1]) for b in kept}


@pytest.mark.parametrize("frame_edges", [50_000, 20, 0])
@pytest.mark.parametrize("by_class", [True, False])
def test_equals_the_sequential_greedy(spark, frame_edges, by_class):
    rng = random.Random(6)
    scores = [0.1, 0.1, 0.5, 0.9, None, math.nan]
    boxes = [
        (*b, rng.choice(scores), rng.choice(["car", "bus", None])) for b in random_boxes(120, 5, spread=8)
    ]
    table = spark.createDataFrame(boxes, RANKED)
    found = overlap.suppress(table, least_iou=0.15, by_class=by_class, frame_edges=frame_edges)
    assert found.columns == table.columns
    expected = greedy(boxes, 0.15, by_class)
    assert {(r.frame_id, r.id) for r in found.collect()} == expected
    assert 20 < len(expected) < 110


@pytest.mark.parametrize("frame_edges", [50_000, 15])
def test_long_chains(spark, frame_edges):
    """Each box overlaps the next one, worse by little: every second one falls."""
    rows = [(0, i, i * 1.0, 0.0, 1.9, 1.0, 0.0, 1.0 - i / 100, "car") for i in range(40)]
    rows += [(1, i, 0.0, 0.0, 1.0, 1.0, 0.0, 0.5, "car") for i in range(30)]  # copies: ties by id
    found = overlap.suppress(spark.createDataFrame(rows, RANKED), least_iou=0.3, frame_edges=frame_edges)
    kept = {(r.frame_id, r.id) for r in found.collect()}
    assert kept == {(0, i) for i in range(0, 40, 2)} | {(1, 0)}


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], RANKED), spark.createDataFrame(random_boxes(3, 1), BOX)
    points = spark.createDataFrame([(0, 1.0, 1.0)], "frame_id long, x double, y double")
    assert overlap.suppress(none).count() == overlap.box_overlaps(none).count() == 0
    assert overlap.remove_inside(points, none).count() == 1
    assert overlap.remove_inside(points.limit(0), some).count() == 0
