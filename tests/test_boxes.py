from __future__ import annotations

import pytest
from conftest import plan
from pyspark.sql import functions as F

from rasterlark import CLASS_COLORS, box_corners_bev, box_labels, make_objects, with_color, world_to_pixel

# id, corner, wx, wy, px_col, px_row of the built-in scene
CORNERS = [
    (1, 0, 14.082769, 4.275568, 242, 140),
    (1, 1, 14.366701, 2.396903, 223, 143),
    (1, 2, 9.917231, 1.724432, 217, 99),
    (1, 3, 9.633299, 3.603097, 236, 96),
    (2, 0, 26.524348, -4.612487, 153, 265),
    (2, 1, 26.02954, -6.550312, 134, 260),
    (2, 2, 21.475652, -5.387513, 146, 214),
    (2, 3, 21.97046, -3.449688, 165, 219),
    (3, 0, 18.4, 7.9, 278, 183),
    (3, 1, 18.4, 7.1, 271, 183),
    (3, 2, 17.6, 7.1, 271, 176),
    (3, 3, 17.6, 7.9, 278, 176),
    (4, 0, 8.25, -7.75, 122, 82),
    (4, 1, 8.25, -8.25, 117, 82),
    (4, 2, 7.75, -8.25, 117, 77),
    (4, 3, 7.75, -7.75, 122, 77),
]


@pytest.fixture(scope="module")
def scene(spark):
    return make_objects(spark.createDataFrame([("000001",)], "frame_id STRING"))


def test_scene_corners_and_pixels(scene):
    placed = world_to_pixel(box_corners_bev(scene)).orderBy("id", "corner").collect()
    got = [
        (r.id, r.corner, round(r.wx, 6), round(r.wy, 6), r.px_col, r.px_row) for r in placed
    ]
    assert got == CORNERS


def test_scene_objects_per_frame(spark):
    frames = spark.createDataFrame([("a",), ("b",)], "frame_id STRING")
    rows = make_objects(frames).orderBy("frame_id", "draw_ord").collect()
    assert [(r.frame_id, r.draw_ord, r.id) for r in rows] == [
        (f, n, n + 1) for f in "ab" for n in range(4)
    ]
    assert dict(make_objects(frames).dtypes)["id"] == "bigint"


def test_pixels_truncate_toward_zero_and_may_leave_the_grid(spark):
    places = spark.createDataFrame(
        [(-0.05, -20.05), (0.05, -19.95), (50.0, 30.0), (3e9, 0.0), (float("nan"), 0.0)],
        "wx DOUBLE, wy DOUBLE",
    )
    got = [(r.px_row, r.px_col) for r in world_to_pixel(places).collect()]
    assert got[:3] == [(0, 0), (0, 0), (500, 500)]
    assert got[3] == (None, 200)


def test_colors_and_unknown_class(spark):
    objects = spark.createDataFrame(
        [(c,) for c in ("car", "pedestrian", "cone", "truck", None)], "class_name STRING"
    )
    colored = with_color(objects)
    got = {r.class_name: (r.b, r.g, r.r) for r in colored.collect()}
    assert got == {**CLASS_COLORS, "truck": (255, 255, 255), None: (255, 255, 255)}
    assert "Join" not in plan(colored) and "Exchange" not in plan(colored)
    own = with_color(objects, {"truck": (1, 2, 3)}).filter("class_name = 'truck'").first()
    assert (own.b, own.g, own.r) == (1, 2, 3)


def test_labels_sit_on_the_first_corner(scene):
    got = {r.label: (r.anchor_col, r.anchor_row, r.b, r.g, r.r) for r in box_labels(scene).collect()}
    assert got == {
        "car:1": (242, 140, 0, 220, 0),
        "car:2": (153, 265, 0, 220, 0),
        "pedestrian:3": (278, 183, 0, 180, 255),
        "cone:4": (122, 82, 255, 120, 0),
    }


def test_boxes_need_no_exchange(scene):
    assert "Exchange" not in plan(world_to_pixel(box_corners_bev(scene)))
    axis_aligned = box_corners_bev(scene).filter("yaw = 0").groupBy("id").agg(
        F.count_distinct("wx").alias("x"), F.count_distinct("wy").alias("y")
    )
    assert {(r.x, r.y) for r in axis_aligned.collect()} == {(2, 2)}
