from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlark import GridSpec, densify, points_to_bev, rotate
from rasterlark.operators.raster import (
    frames_of,
    locate,
    point_levels,
    quantize,
    scatter_max,
    to_bgr,
)
from rasterlark.session import sizing
from rasterlark.sinks import write_points
from rasterlark.sources import read_points


def cells(bev) -> dict:
    return {(r.frame_id, r.cell_row, r.cell_col): r.gray for r in bev.collect()}


def brute_force(rows) -> dict:
    """The raster point by point, in 32-bit floats."""
    f = np.float32
    best = {}
    for x, y, intensity, frame in rows:
        x, y = f(x), f(y)
        if not (f(0) <= x < f(40) and f(-20) <= y < f(20)):
            continue
        key = (
            str(frame),
            min(int((x - f(0)) / f(0.1)), 399),
            min(int((y + f(20)) / f(0.1)), 399),
        )
        best[key] = max(best.get(key, f(0)), f(intensity))
    return {k: int(min(f(255), v * f(255))) for k, v in best.items()}


def test_default_grid_is_400_by_400():
    assert (GridSpec().height, GridSpec().width) == (400, 400)


def test_grid_must_be_a_whole_number_of_cells():
    with pytest.raises(ValueError):
        GridSpec.of((0.0, 0.7), (0.0, 1.0), 0.4)
    with pytest.raises(ValueError):
        GridSpec.of((1.0, 1.0))
    with pytest.raises(ValueError):
        GridSpec(resolution=0)
    assert GridSpec.of((0.0, 0.7), (0.0, 0.7), 0.1).height == 7


@pytest.mark.parametrize(
    "row, expected",
    [
        ((12.0, 3.0, 0.8), {("a", 120, 230): 204}),
        ((0.0, -20.0, 1.0), {("a", 0, 0): 255}),
        ((40.0, 0.0, 1.0), {}),
        ((0.0, 20.0, 1.0), {}),
        ((-0.001, 0.0, 1.0), {}),
        ((1.0, 19.999998, 1.0), {("a", 10, 399): 255}),
        ((math.nan, 0.0, 1.0), {}),
        ((1.0, math.nan, 1.0), {}),
        ((1.0, 0.0, math.nan), {}),
        ((1.0, 0.0, None), {}),
        ((None, 0.0, 1.0), {}),
        ((1.0, 0.0, -0.5), {("a", 10, 200): 0}),
        ((1.0, 0.0, 1.7), {("a", 10, 200): 255}),
        ((1.0, 0.0, math.inf), {("a", 10, 200): 255}),
    ],
)
def test_single_points(points, row, expected):
    assert cells(points_to_bev(points([row]))) == expected


def test_largest_intensity_of_a_cell_wins(points):
    rows = [(1.0, 0.0, v) for v in (0.2, 0.9, 0.5, math.nan)]
    assert cells(points_to_bev(points(rows))) == {("a", 10, 200): 229}


def test_double_points_are_binned_as_double(points):
    def row_of(width):
        return cells(points_to_bev(points([(18.4, 0.0, 1.0)], width)))

    assert list(row_of("FLOAT")) == [("a", 184, 200)]
    assert list(row_of("DOUBLE")) == [("a", 183, 200)]


def test_region_bounds_compare_at_the_width_of_the_points(points):
    bev = points_to_bev(points([(0.7, 0.05, 1.0)]), (0.7, 1.7), (0.0, 1.0), 0.1)
    assert cells(bev) == {("a", 0, 0): 255}


def skewed_rows(seed=5, count=6000):
    """A third of the points in one frame and cell, the rest over five frames."""
    rng = random.Random(seed)
    rows = [(5.05, 5.05, rng.random(), 0) for _ in range(count // 3)]
    rows += [
        (rng.uniform(-4, 44), rng.uniform(-24, 24), rng.uniform(-0.2, 1.2), rng.randrange(5))
        for _ in range(count - len(rows))
    ]
    return rows


def test_skewed_frames_against_brute_force(points):
    rows = skewed_rows()
    assert cells(points_to_bev(points(rows))) == brute_force(rows)


def test_partitioning_order_and_repetition_do_not_matter(points):
    rows = skewed_rows(6, 1200)
    expected = cells(points_to_bev(points(rows)))
    random.Random(1).shuffle(rows)
    table = points(rows)
    assert cells(points_to_bev(table.repartition(7))) == expected
    assert cells(points_to_bev(table.union(table).coalesce(1))) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.floats(-1, 41, width=32),
            st.floats(-21, 21, width=32),
            st.floats(-2, 2, width=32),
            st.integers(0, 2),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_union_is_the_cellwise_maximum(points, rows):
    half = len(rows) // 2
    whole = cells(points_to_bev(points(rows)))
    assert whole == brute_force(rows)
    assert all(0 <= g <= 255 for g in whole.values())
    parts = [brute_force(rows[:half]), brute_force(rows[half:])]
    for key, gray in whole.items():
        assert gray == max(p.get(key, 0) for p in parts)


def test_levels_can_be_taken_before_the_maximum(points):
    table = points(skewed_rows(7, 900))
    early = (
        point_levels(table)
        .groupBy("frame_id", "cell_row", "cell_col")
        .agg(F.max("gray").alias("gray"))
    )
    assert cells(early) == cells(quantize(scatter_max(table)))


def test_dense_has_every_cell_of_every_frame(points):
    spec = GridSpec.of((0.0, 2.0), (0.0, 1.5), 0.5)
    rows = [(0.1, 0.1, 0.2, "f"), (0.1, 1.4, 0.4, "f"), (1.6, 0.6, 0.6, "f"), (9.0, 9.0, 1.0, "g")]
    table = points(rows)
    dense = cells(points_to_bev(table, (0.0, 2.0), (0.0, 1.5), 0.5, dense=True))
    full = {(f, r, c): 0 for f in "fg" for r in range(4) for c in range(3)}
    full |= {("f", 0, 0): 51, ("f", 0, 2): 102, ("f", 3, 1): 153}
    assert dense == full
    listed = frames_of(table).union(frames_of(points([(0.0, 0.0, 0.0, "h")])))
    more = points_to_bev(table, (0.0, 2.0), (0.0, 1.5), 0.5, dense=True, frames=listed)
    assert cells(more) == full | {("h", r, c): 0 for r in range(4) for c in range(3)}
    assert densify(points_to_bev(table.limit(0)), frames_of(table.limit(0)), spec).count() == 0


def test_turned_and_coloured(points):
    bev = points_to_bev(points([(12.0, 3.0, 0.8)]))
    turned = rotate(bev).first()
    assert (turned.out_row, turned.out_col, turned.gray) == (169, 120, 204)
    assert to_bgr(bev).first().asDict() == {
        "frame_id": "a", "cell_row": 120, "cell_col": 230, "b": 204, "g": 204, "r": 204
    }


def test_plan_over_a_stored_table(spark, points, tmp_path):
    path = str(tmp_path / "points")
    table = points(skewed_rows(8, 300)).withColumn("z", F.lit(0.0).cast("float"))
    write_points(table, path, layout="by_frame")
    stored = read_points(spark, path, T.StringType())
    assert dict(stored.dtypes)["frame_id"] == "string"
    text = plan(points_to_bev(stored.filter("frame_id = '3'")))
    for wanted in (
        "GreaterThanOrEqual(x,0.0)",
        "LessThan(x,40.0)",
        "GreaterThanOrEqual(y,-20.0)",
        "PartitionFilters: [isnotnull(frame_id",
        "ReadSchema: struct<x:float,y:float,intensity:float>",
        "partial_max(intensity",
    ):
        assert wanted in text
    assert text.count("Exchange") == 1
    for unwanted in ("SortAggregate", "Python", "Cartesian", "NestedLoop"):
        assert unwanted not in text


def test_dense_plan_never_joins(points):
    text = plan(points_to_bev(points([(1.0, 1.0, 1.0)]), dense=True))
    assert "Join" not in text and "Cartesian" not in text


def test_cells_stay_inside(points):
    located = locate(points(skewed_rows(9, 600)))
    assert located.filter("cell_row NOT BETWEEN 0 AND 399 OR cell_col NOT BETWEEN 0 AND 399").count() == 0


def test_sizing_follows_the_input():
    small, large = sizing(10**9), sizing(100 * 10**12)
    assert small["spark.sql.shuffle.partitions"] == "4"
    assert small["spark.sql.files.maxPartitionBytes"] == str(128 * 1024**2)
    assert large["spark.sql.shuffle.partitions"] == "50000"
    assert int(large["spark.sql.files.maxPartitionBytes"]) == 10**9


def test_a_frame_outside_the_list_fails(points):
    table = points([(0.5, 0.5, 0.5, "a"), (0.5, 0.5, 0.5, "b")])
    listed = frames_of(points([(0.0, 0.0, 0.0, "a")]))
    for frames in (listed, listed.union(frames_of(table)).union(listed)):
        with pytest.raises(Exception, match="list of frames"):
            points_to_bev(table, dense=True, frames=frames).collect()


@pytest.mark.parametrize("kind, row", [("FLOAT", 184), ("DOUBLE", 183), ("DECIMAL(6,3)", 183)])
def test_other_number_types_are_binned_as_double(spark, kind, row):
    table = spark.sql(f"SELECT 'a' AS frame_id, CAST(18.4 AS {kind}) AS x, CAST(0 AS {kind}) AS y, 0.5F AS intensity")
    assert points_to_bev(table).first().cell_row == row


@pytest.mark.parametrize("kind", ["INT", "BIGINT"])
def test_whole_number_coordinates(spark, kind):
    table = spark.sql(f"SELECT 'a' AS frame_id, CAST(12 AS {kind}) AS x, CAST(-3 AS {kind}) AS y, 0.5F AS intensity")
    assert tuple(points_to_bev(table).first())[1:3] == (int(12 / 0.1), int(17 / 0.1))
