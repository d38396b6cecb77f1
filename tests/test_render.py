from __future__ import annotations

import math

import pytest
from conftest import plan

from rasterlark import CLASS_COLORS, GridSpec, draw_objects, painted_pixels, points_to_bev, render_frames
from rasterlark.operators.glyphs import ADVANCE, GLYPHS, glyph_pixels, glyph_places, glyph_segments
from rasterlark.operators.render import MAX_DRAW_ORD, box_outline, label_strokes, trace

SPEC = GridSpec.of((0.0, 6.0), (-2.0, 2.0), 0.1)
SCHEMA = (
    "frame_id STRING, draw_ord BIGINT, id BIGINT, class_name STRING, x DOUBLE, y DOUBLE, "
    "length DOUBLE, width DOUBLE, yaw DOUBLE"
)
OBJECTS = [
    ("a", 0, 7, "car", 3.0, 0.0, 2.0, 1.0, 0.4),
    ("a", 1, 8, "cone", 3.2, 0.3, 1.0, 1.0, -1.1),
    ("a", 2, 9, "truck", 0.2, -1.9, 1.5, 1.5, 0.0),
    ("b", 0, 1, "pedestrian", 5.9, 1.9, 0.8, 0.8, 2.0),
]


def line_pixels(c0, r0, c1, r1):
    steps = max(abs(c1 - c0), abs(r1 - r0), 1)
    for k in range(steps + 1):
        yield r0 + math.trunc(k * (r1 - r0) / steps), c0 + math.trunc(k * (c1 - c0) / steps)


def brute_outline(obj, spec):
    """Pixels of one box in the grid, by walking its edges."""
    _, _, _, _, x, y, length, width, yaw = obj
    corners = []
    for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        lx, ly = sx * length / 2, sy * width / 2
        wx = x + math.cos(yaw) * lx - math.sin(yaw) * ly
        wy = y + math.sin(yaw) * lx + math.cos(yaw) * ly
        corners.append(
            (int((wy - spec.y_min) / spec.resolution), int((wx - spec.x_min) / spec.resolution))
        )
    for start, end in zip(corners, corners[1:] + corners[:1]):
        flat = abs(end[0] - start[0]) >= abs(end[1] - start[1])
        for row, col in line_pixels(*start, *end):
            for r, c in ((row, col), (row + flat, col + (not flat))):
                if 0 <= r < spec.height and 0 <= c < spec.width:
                    yield r, c


def test_painter_order_against_brute_force(spark):
    expected = {}
    for obj in OBJECTS:
        for pixel in brute_outline(obj, SPEC):
            expected[obj[0], *pixel] = (obj[1], CLASS_COLORS.get(obj[3], (255, 255, 255)))
    painted = painted_pixels(spark.createDataFrame(OBJECTS, SCHEMA), SPEC)
    got = {
        (r.frame_id, r.px_row, r.px_col): (r.draw_ord, (r.b, r.g, r.r)) for r in painted.collect()
    }
    assert got == expected
    text = plan(painted)
    assert "SortAggregate" not in text and "Join" not in text


def lines_of(spark, *ends):
    return spark.createDataFrame(ends, "name STRING, c0 BIGINT, r0 BIGINT, c1 BIGINT, r1 BIGINT")


def test_lines_in_all_directions(spark):
    ends = [
        (f"{i}", 20, 20, 20 + dc, 20 + dr)
        for i, (dc, dr) in enumerate((a, b) for a in (-33, -7, 0, 5, 41) for b in (-29, -3, 0, 8, 60))
    ]
    got = {(r.name, r.px_row, r.px_col) for r in trace(lines_of(spark, *ends), SPEC, 1).collect()}
    expected = {
        (name, row, col)
        for name, *line in ends
        for row, col in line_pixels(*line)
        if 0 <= row < SPEC.height and 0 <= col < SPEC.width
    }
    assert got == expected


def test_lines_far_outside_are_cut_before_they_are_expanded(spark):
    far = 2_000_000_000
    ends = [
        ("across", -far, 10, far, 10),
        ("diagonal", -far, -far, far, far),
        ("beside", far, 0, far, far),
        ("anti", 39 + far, -far, 39 - far, far),
    ]
    pixels = trace(lines_of(spark, *ends), SPEC, 1).collect()
    by_name = {}
    for r in pixels:
        by_name.setdefault(r.name, set()).add((r.px_row, r.px_col))
    assert by_name["across"] == {(10, c) for c in range(40)}
    assert by_name["diagonal"] == {(i, i) for i in range(40)}
    assert by_name["anti"] == {(i, 39 - i) for i in range(40)}
    assert "beside" not in by_name


def test_huge_boxes_and_unplaceable_ones(spark):
    objects = spark.createDataFrame(
        [
            ("a", 0, 1, "car", 3.0, 0.0, 1e8, 2.0, 0.0),
            ("a", 1, 2, "car", 3.0, 0.0, 1e12, 2.0, 0.0),
        ],
        SCHEMA,
    )
    drawn = {(r.draw_ord, r.px_row, r.px_col) for r in box_outline(objects, SPEC).collect()}
    # Only the long sides cross the grid, two pixels thick; the second box has
    # no pixel numbers.
    assert drawn == {(0, row, col) for row in range(60) for col in (10, 11, 30, 31)}


def test_axis_parallel_boxes_have_four_edges_of_two_pixels(spark):
    objects = spark.createDataFrame([("a", 0, 1, "car", 3.05, 0.05, 2.0, 1.0, 0.0)], SCHEMA)
    drawn = {(r.px_row, r.px_col) for r in box_outline(objects, SPEC).collect()}
    rows, cols = sorted({r for r, _ in drawn}), sorted({c for _, c in drawn})
    assert (rows[0], rows[-1], cols[0], cols[-1]) == (20, 41, 15, 26)
    middle = (rows[0] + rows[-1]) // 2, (cols[0] + cols[-1]) // 2
    assert [c for c in cols if (middle[0], c) in drawn] == [15, 16, 25, 26]
    assert [r for r in rows if (r, middle[1]) in drawn] == [20, 21, 40, 41]


def test_arithmetic_of_a_line_stays_below_the_explode(spark):
    text = plan(box_outline(spark.createDataFrame(OBJECTS, SCHEMA), SPEC))
    above = text[: text.rindex("Generate explode(sequence")]
    assert "decimal" in text.lower() and "decimal" not in above.lower()


@pytest.mark.parametrize("y", [214748340.0, -214748340.0, 2.1e8])
def test_no_place_of_a_box_fails_the_job(spark, y):
    rows = [("a", 0, 123456789, "pedestrian", 3.0, y, 2.0, 1.0, 0.0), OBJECTS[1]]
    objects = spark.createDataFrame(rows, SCHEMA)
    assert {r.draw_ord for r in box_outline(objects, SPEC).collect()} == {1}
    assert {r.draw_ord for r in label_strokes(objects, SPEC).collect()} == {1}


def test_draw_ord_up_to_the_last_layer(spark):
    last = MAX_DRAW_ORD
    rows = [("a", n, n, c, 3.0, 0.0, 2.0, 1.0, 0.4) for n, c in ((last, "car"), (0, "cone"))]
    painted = painted_pixels(spark.createDataFrame(rows, SCHEMA), SPEC).collect()
    assert {(r.draw_ord, r.g) for r in painted} == {(last, 220)}


@pytest.mark.parametrize("draw_ord", [MAX_DRAW_ORD + 1, 2**38, 2**62, -1, None])
def test_other_draw_ords_are_refused(spark, draw_ord):
    rows = [("a", draw_ord, 1, "car", 3.0, 0.0, 2.0, 1.0, 0.4), OBJECTS[1]]
    with pytest.raises(Exception, match="draw_ord must be between"):
        painted_pixels(spark.createDataFrame(rows, SCHEMA), SPEC).collect()


def test_objects_are_exchanged_once_for_edges_and_letters(spark, points):
    objects = spark.createDataFrame(OBJECTS, SCHEMA)
    image = render_frames(points([(3.0, 0.0, 0.5, "a")]), objects, SPEC)
    image.collect()
    text = plan(image)
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    made = [line for line in final.splitlines() if "REPARTITION_BY_NUM" in line]
    assert [("ReusedExchange" in line) for line in made] == [False, True]


def test_all_of_printable_ascii_has_a_glyph():
    assert set(GLYPHS) == {chr(code) for code in range(32, 127)}
    drawn = {code for code, *_ in glyph_segments()}
    assert drawn == set(range(33, 127))
    shapes = {}
    for code, *line in glyph_segments():
        shapes.setdefault(code, []).append(tuple(line))
    assert len(set(map(tuple, shapes.values()))) == len(shapes)


def test_letters_written_by_hand():
    """Segments in pixels, 1.5 to a lattice unit, rows downwards from the baseline."""
    by_code = {}
    for code, *line in glyph_segments():
        by_code.setdefault(chr(code), []).append(tuple(line))
    assert by_code["L"] == [(0, -9, 0, 0), (0, 0, 6, 0)]
    assert by_code["/"] == [(0, 0, 6, -9)]
    assert by_code["T"] == [(0, -9, 6, -9), (3, -9, 3, 0)]
    assert by_code["+"] == [(3, -7, 3, -1), (0, -4, 6, -4)]
    assert by_code["-"] == [(0, -3, 6, -3)]
    assert by_code["v"] == [(0, -6, 3, 0), (3, 0, 6, -6)]
    assert by_code["7"] == [(0, -9, 6, -9), (6, -9, 1, 0)]


def test_label_strokes_against_the_glyph_table(spark):
    texts = spark.createDataFrame(
        [("t", 5, 30, "a:é"), ("empty", 5, 30, " ")],
        "name STRING, anchor_col BIGINT, anchor_row BIGINT, label STRING",
    )
    got = sorted((r.name, r.col, r.row) for r in glyph_places(texts).collect())
    expected = sorted(
        ("t", 5 + at * ADVANCE + col, 30 + row)
        for at, letter in enumerate("a:?")
        for code, col, row in glyph_pixels()
        if code == ord(letter)
    )
    assert got == expected


def test_pixels_of_strokes():
    pixels = {}
    for code, *place in glyph_pixels():
        pixels.setdefault(chr(code), []).append(tuple(place))
    assert pixels["-"] == [(c, -3) for c in range(7)]
    assert pixels["|"] == [(3, r) for r in range(-9, 4)]
    assert pixels["/"] == [(int(k * 6 / 9), -k) for k in range(10)]


@pytest.mark.parametrize("drawing", [box_outline, label_strokes, render_frames])
def test_planning_carries_no_large_constraints(spark, points, drawing):
    """Filters on exploded arrays were what planning spent its time on."""
    objects = spark.createDataFrame(OBJECTS, SCHEMA)
    table = points([(3.0, 0.0, 0.5, "a")])
    frame = drawing(table, objects) if drawing is render_frames else drawing(objects)
    assert "size(" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_image_is_the_same_from_points_and_from_a_raster(spark, points):
    table = points([(3.0, 0.0, 0.5, "a"), (0.05, 1.95, 0.9, "a"), (1.0, 1.0, 0.7, "c")])
    objects = spark.createDataFrame(OBJECTS, SCHEMA)
    ranges = ((0.0, 6.0), (-2.0, 2.0), 0.1)
    direct = render_frames(table, objects, SPEC)
    staged = draw_objects(points_to_bev(table, *ranges), objects, *ranges)
    rows = {tuple(r.asDict().values()) for r in direct.collect()}
    assert rows == {tuple(r.asDict().values()) for r in staged.collect()}
    shown = {(f, r, c): (b, g, red) for f, r, c, b, g, red in rows}
    # (0.05, 1.95) is cell (0, 39), turned to row 0, column 0.
    assert shown["a", 0, 0] == (229, 229, 229)
    assert shown["c", 9, 10] == (178, 178, 178)
    assert {f for f, _, _ in shown} == {"a", "b", "c"}
    labels = {
        (r.frame_id, SPEC.width - 1 - r.px_col, r.px_row)
        for r in label_strokes(objects, SPEC).collect()
        if r.draw_ord == 2 or r.frame_id == "b"
    }
    outline = [(o[0], *p) for o in OBJECTS[3:] for p in brute_outline(o, SPEC)]
    assert labels and all(shown[p] in {(0, 180, 255), (255, 255, 255)} for p in labels)
    assert all(shown[f, SPEC.width - 1 - c, r] == (0, 180, 255) for f, r, c in outline)
    assert plan(direct).count("Exchange hashpartitioning(frame_id") >= 1


def test_without_labels(spark, points):
    objects = spark.createDataFrame(OBJECTS[:1], SCHEMA)
    image = render_frames(points([]), objects, SPEC, labels=False)
    assert image.count() == len(set(brute_outline(OBJECTS[0], SPEC)))


@pytest.mark.parametrize("seed", [1, 2])
def test_many_objects_in_one_frame(spark, seed):
    objects = spark.range(3000).selectExpr(
        "'hot' AS frame_id", "id AS draw_ord", "id", "'car' AS class_name",
        f"(id * 37 + {seed}) % 60 / 10D AS x", f"(id * 91 + {seed}) % 40 / 10D - 2D AS y",
        "1D AS length", "0.5D AS width", "id % 63 / 10D AS yaw",
    )
    top = painted_pixels(objects, SPEC).agg({"draw_ord": "max", "*": "count"}).first()
    assert top["max(draw_ord)"] == 2999 and top["count(1)"] <= SPEC.height * SPEC.width
