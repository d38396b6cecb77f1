"""Outlines, label strokes and painter's order.

Drawing is a set of (pixel, layer, colour) rows. A pixel shows its highest
layer, so painting is one maximum over `layer * 2^24 + colour`: the winning
layer carries its colour along and no join back to the objects is needed.

Layer 0 is the point raster. Object number n of a frame draws its outline on
layer 2n + 1 and its label on layer 2n + 2. Numbers that are NULL, negative or
beyond MAX_DRAW_ORD have no layer of their own and fail.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.functions import class_color, corner_pixels, pack_bgr, unpack_bgr
from rasterlark.functions.color import Color
from rasterlark.operators.boxes import label_text
from rasterlark.operators.glyphs import glyph_places
from rasterlark.operators.raster import (
    DEFAULT_GRID,
    pack_cell,
    point_levels,
    rotate,
    split_cell,
)
from rasterlark.operators.spread import spread
from rasterlark.spec import (
    DEFAULT_RESOLUTION,
    DEFAULT_X_RANGE,
    DEFAULT_Y_RANGE,
    GridSpec,
)

LAYER_SHIFT = 24
MAX_DRAW_ORD = 2**38 - 2  # its label's layer and the colour fill a BIGINT
LINE_THICKNESS = 2
# Bytes of pixels per byte of an object row, roughly: what an object grows to.
PIXEL_GROWTH = 200


def _in_grid(places: DataFrame, spec: GridSpec) -> DataFrame:
    """Places row, col (BIGINT) that lie in the grid, as px_row and px_col."""
    keep = [c for c in places.columns if c not in ("row", "col")]
    return places.filter(
        f"row BETWEEN 0 AND {spec.height - 1} AND col BETWEEN 0 AND {spec.width - 1}"
    ).selectExpr(*keep, "int(row) AS px_row", "int(col) AS px_col")


def trace(lines: DataFrame, spec: GridSpec, thickness: int) -> DataFrame:
    """Pixels of the lines (c0, r0) to (c1, r1) that lie in the grid.

    Adds px_row, px_col and drops the end points. Step k of a line of n steps
    is at trunc(k * delta / n) from its start; thickness adds pixels below a
    flat line and to the right of a steep one. A line with an end that has no
    pixel number is not drawn. Places are BIGINT until they are known to be in
    the grid, so no line can overflow.

    Only the steps that can be inside the grid are expanded. The way to the first
    of them is taken once per line; what is left per pixel is small.
    """
    ends = ("c0", "r0", "c1", "r1")
    keep = [c for c in lines.columns if c not in ends]
    # A line without a pixel number has no places, and the last filter drops them.
    # Here and in all explodes of drawing no earlier filter is stated, and the
    # outer form keeps Spark from adding one on the exploded array: carried along
    # as constraints, such filters took most of the planning.
    directed = lines.selectExpr(
        *keep,
        "bigint(c0) AS c0",
        "bigint(r0) AS r0",
        "bigint(c1) - c0 AS dc",
        "bigint(r1) - r0 AS dr",
        "greatest(abs(bigint(c1) - c0), abs(bigint(r1) - r0), 1) AS steps",
    )
    stepped = _cut(directed, spec, thickness, keep)
    placed = stepped.selectExpr(
        *keep,
        "row_at + (row_rest + dr * step) div steps AS row",
        "col_at + (col_rest + dc * step) div steps AS col",
        "abs(dc) >= abs(dr) AS flat",
    )
    if thickness > 1:
        placed = placed.selectExpr(
            *keep, "row", "col", "flat", f"explode(sequence(0, {thickness - 1})) AS wide"
        ).selectExpr(
            *keep,
            "row + CASE WHEN flat THEN wide ELSE 0 END AS row",
            "col + CASE WHEN flat THEN 0 ELSE wide END AS col",
        )
    return _in_grid(placed.drop("flat"), spec)


def _reach(axis: str, low: int, high: int) -> str:
    """Two steps (DOUBLE): where a line is at either end of low..high on one
    axis, generous by a pixel; NULL where it does not move on that axis."""
    per_pixel = f"(l.steps / nullif(l.d{axis}, 0))"
    return (
        f"({low} - l.{axis}0 - 1) * {per_pixel} AS {axis}_low, "
        f"({high} - l.{axis}0 + 1) * {per_pixel} AS {axis}_high"
    )


def _cut(directed: DataFrame, spec: GridSpec, thickness: int, keep: list[str]) -> DataFrame:
    """Steps from the first to the last one near the grid, with the place of
    the first: position and remainder of the division by `steps`.

    An axis without movement gives NULL, which least and greatest skip: a line
    beside the grid expands to as many steps as the other axis allows. The
    arithmetic of a line is that of an array of one element: Spark would move
    plain columns above the explode, into the work per pixel.
    """
    columns = _reach("c", 1 - thickness, spec.width - 1)
    rows = _reach("r", 1 - thickness, spec.height - 1)
    first = ", ".join(f"least(l.{a}_low, l.{a}_high) - 1" for a in "cr")
    last = ", ".join(f"greatest(l.{a}_low, l.{a}_high) + 1" for a in "cr")
    way = "cast(l.first as decimal(19,0)) * cast(l.d{} as decimal(19,0))".format
    same = "l.dc AS dc, l.dr AS dr, l.steps AS steps"
    stages = (
        f"{same}, l.c0 AS c0, l.r0 AS r0, {columns}, {rows}",
        f"{same}, l.c0 AS c0, l.r0 AS r0, "
        f"bigint(least(l.steps + 1D, greatest(0D, {first}))) AS first, "
        f"bigint(greatest(-1D, least(double(l.steps), {last}))) AS last",
        f"{same}, l.last - l.first AS length, "
        f"l.c0 + {way('c')} div l.steps AS col_at, l.r0 + {way('r')} div l.steps AS row_at, "
        f"bigint({way('c')} % l.steps) AS col_rest, bigint({way('r')} % l.steps) AS row_rest",
    )
    line = "array(struct(c0, r0, dc, dr, steps))"
    for stage in stages:
        line = f"transform({line}, l -> struct({stage}))"
    return directed.selectExpr(*keep, f"inline_outer(filter({line}, l -> l.length >= 0))").selectExpr(
        *keep,
        *("dc", "dr", "steps", "col_at", "row_at", "col_rest", "row_rest"),
        "explode_outer(sequence(0L, length)) AS step",
    )


def _placed(
    objects: DataFrame, spec: GridSpec, colors: Mapping[str, Color] | None, labels: bool
) -> DataFrame:
    """Corners c0, r0 .. c3, r3, colour and, if asked for, text of each object.

    Narrower than the objects, and a stage apart from the expansion, so that
    each is one compilable method. Edges and letters come from one exchange.
    """
    pixels = [
        f"{pixel} AS {axis}{i}"
        for i, corner in enumerate(corner_pixels(spec))
        for axis, pixel in zip("cr", corner)
    ]
    order = (
        f"CASE WHEN bigint(draw_ord) BETWEEN 0 AND {MAX_DRAW_ORD} THEN bigint(draw_ord) ELSE "
        f"raise_error('draw_ord must be between 0 and {MAX_DRAW_ORD}') END"
    )
    drawn = F.struct(
        class_color(F.col("class_name"), colors).alias("bgr"),
        *map(F.expr, pixels),
        *([label_text().alias("label")] if labels else []),
    )
    # As an array of one element, of which no part is pruned: then the exchange
    # is the same for edges and letters, and Spark makes it once. Built by
    # transform, which adds nothing to the generated method.
    corners = objects.select(
        "frame_id",
        F.expr(order).alias("draw_ord"),
        F.transform(F.array(F.lit(0)), lambda _: drawn).alias("drawn"),
    )
    return spread(corners, "frame_id", "draw_ord", growth=PIXEL_GROWTH).selectExpr(
        "frame_id", "draw_ord", "inline_outer(drawn)"
    )


def _outlines(placed: DataFrame, spec: GridSpec) -> DataFrame:
    edges = (
        f"named_struct('c0', c{i}, 'r0', r{i}, 'c1', c{j}, 'r1', r{j})"
        for i, j in ((0, 1), (1, 2), (2, 3), (3, 0))
    )
    lines = placed.selectExpr(
        "frame_id", "draw_ord", "bgr", f"inline_outer(array({', '.join(edges)}))"
    )
    return trace(lines, spec, LINE_THICKNESS)


def _letters(placed: DataFrame, spec: GridSpec) -> DataFrame:
    texts = placed.selectExpr(
        "frame_id",
        "draw_ord",
        "bgr",
        "bigint(c0) AS anchor_col",
        "bigint(r0) AS anchor_row",
        "label",
    )
    return _in_grid(glyph_places(texts), spec)


def box_outline(
    objects: DataFrame,
    spec: GridSpec = DEFAULT_GRID,
    colors: Mapping[str, Color] | None = None,
) -> DataFrame:
    """Closed four-edge outlines: (frame_id, draw_ord, bgr, px_row, px_col).

    A pixel repeats where edges meet or strokes overlap.
    """
    return _outlines(_placed(objects, spec, colors, labels=False), spec)


def label_strokes(
    objects: DataFrame,
    spec: GridSpec = DEFAULT_GRID,
    colors: Mapping[str, Color] | None = None,
) -> DataFrame:
    """Pixels of the label texts: (frame_id, draw_ord, bgr, px_row, px_col)."""
    return _letters(_placed(objects, spec, colors, labels=True), spec)


def layered(pixels: DataFrame, first_layer: int, spec: GridSpec) -> DataFrame:
    """Drawn pixels as (frame_id, cell, paint)."""
    layer = F.col("draw_ord") * 2 + first_layer
    return pixels.select(
        "frame_id",
        pack_cell(F.col("px_row"), F.col("px_col"), spec).alias("cell"),
        (F.shiftleft(layer, LAYER_SHIFT) + F.col("bgr")).alias("paint"),
    )


def _top(paint: DataFrame) -> DataFrame:
    return paint.groupBy("frame_id", "cell").agg(F.max("paint").alias("paint"))


def painted_pixels(
    objects: DataFrame,
    spec: GridSpec = DEFAULT_GRID,
    colors: Mapping[str, Color] | None = None,
) -> DataFrame:
    """The outline each pixel shows: (frame_id, px_row, px_col, draw_ord, b, g, r)."""
    row, col = split_cell(spec)
    top = _top(layered(box_outline(objects, spec, colors), 1, spec))
    return top.select(
        "frame_id",
        row.alias("px_row"),
        col.alias("px_col"),
        F.expr(f"(shiftright(paint, {LAYER_SHIFT}) - 1) div 2").alias("draw_ord"),
        *(c.alias(n) for n, c in unpack_bgr(F.col("paint")).items()),
    )


def compose(
    gray: DataFrame,
    objects: DataFrame,
    spec: GridSpec = DEFAULT_GRID,
    colors: Mapping[str, Color] | None = None,
    labels: bool = True,
) -> DataFrame:
    """Raster with outlines and labels: (frame_id, cell_row, cell_col, b, g, r).

    `gray` is (frame_id, cell_row, cell_col, gray) and need not be aggregated:
    given `point_levels` the whole image takes a single exchange. Objects of
    frames that `gray` does not hold are drawn on an empty raster.
    """
    placed = _placed(objects, spec, colors, labels)
    paint = gray.select(
        "frame_id",
        pack_cell(F.col("cell_row"), F.col("cell_col"), spec).alias("cell"),
        pack_bgr(F.col("gray")).cast("bigint").alias("paint"),
    ).unionByName(layered(_outlines(placed, spec), 1, spec))
    if labels:
        # The same exchange of the objects serves both.
        paint = paint.unionByName(layered(_letters(placed, spec), 2, spec))
    row, col = split_cell(spec)
    return _top(paint).select(
        "frame_id",
        row.alias("cell_row"),
        col.alias("cell_col"),
        *(c.alias(n) for n, c in unpack_bgr(F.col("paint")).items()),
    )


def draw_objects(
    bev: DataFrame,
    objects: DataFrame,
    x_range: tuple[float, float] = DEFAULT_X_RANGE,
    y_range: tuple[float, float] = DEFAULT_Y_RANGE,
    resolution: float = DEFAULT_RESOLUTION,
) -> DataFrame:
    """Annotated image, turned: (frame_id, out_row, out_col, b, g, r)."""
    spec = GridSpec.of(x_range, y_range, resolution)
    return rotate(compose(bev, objects, spec), spec)


def render_frames(
    points: DataFrame,
    objects: DataFrame,
    spec: GridSpec = DEFAULT_GRID,
    colors: Mapping[str, Color] | None = None,
    labels: bool = True,
) -> DataFrame:
    """Points and objects straight to the turned image, in one exchange."""
    return rotate(compose(point_levels(points, spec), objects, spec, colors, labels), spec)
