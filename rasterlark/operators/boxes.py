"""Oriented boxes: corners, pixels, colours and labels.

Table: objects(frame_id, draw_ord, id, class_name, x, y, length, width, yaw).
Everything here is a projection or a four-row explode; nothing is exchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlark.functions import (
    class_color,
    corner_pixels,
    corner_structs,
    pixel_col,
    pixel_row,
    unpack_bgr,
)
from rasterlark.functions.color import Color
from rasterlark.spec import (
    DEFAULT_RESOLUTION,
    DEFAULT_X_RANGE,
    DEFAULT_Y_RANGE,
    GridSpec,
)


def box_corners_bev(objects: DataFrame) -> DataFrame:
    """Adds corner (0..3), wx, wy: four rows per object."""
    return objects.select(
        *objects.columns, F.posexplode(corner_structs()).alias("corner", "at")
    ).select(*objects.columns, "corner", "at.wx", "at.wy")


def world_to_pixel(
    places: DataFrame,
    x_range: tuple[float, float] = DEFAULT_X_RANGE,
    y_range: tuple[float, float] = DEFAULT_Y_RANGE,
    resolution: float = DEFAULT_RESOLUTION,
) -> DataFrame:
    """Adds px_col, px_row for the world coordinates wx, wy."""
    spec = GridSpec.of(x_range, y_range, resolution)
    return places.withColumns(
        {
            "px_col": pixel_col(F.col("wy").cast("double"), spec),
            "px_row": pixel_row(F.col("wx").cast("double"), spec),
        }
    )


def with_color(
    objects: DataFrame, colors: Mapping[str, Color] | None = None
) -> DataFrame:
    """Adds the class colour as b, g, r."""
    channels = unpack_bgr(class_color(F.col("class_name"), colors))
    return objects.withColumns(channels)


def label_text() -> Column:
    return F.concat_ws(":", F.col("class_name"), F.col("id").cast("string"))


def box_labels(
    objects: DataFrame,
    spec: GridSpec = GridSpec(),
    colors: Mapping[str, Color] | None = None,
) -> DataFrame:
    """One text per object, anchored at its first corner."""
    anchor_col, anchor_row = corner_pixels(spec)[0]
    return with_color(objects, colors).select(
        "frame_id",
        "draw_ord",
        F.expr(anchor_col).alias("anchor_col"),
        F.expr(anchor_row).alias("anchor_row"),
        label_text().alias("label"),
        "b",
        "g",
        "r",
    )
