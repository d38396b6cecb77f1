"""What a sensor sees: rays, visible sides of boxes, and ground.

A sensor stands at a place; it sees in each direction the nearest thing. Ground
is a smooth random height that depends on place and seed alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlark.functions import between
from rasterlark.operators.generate import (
    DEFAULT_SCENE,
    background_points,
    draws_of,
    sample_count,
)
from rasterlark.operators.tiles import BROADCAST_ROWS
from rasterlark.spec import DEFAULT_SEED, SceneSpec

Place = tuple[float, float, float]
ORIGIN: Place = (0.0, 0.0, 0.0)

# -- rays -------------------------------------------------------------------------

AZIMUTHS = 3600  # bins around the sensor
ELEVATIONS = 1800  # bins from straight down to straight up
DEPTH_UNITS = 1000  # ranges are compared in millimetres


def seen_from(points: DataFrame, sensor: Place, azimuths: int, elevations: int) -> DataFrame:
    """Adds range_mm and the numbers of the azimuth and elevation bin. Points at
    the sensor and those with a null, NaN or infinite coordinate have no
    direction and go."""
    shifted = points.withColumns(
        {f"{a}_off": F.col(a).cast("double") - F.lit(float(s)) for a, s in zip("xyz", sensor)}
    )
    flat = "(x_off * x_off + y_off * y_off)"
    ranged = shifted.withColumn("reach", F.expr(f"sqrt({flat} + z_off * z_off)"))
    ranged = ranged.where("reach > 0D AND reach < double('infinity')")
    # A turn of exactly pi belongs to the bin of minus pi, straight up to the last one.
    azimuth = f"int(floor((atan2(y_off, x_off) + {math.pi!r}D) / {2 * math.pi!r}D * {azimuths}D))"
    elevation = f"int(floor((atan2(z_off, sqrt({flat})) + {math.pi / 2!r}D) / {math.pi!r}D * {elevations}D))"
    return ranged.selectExpr(
        *points.columns,
        f"bigint(floor(reach * {DEPTH_UNITS}D)) AS range_mm",
        f"{azimuth} % {azimuths} AS azimuth",
        f"least({elevation}, {elevations - 1}) AS elevation",
    )


def depth_buffer(seen: DataFrame) -> DataFrame:
    """(frame_id, azimuth, elevation, nearest_mm): one number for each direction
    in use, combined before the exchange."""
    return seen.groupBy("frame_id", "azimuth", "elevation").agg(
        F.min("range_mm").alias("nearest_mm")
    )


def visible_points(
    points: DataFrame,
    sensor: Place = ORIGIN,
    azimuths: int = AZIMUTHS,
    elevations: int = ELEVATIONS,
    thickness: float = 0.0,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The points (frame_id, x, y, z, ..) that nothing hides: those of each bin
    no more than `thickness` metres behind its nearest one. Adds range_mm,
    azimuth and elevation.

    All points at equal range stay, repeated ones too. Null is a frame. A small
    depth buffer is broadcast, so that only its rows are exchanged; with a
    larger one the points are exchanged by direction too.
    """
    seen = seen_from(points, sensor, azimuths, elevations)
    # The size is bounded by the points and by the bins of all frames.
    nearest = depth_buffer(seen).withColumnsRenamed(
        {"frame_id": "of_frame", "azimuth": "of_azimuth", "elevation": "of_elevation"}
    )
    if nearest.limit(broadcast_rows + 1).count() <= broadcast_rows:
        nearest = F.broadcast(nearest)
    behind = round(thickness * DEPTH_UNITS)
    on = (
        F.col("frame_id").eqNullSafe(F.col("of_frame"))
        & (F.col("azimuth") == F.col("of_azimuth"))
        & (F.col("elevation") == F.col("of_elevation"))
        & (F.col("range_mm") <= F.col("nearest_mm") + behind)
    )
    return seen.join(nearest, on, "left_semi")


# -- visible sides ------------------------------------------------------------------

def sample_visible_sides(
    boxes: DataFrame,
    sensor: tuple[float, float] = (0.0, 0.0),
    num_points: Column | int | None = None,
    seed: int = DEFAULT_SEED,
    scene: SceneSpec = DEFAULT_SCENE,
) -> DataFrame:
    """Points on the sides of boxes that face the sensor: (frame_id, draw_ord,
    sample, side, x, y, z, intensity); sides are 0 front, 1 back, 2 left, 3 right.

    A side faces the sensor that lies strictly beyond its line. The points of a box fall on its visible sides by their length, evenly along
    them; by default its class decides how many. A box around the sensor, or
    whose visible sides have no length, has none. The draws depend on seed,
    frame, box and sample only.
    """
    if num_points is None:
        num_points = sample_count(F.col("class_name"), scene)
    elif not isinstance(num_points, Column):
        num_points = F.lit(num_points)
    keys = ["frame_id", "draw_ord"]
    numbers = boxes.select(
        *keys,
        *(F.col(c).cast("double").alias(c) for c in ("x", "y", "length", "width", "yaw")),
        num_points.cast("bigint").alias("points"),
    )
    # At most two sides of a box are seen: one of each pair of opposite ones.
    to_x = f"({float(sensor[0])!r}D - x)"
    to_y = f"({float(sensor[1])!r}D - y)"
    seen = numbers.selectExpr(
        *numbers.columns,
        f"cos(yaw) * {to_x} + sin(yaw) * {to_y} AS ahead",
        f"cos(yaw) * {to_y} - sin(yaw) * {to_x} AS aside",
    ).selectExpr(
        *numbers.columns,
        "CASE WHEN ahead > length / 2D THEN 0 WHEN -ahead > length / 2D THEN 1 END AS end_side",
        "CASE WHEN aside > width / 2D THEN 2 WHEN -aside > width / 2D THEN 3 END AS long_side",
    ).selectExpr(
        *numbers.columns,
        "end_side",
        "long_side",
        "CASE WHEN end_side IS NULL THEN 0D ELSE width END AS end_length",
        "CASE WHEN long_side IS NULL THEN 0D ELSE length END AS all_length",
    ).where("end_length + all_length > 0D")
    blocks = seen.select(
        *keys,
        *(c for c in seen.columns if c not in (*keys, "points")),
        F.lit(seed).cast("bigint").alias("seed"),
        (F.col("draw_ord").cast("bigint") + 1).alias("block"),
        F.lit(0).cast("bigint").alias("block_start"),
        "points",
    )
    drawn = draws_of(blocks).selectExpr("*", "u0 * (end_length + all_length) AS way")
    on_side = drawn.selectExpr(
        "*",
        "CASE WHEN way < end_length THEN end_side ELSE long_side END AS side",
        "CASE WHEN way < end_length THEN CASE end_side WHEN 0 THEN length / 2D ELSE -length / 2D END "
        "ELSE way - end_length - length / 2D END AS local_x",
        "CASE WHEN way < end_length THEN way - width / 2D "
        "ELSE CASE long_side WHEN 2 THEN width / 2D ELSE -width / 2D END END AS local_y",
    )
    return on_side.select(
        *keys,
        "sample",
        "side",
        F.expr("float(x + cos(yaw) * local_x - sin(yaw) * local_y)").alias("x"),
        F.expr("float(y + sin(yaw) * local_x + cos(yaw) * local_y)").alias("y"),
        between(F.col("u2"), *scene.object_z_range).cast("float").alias("z"),
        between(F.col("u3"), *scene.object_intensity_range).cast("float").alias("intensity"),
    )


# -- ground -------------------------------------------------------------------------

GROUND_CELL = 5.0  # metres between lattice lines
GROUND_LEVEL = -1.6
GROUND_RELIEF = 0.6  # metres from the lowest to the highest ground
GROUND_KEY = 4096  # set apart from the axes of other draws


def ground_height(
    x: str,
    y: str,
    seed: str,
    cell: float = GROUND_CELL,
    level: float = GROUND_LEVEL,
    relief: float = GROUND_RELIEF,
) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Height of the ground at the DOUBLE columns x, y for the BIGINT column
    seed, as two sets of columns to add, one after the other, and the height.

    Lattice points have hashed heights; between them a cubic with level ends
    blends them along both axes. The field is continuous, and so is its slope.
    """
    first = {
        "cell_x": F.floor(F.col(x) / F.lit(cell)),
        "cell_y": F.floor(F.col(y) / F.lit(cell)),
    }

    def corner(dx: int, dy: int) -> Column:
        key = F.xxhash64(
            F.col(seed),
            F.lit(GROUND_KEY).cast("bigint"),
            F.col("cell_x") + dx,
            F.col("cell_y") + dy,
        )
        return F.shiftrightunsigned(key, 11) * F.lit(2.0**-53)

    second = {f"g{dx}{dy}": corner(dx, dy) for dx in (0, 1) for dy in (0, 1)}
    second |= {
        "tx": F.col(x) / F.lit(cell) - F.col("cell_x"),
        "ty": F.col(y) / F.lit(cell) - F.col("cell_y"),
    }
    wx, wy = "(tx * tx * (3D - 2D * tx))", "(ty * ty * (3D - 2D * ty))"
    near = f"(g00 + {wx} * (g10 - g00))"
    far = f"(g01 + {wx} * (g11 - g01))"
    height = F.expr(f"{level!r}D + {relief!r}D * ({near} + {wy} * ({far} - {near}) - 0.5D)")
    return first, second, height


def with_ground(points: DataFrame, cell: float = GROUND_CELL) -> DataFrame:
    """points(x, y, seed, ..) with z replaced by the height of the ground."""
    keep = [c for c in points.columns if c != "z"]
    numbered = points.withColumns(
        {
            "at_x": F.col("x").cast("double"),
            "at_y": F.col("y").cast("double"),
            "of_seed": F.col("seed").cast("bigint"),
        }
    )
    first, second, height = ground_height("at_x", "at_y", "of_seed", cell)
    lifted = numbered.withColumns(first).withColumns(second)
    return lifted.select(*keep, height.cast("float").alias("z"))


def ground_points(frames: DataFrame, scene: SceneSpec = DEFAULT_SCENE) -> DataFrame:
    """Background of frames(frame_id, seed) on uneven ground instead of in a
    layer: (frame_id, point_id, x, y, z, intensity). Place and intensity are
    those of `background_points`; the height comes from place and seed alone, so
    any two points at a place have the same."""
    points = background_points(frames, scene, keep=("seed",))
    return with_ground(points).select("frame_id", "point_id", "x", "y", "z", "intensity")
