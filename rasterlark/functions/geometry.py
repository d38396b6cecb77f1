"""Oriented boxes: placement, corners and pixels, all in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlark.spec import GridSpec

# Signs of the half extents, in corner order.
CORNER_SIGNS = ((1, 1), (1, -1), (-1, -1), (-1, 1))


def place(
    local_x: Column,
    local_y: Column,
    center_x: Column,
    center_y: Column,
    cos_yaw: Column,
    sin_yaw: Column,
) -> tuple[Column, Column]:
    """Turn box coordinates by yaw and move them to the box centre."""
    return (
        center_x + cos_yaw * local_x - sin_yaw * local_y,
        center_y + sin_yaw * local_x + cos_yaw * local_y,
    )


def pixel_row(world_x: Column, spec: GridSpec) -> Column:
    """Truncates toward zero and keeps pixels outside the grid; NULL where the
    pixel does not fit an INT."""
    return ((world_x - F.lit(spec.x_min)) / F.lit(spec.resolution)).try_cast("int")


def pixel_col(world_y: Column, spec: GridSpec) -> Column:
    return ((world_y - F.lit(spec.y_min)) / F.lit(spec.resolution)).try_cast("int")


def _corners() -> list[tuple[str, str]]:
    """World (x, y) of each corner of an object row, as SQL."""
    at = "cast({} as double)".format
    corners = []
    for along, across in CORNER_SIGNS:
        local_x, local_y = f"({along}D * length / 2)", f"({across}D * width / 2)"
        corners.append(
            (
                f"{at('x')} + cos(yaw) * {local_x} - sin(yaw) * {local_y}",
                f"{at('y')} + sin(yaw) * {local_x} + cos(yaw) * {local_y}",
            )
        )
    return corners


def corner_structs() -> Column:
    """ARRAY<STRUCT<wx, wy>> of the four corners of an object row."""
    corners = (f"named_struct('wx', {wx}, 'wy', {wy})" for wx, wy in _corners())
    return F.expr(f"array({', '.join(corners)})")


def corner_pixels(spec: GridSpec) -> list[tuple[str, str]]:
    """(px_col, px_row) of the four corners of an object row, as SQL."""

    def pixel(world: str, low: float) -> str:
        return f"try_cast(({world} - {low!r}D) / {spec.resolution!r}D as int)"

    return [(pixel(wy, spec.y_min), pixel(wx, spec.x_min)) for wx, wy in _corners()]
