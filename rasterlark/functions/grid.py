"""Region filter, cell index and grey level of a point.

Points are stored as FLOAT and are compared and divided as FLOAT; `width` is
"double" only for point tables that hold DOUBLE coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlark.spec import GridSpec


def number(value: float, width: str) -> Column:
    return F.lit(float(value)).cast(width)


def in_roi(x: Column, y: Column, spec: GridSpec, width: str = "float") -> Column:
    """Half-open on both axes. Literals have the width of the column, so the
    comparison is not widened and reaches the Parquet scan."""
    return (
        (x >= number(spec.x_min, width))
        & (x < number(spec.x_max, width))
        & (y >= number(spec.y_min, width))
        & (y < number(spec.y_max, width))
    )


def _bin(value: Column, low: float, count: int, spec: GridSpec, width: str) -> Column:
    # FLOAT / FLOAT is DOUBLE in Spark: narrow the quotient before truncating,
    # or 12.0 / 0.1 lands in bin 119. Rounding at the upper edge can give
    # `count` for a point inside the region; it belongs to the last bin.
    quotient = (value - number(low, width)) / number(spec.resolution, width)
    return F.least(quotient.cast(width).cast("int"), F.lit(count - 1))


def cell_row(x: Column, spec: GridSpec, width: str = "float") -> Column:
    return _bin(x, spec.x_min, spec.height, spec, width)


def cell_col(y: Column, spec: GridSpec, width: str = "float") -> Column:
    return _bin(y, spec.y_min, spec.width, spec, width)


def usable_intensity(intensity: Column) -> Column:
    return intensity.isNotNull() & ~F.isnan(intensity)


def gray_level(intensity: Column) -> Column:
    """0..255, truncating. Monotone, so it commutes with the maximum."""
    scaled = intensity.cast("float") * number(255, "float")
    return F.greatest(
        number(0, "float"), F.least(number(255, "float"), scaled)
    ).cast("int")
