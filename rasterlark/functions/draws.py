"""Counter-based uniform numbers.

A draw depends only on its keys (seed, frame, block, position, axis), never on
partitioning, task order or retries, so a lost executor recomputes the same
points. All keys are BIGINT or STRING columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("u0", "u1", "u2", "u3")


def unit_draw(*keys: Column | int) -> Column:
    """DOUBLE in [0, 1) with 53 random bits."""
    columns = [k if isinstance(k, Column) else F.lit(k).cast("bigint") for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def between(unit: Column, low: Column | float, high: Column | float) -> Column:
    """A unit draw stretched to [low, high)."""
    if not isinstance(low, Column) and not isinstance(high, Column):
        return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return low + (high - low) * unit
