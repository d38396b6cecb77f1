"""Class colours, packed as one INT: blue * 65536 + green * 256 + red."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlark.spec import CLASS_COLORS, DEFAULT_COLOR

Color = tuple[int, int, int]


def _packed(color: Color) -> int:
    blue, green, red = color
    return (blue << 16) | (green << 8) | red


def class_color(
    class_name: Column,
    colors: Mapping[str, Color] | None = None,
    default: Color = DEFAULT_COLOR,
) -> Column:
    """Left-outer lookup in a fixed table. The table is a handful of literals,
    so a CASE expression replaces the join and its exchange."""
    found = F.lit(None).cast("int")
    for name, color in reversed((CLASS_COLORS if colors is None else colors).items()):
        found = F.when(class_name == F.lit(name), F.lit(_packed(color))).otherwise(found)
    return F.coalesce(found, F.lit(_packed(default)))


def pack_bgr(gray: Column) -> Column:
    """A grey level as three equal channels."""
    return gray * F.lit(0x010101)


def unpack_bgr(packed: Column) -> dict[str, Column]:
    """The channels of the low 24 bits of an INT or BIGINT."""
    return {
        channel: F.shiftright(packed, shift).bitwiseAND(F.lit(255)).cast("int")
        for channel, shift in (("b", 16), ("g", 8), ("r", 0))
    }
