"""Column expressions. All of them run inside whole-stage codegen."""

from rasterlark.functions.color import class_color, pack_bgr, unpack_bgr
from rasterlark.functions.draws import between, unit_draw
from rasterlark.functions.geometry import (
    corner_pixels,
    corner_structs,
    pixel_col,
    pixel_row,
    place,
)
from rasterlark.functions.grid import (
    cell_col,
    cell_row,
    gray_level,
    in_roi,
    usable_intensity,
)

__all__ = [
    "between",
    "cell_col",
    "cell_row",
    "class_color",
    "corner_pixels",
    "corner_structs",
    "gray_level",
    "in_roi",
    "pack_bgr",
    "pixel_col",
    "pixel_row",
    "place",
    "unit_draw",
    "unpack_bgr",
    "usable_intensity",
]
