"""Grid and scene parameters, table schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the published defaults for right results.
# ---------------------------------------------------------------------------
DEFAULT_X_RANGE = (0.0, 40.0)
DEFAULT_Y_RANGE = (-20.0, 20.0)
DEFAULT_RESOLUTION = 0.1
DEFAULT_SEED = 7

BACKGROUND_POINTS = 6000
BACKGROUND_RANGES = {
    "x": (0.0, 40.0),
    "y": (-20.0, 20.0),
    "z": (-1.6, 0.3),
    "intensity": (0.05, 0.35),
}
POINTS_BY_CLASS = {"car": 900}
POINTS_OTHER_CLASS = 220
OBJECT_Z_RANGE = (-0.8, 1.2)
OBJECT_INTENSITY_RANGE = (0.4, 1.0)

# id, class_name, x, y, z, length, width, yaw
SCENE_OBJECTS = (
    (1, "car", 12.0, 3.0, 0.0, 4.5, 1.9, 0.15),
    (2, "car", 24.0, -5.0, 0.0, 4.7, 2.0, -0.25),
    (3, "pedestrian", 18.0, 7.5, 0.0, 0.8, 0.8, 0.0),
    (4, "cone", 8.0, -8.0, 0.0, 0.5, 0.5, 0.0),
)

# Blue, green, red.
CLASS_COLORS = {
    "car": (0, 220, 0),
    "pedestrian": (0, 180, 255),
    "cone": (255, 120, 0),
}
DEFAULT_COLOR = (255, 255, 255)
# ---------------------------------------------------------------------------

OBJECT_STRUCT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("class_name", T.StringType()),
        *(
            T.StructField(name, T.DoubleType())
            for name in ("x", "y", "z", "length", "width", "yaw")
        ),
    ]
)

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.StringType()),
        T.StructField("objects", T.ArrayType(OBJECT_STRUCT)),
    ]
)

POINT_SCHEMA = T.StructType(
    [
        T.StructField("frame_id", T.StringType()),
        T.StructField("point_id", T.LongType()),
        *(
            T.StructField(name, T.FloatType())
            for name in ("x", "y", "z", "intensity")
        ),
    ]
)


@dataclass(frozen=True)
class GridSpec:
    """Region of interest and cell size, shared by raster and drawing operators.

    A range that is not a whole number of cells is refused, so that every point
    of the region has a cell.
    """

    x_min: float = DEFAULT_X_RANGE[0]
    x_max: float = DEFAULT_X_RANGE[1]
    y_min: float = DEFAULT_Y_RANGE[0]
    y_max: float = DEFAULT_Y_RANGE[1]
    resolution: float = DEFAULT_RESOLUTION

    def __post_init__(self) -> None:
        if not self.resolution > 0:
            raise ValueError("resolution must be positive")
        for axis, low, high in (
            ("x", self.x_min, self.x_max),
            ("y", self.y_min, self.y_max),
        ):
            cells = (high - low) / self.resolution
            if not cells >= 0.5:
                raise ValueError(f"{axis} range is empty")
            if abs(cells - round(cells)) > 1e-6:
                raise ValueError(
                    f"{axis} range {low}..{high} is not a whole number of "
                    f"cells of {self.resolution}"
                )

    @classmethod
    def of(
        cls,
        x_range: tuple[float, float] = DEFAULT_X_RANGE,
        y_range: tuple[float, float] = DEFAULT_Y_RANGE,
        resolution: float = DEFAULT_RESOLUTION,
    ) -> GridSpec:
        return cls(*map(float, (*x_range, *y_range, resolution)))

    @property
    def height(self) -> int:
        """Number of rows (x bins)."""
        return round((self.x_max - self.x_min) / self.resolution)

    @property
    def width(self) -> int:
        """Number of columns (y bins)."""
        return round((self.y_max - self.y_min) / self.resolution)


@dataclass(frozen=True)
class SceneSpec:
    """How many points a generated frame holds and where they lie."""

    background_points: int = BACKGROUND_POINTS
    background_ranges: dict[str, tuple[float, float]] = field(
        default_factory=lambda: dict(BACKGROUND_RANGES)
    )
    points_by_class: dict[str, int] = field(
        default_factory=lambda: dict(POINTS_BY_CLASS)
    )
    points_other_class: int = POINTS_OTHER_CLASS
    object_z_range: tuple[float, float] = OBJECT_Z_RANGE
    object_intensity_range: tuple[float, float] = OBJECT_INTENSITY_RANGE
