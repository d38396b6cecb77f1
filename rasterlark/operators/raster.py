"""Points to bird's-eye-view cells.

Tables: points(frame_id, x, y, intensity, ...) and the sparse raster
bev(frame_id, cell_row, cell_col, gray). Rows are x bins, columns are y bins.

The scatter-max is one hash aggregate. Its partial half runs before the
exchange, so a cell or frame that holds a large share of all points reaches the
exchange as at most one row per cell and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlark.functions import (
    cell_col,
    cell_row,
    gray_level,
    in_roi,
    pack_bgr,
    unpack_bgr,
    usable_intensity,
)
from rasterlark.spec import (
    DEFAULT_RESOLUTION,
    DEFAULT_X_RANGE,
    DEFAULT_Y_RANGE,
    GridSpec,
)

DEFAULT_GRID = GridSpec()


def coordinate_width(points: DataFrame) -> str:
    """FLOAT coordinates are binned as FLOAT, all other types as DOUBLE."""
    types = dict(points.dtypes)
    return "float" if types["x"] == types["y"] == "float" else "double"


def crop(points: DataFrame, spec: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Points of the region of interest."""
    return points.filter(
        in_roi(F.col("x"), F.col("y"), spec, coordinate_width(points))
    )


def locate(points: DataFrame, spec: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Points of the region of interest with their cell."""
    width = coordinate_width(points)
    return (
        crop(points, spec)
        .withColumn("cell_row", cell_row(F.col("x"), spec, width))
        .withColumn("cell_col", cell_col(F.col("y"), spec, width))
    )


def pack_cell(row: Column, col: Column, spec: GridSpec) -> Column:
    """One BIGINT per cell: a narrower grouping key than the pair."""
    return row.cast("bigint") * F.lit(spec.width) + col


def split_cell(spec: GridSpec, key: str = "cell") -> tuple[Column, Column]:
    """Row and column of a packed cell column."""
    return (
        F.expr(f"cast({key} div {spec.width} as int)"),
        F.expr(f"cast({key} % {spec.width} as int)"),
    )


def scatter_max(points: DataFrame, spec: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Largest intensity per cell, never below 0: (frame_id, cell_row,
    cell_col, max_intensity). A NaN or NULL intensity takes no part."""
    width = coordinate_width(points)
    row, col = split_cell(spec)
    return (
        crop(points, spec)
        .filter(usable_intensity(F.col("intensity")))
        .select(
            "frame_id",
            pack_cell(
                cell_row(F.col("x"), spec, width),
                cell_col(F.col("y"), spec, width),
                spec,
            ).alias("cell"),
            F.col("intensity").cast("float").alias("intensity"),
        )
        .groupBy("frame_id", "cell")
        .agg(
            F.greatest(F.lit(0.0).cast("float"), F.max("intensity")).alias(
                "max_intensity"
            )
        )
        .select("frame_id", row.alias("cell_row"), col.alias("cell_col"), "max_intensity")
    )


def quantize(bev: DataFrame) -> DataFrame:
    """Grey level of every cell: (frame_id, cell_row, cell_col, gray)."""
    return bev.select(
        "frame_id", "cell_row", "cell_col", gray_level(F.col("max_intensity")).alias("gray")
    )


def point_levels(points: DataFrame, spec: GridSpec = DEFAULT_GRID) -> DataFrame:
    """Grey level of every point, before any aggregation. Quantising is
    monotone, so the maximum of these levels is the level of the maximum."""
    return (
        locate(points, spec)
        .filter(usable_intensity(F.col("intensity")))
        .select(
            "frame_id", "cell_row", "cell_col", gray_level(F.col("intensity")).alias("gray")
        )
    )


def frames_of(points: DataFrame) -> DataFrame:
    """Every frame with a point, inside the region or not."""
    return points.select("frame_id").distinct()


def densify(
    bev: DataFrame, frames: DataFrame, spec: GridSpec = DEFAULT_GRID
) -> DataFrame:
    """Every cell of every frame, 0 where the sparse raster has none.

    `frames` holds distinct frame_id values; a frame of the raster that is not
    among them fails, as does a frame listed twice. Only the sparse cells and one
    marker per grid row are exchanged; each of them then fills the gap up to
    the next occupied cell of its row, so the dense domain is produced after
    the exchange and never joined or shuffled.
    """
    markers = frames.select(
        "frame_id",
        F.explode(F.sequence(F.lit(0), F.lit(spec.height - 1))).alias("cell_row"),
        F.lit(-1).alias("cell_col"),
        F.lit(0).alias("gray"),
    )
    # At most one row per column plus the marker in a window partition.
    along_row = Window.partitionBy("frame_id", "cell_row").orderBy("cell_col")
    starts_row = F.lag("cell_col", 1).over(along_row).isNull()
    return (
        bev.select("frame_id", "cell_row", "cell_col", "gray")
        .unionByName(markers)
        .withColumn("starts_row", starts_row)
        .withColumn("gap_end", F.lead("cell_col", 1, spec.width).over(along_row) - 1)
        .withColumn(
            "cell_col",
            F.when(F.col("starts_row") == (F.col("cell_col") < 0), F.col("cell_col")).otherwise(
                F.raise_error(F.lit("the list of frames lacks a frame or has one twice")).cast("int")
            ),
        )
        .select(
            "frame_id",
            "cell_row",
            F.col("cell_col").alias("own_col"),
            F.col("gray").alias("own_gray"),
            F.explode(F.sequence("cell_col", "gap_end")).alias("cell_col"),
        )
        .filter(F.col("cell_col") >= 0)
        .select(
            "frame_id",
            "cell_row",
            "cell_col",
            F.when(F.col("cell_col") == F.col("own_col"), F.col("own_gray"))
            .otherwise(F.lit(0))
            .alias("gray"),
        )
    )


def rotate(cells: DataFrame, spec: GridSpec = DEFAULT_GRID) -> DataFrame:
    """A quarter turn counter-clockwise: cell_row/cell_col become
    out_row/out_col, forward to the right and left upwards."""
    others = [c for c in cells.columns if c not in ("frame_id", "cell_row", "cell_col")]
    return cells.select(
        "frame_id",
        (F.lit(spec.width - 1) - F.col("cell_col")).alias("out_row"),
        F.col("cell_row").alias("out_col"),
        *others,
    )


def to_bgr(bev: DataFrame) -> DataFrame:
    """Grey to three equal channels."""
    channels = unpack_bgr(pack_bgr(F.col("gray")))
    return bev.select(
        "frame_id", "cell_row", "cell_col", *(c.alias(n) for n, c in channels.items())
    )


def points_to_bev(
    points: DataFrame,
    x_range: tuple[float, float] = DEFAULT_X_RANGE,
    y_range: tuple[float, float] = DEFAULT_Y_RANGE,
    resolution: float = DEFAULT_RESOLUTION,
    dense: bool = False,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Raster of every frame: (frame_id, cell_row, cell_col, gray).

    Sparse by default; `dense` adds the empty cells of `frames`, distinct
    frame_id values. Without that list a second scan of the frame_id column of
    `points` finds them.
    """
    spec = GridSpec.of(x_range, y_range, resolution)
    bev = quantize(scatter_max(points, spec))
    if not dense:
        return bev
    return densify(bev, frames_of(points) if frames is None else frames, spec)
