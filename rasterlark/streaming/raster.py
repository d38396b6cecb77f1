"""The raster kept up to date over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterlark.functions import cell_col, cell_row, gray_level, usable_intensity
from rasterlark.operators.raster import (
    DEFAULT_GRID,
    coordinate_width,
    crop,
    pack_cell,
    split_cell,
)
from rasterlark.spec import GridSpec


def _window_levels(
    points: DataFrame, event_time: str, window: str, spec: GridSpec
) -> DataFrame:
    """Largest grey level per window, frame and cell of the points at hand."""
    row, col = split_cell(spec)
    width = coordinate_width(points)
    return (
        crop(points, spec)
        .filter(usable_intensity(F.col("intensity")))
        .select(
            event_time,
            "frame_id",
            pack_cell(
                cell_row(F.col("x"), spec, width),
                cell_col(F.col("y"), spec, width),
                spec,
            ).alias("cell"),
            gray_level(F.col("intensity")).alias("gray"),
        )
        .groupBy(F.window(event_time, window).alias("span"), "frame_id", "cell")
        .agg(F.max("gray").alias("gray"))
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "frame_id",
            row.alias("cell_row"),
            col.alias("cell_col"),
            "gray",
        )
    )


def stream_bev(
    points: DataFrame,
    event_time: str,
    window: str,
    lateness: str,
    spec: GridSpec = DEFAULT_GRID,
) -> DataFrame:
    """One raster per frame and event-time window: (window_start, window_end,
    frame_id, cell_row, cell_col, gray).

    The maximum is combined before the exchange and kept as one number per
    cell in the state store; the watermark drops the cells of a closed window.
    In append mode a window appears once, when it is closed: points later than
    `lateness` are lost and open windows are not there yet. `write_windows`
    loses nothing.
    """
    return _window_levels(points.withWatermark(event_time, lateness), event_time, window, spec)


def write_windows(
    points: DataFrame,
    event_time: str,
    window: str,
    path: str,
    checkpoint: str,
    spec: GridSpec = DEFAULT_GRID,
) -> StreamingQuery:
    """Starts a query that stores every window of a stream, up to the newest,
    for `read_windows`; it ends when what is there has been read.

    Each micro-batch writes its own maxima, in a folder that a repeated batch
    replaces. The maximum of maxima is taken when reading, so no order of points
    is late, nothing is kept in state and the result is the same however the
    input is cut into batches.
    """

    def store(batch: DataFrame, number: int) -> None:
        levels = _window_levels(batch, event_time, window, spec)
        levels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        points.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Raster per window: (window_start, window_end, frame_id, cell_row,
    cell_col, gray)."""
    keys = ("window_start", "window_end", "frame_id", "cell_row", "cell_col")
    return spark.read.parquet(path).groupBy(*keys).agg(F.max("gray").alias("gray"))
