"""Point tables as Parquet, the layout for large data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_points(points: DataFrame, path: str, layout: str = "as_is") -> None:
    """Replaces `path`.

    as_is      keeps the partitioning of `points`: no exchange.
    clustered  sorted by frame and place, so that a frame and a region touch few
               row groups. Ranges are cut the same way: a large frame spans
               several files, each a strip of it.
    by_frame   clustered, with a directory per frame; for few, large frames.
    """
    if layout not in ("as_is", "clustered", "by_frame"):
        raise ValueError(f"unknown layout {layout!r}")
    writer = points
    if layout != "as_is":
        order = ("frame_id", "x", "y")
        writer = points.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = writer.write.mode("overwrite")
    if layout == "by_frame":
        writer = writer.partitionBy("frame_id")
    writer.parquet(path)
