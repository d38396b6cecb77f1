"""Every registered query: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.operators import boxes, generate, kalman, matching, overlap, raster, render, scan, tracking
from rasterlark.plans.fixtures import stream_view, view
from rasterlark.sinks import (
    decode_png,
    scratch_directory,
    write_npz,
    write_object_files,
    write_object_lines,
    write_png,
    write_points,
)
from rasterlark.sources import read_npz, read_objects, read_points
from rasterlark.streaming import read_windows, write_windows

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- raster -----------------------------------------------------------------


@_register
def roi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.crop(view(spark, sf_dir, "points_v")).select(
        "frame_id", "x", "y", "intensity"
    )


@_register
def cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.locate(view(spark, sf_dir, "points_v")).select(
        "frame_id", "x", "y", "cell_row", "cell_col"
    )


@_register
def point_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.point_levels(view(spark, sf_dir, "points_v"))


@_register
def bev_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.scatter_max(view(spark, sf_dir, "points_v"))


@_register
def bev_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.points_to_bev(view(spark, sf_dir, "points_v"))


@_register
def bev_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.points_to_bev(view(spark, sf_dir, "points_v"), dense=True)


@_register
def bev_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rotate(raster.points_to_bev(view(spark, sf_dir, "points_v")))


@_register
def bev_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.to_bgr(raster.points_to_bev(view(spark, sf_dir, "points_v")))


# -- generated frames -------------------------------------------------------


@_register
def scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.make_objects(view(spark, sf_dir, "frames_v"))


@_register
def class_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = view(spark, sf_dir, "objects_v")
    return objects.select(
        "frame_id",
        "id",
        "class_name",
        F.explode(
            F.sequence(F.lit(1), generate.sample_count(F.col("class_name")))
        ).alias("sample"),
    )


@_register
def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.background_points(view(spark, sf_dir, "frames_v"))


@_register
def box_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.sample_points_for_box(view(spark, sf_dir, "objects_v"))


@_register
def frame_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.generate_frames(view(spark, sf_dir, "frames_v"))


# -- boxes ------------------------------------------------------------------


@_register
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.box_corners_bev(view(spark, sf_dir, "objects_v")).select(
        "frame_id",
        "id",
        "corner",
        F.round("wx", 6).alias("wx"),
        F.round("wy", 6).alias("wy"),
    )


@_register
def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = boxes.box_corners_bev(view(spark, sf_dir, "objects_v"))
    return boxes.world_to_pixel(corners).select(
        "frame_id", "id", "corner", "px_col", "px_row"
    )


@_register
def class_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.with_color(view(spark, sf_dir, "objects_v")).select(
        "frame_id", "id", "class_name", "b", "g", "r"
    )


@_register
def box_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.box_labels(view(spark, sf_dir, "objects_v"))


# -- boxes, points and other boxes -------------------------------------------------


@_register
def points_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.remove_inside(
        view(spark, sf_dir, "points_v"), view(spark, sf_dir, "objects_v")
    ).select("frame_id", "x", "y")


@_register
def box_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.box_overlaps(view(spark, sf_dir, "detections_v")).select(
        "frame_id",
        "id_a",
        "id_b",
        F.round("intersection", 6).alias("intersection"),
        F.round("iou", 6).alias("iou"),
    )


@_register
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.suppress(view(spark, sf_dir, "detections_v"), least_iou=0.3).select(
        "frame_id", "id", "class_name", "score"
    )


@_register
def matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of even number matched with those of odd number, frame by frame."""
    boxes_v = view(spark, sf_dir, "detections_v")
    pairs = matching.gated_pairs(boxes_v.where("id % 2 = 0"), boxes_v.where("id % 2 = 1"), 2.5)
    return matching.match(pairs)


@_register
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kalman.filter_tracks(view(spark, sf_dir, "tracks_v"))
    numbers = ("x", "vx", "y", "vy", "var_place", "var_velocity")
    return found.select("track_id", "frame_id", *(F.round(n, 6).alias(n) for n in numbers))


@_register
def tracked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.track_objects(view(spark, sf_dir, "sightings_v")).select(
        "scene_id", "frame_id", "id", "track", "hits", "confirmed"
    )


# -- the sensor's view --------------------------------------------------------------


@_register
def visible_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of bins of a degree, what lies within a metre behind the nearest point."""
    points = view(spark, sf_dir, "scans_v")
    return scan.visible_points(points, azimuths=360, elevations=180, thickness=1.0).select(
        "frame_id", "point_id", "range_mm", "azimuth", "elevation"
    )


@_register
def visible_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.sample_visible_sides(view(spark, sf_dir, "objects_v"))


@_register
def ground_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ground_points(view(spark, sf_dir, "frames_v"))


# -- drawing ----------------------------------------------------------------


@_register
def box_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.box_outline(view(spark, sf_dir, "objects_v"))


@_register
def label_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.label_strokes(view(spark, sf_dir, "objects_v"))


@_register
def painted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.painted_pixels(view(spark, sf_dir, "objects_v"))


@_register
def annotated_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_frames(
        view(spark, sf_dir, "points_v"), view(spark, sf_dir, "objects_v")
    )


@_register
def draw_on_bev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.draw_objects(
        raster.points_to_bev(view(spark, sf_dir, "points_v")),
        view(spark, sf_dir, "objects_v"),
    )


# -- files and tables: written to the scratch folder and read back --------------


@_register
def stored_bev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points stored by frame, then rasterised from the stored table."""
    path = scratch_directory(spark, "points")
    write_points(view(spark, sf_dir, "points_v"), path, layout="clustered")
    return raster.points_to_bev(read_points(spark, path))


@_register
def npz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = scratch_directory(spark, "npz")
    write_npz(view(spark, sf_dir, "scans_v"), directory)
    return read_npz(spark, directory)


@_register
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indented document per frame."""
    directory = scratch_directory(spark, "documents")
    write_object_files(view(spark, sf_dir, "objects_v"), directory)
    return read_objects(spark, directory)


@_register
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per line."""
    path = scratch_directory(spark, "lines")
    write_object_lines(view(spark, sf_dir, "objects_v"), path)
    return read_objects(spark, path, multi_line=False)


def _shown_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            frame_id = path.as_py().rsplit("_", 1)[-1].removesuffix(".png")
            picture = decode_png(content.as_py())
            rows, cols = np.nonzero(picture.any(axis=2))
            shown = {"out_row": rows, "out_col": cols}
            shown |= {c: picture[rows, cols, i] for i, c in enumerate("rgb")}
            arrays = [pa.array(v.astype(np.int32)) for v in shown.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([frame_id] * len(rows), pa.string()), *arrays],
                names=["frame_id", *shown],
            )


@_register
def png_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written and decoded again: every pixel that is not black."""
    points = view(spark, sf_dir, "scans_v")
    objects = view(spark, sf_dir, "objects_v")
    directory = scratch_directory(spark, "png")
    write_png(
        render.render_frames(points, objects), directory, frames=raster.frames_of(points)
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(directory)
    return files.select("path", "content").mapInArrow(
        _shown_pixels, "frame_id STRING, out_row INT, out_col INT, r INT, g INT, b INT"
    )


@_register
def sequential_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of frames drawn from the sequential stream of their seed."""
    return generate.generate_frames(view(spark, sf_dir, "frames_v"), mode="sequential")


# -- streams ----------------------------------------------------------------------


@_register
def bev_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster of every window of 30 days, as a stream over the point table
    run until it is used up."""
    base = scratch_directory(spark, "stream")
    points = stream_view(spark, sf_dir, "points_v")
    running = write_windows(points, "scanned_at", "30 days", f"{base}/bev", f"{base}/checkpoint")
    running.awaitTermination()
    return read_windows(spark, f"{base}/bev").withColumns(
        {edge: F.unix_seconds(edge) for edge in ("window_start", "window_end")}
    )
