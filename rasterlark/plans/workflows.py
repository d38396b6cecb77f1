"""The two workflows end to end: write a sample, draw what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlark.operators.generate import frame_rows, generate_frames, make_objects
from rasterlark.operators.render import render_frames
from rasterlark.sinks import write_npz, write_object_files, write_png
from rasterlark.sources import npz_frames, read_npz, read_objects
from rasterlark.spec import DEFAULT_SEED, GridSpec

SAMPLE_FRAME = "000001"


def save_sample(
    spark: SparkSession,
    output_dir: str,
    frames: DataFrame | None = None,
    mode: str = "sequential",
) -> int:
    """Points and objects of each frame of `frames(frame_id, seed)` as
    frame_<id>.npz and objects_<id>.json; returns the number of frames."""
    if frames is None:
        frames = frame_rows(spark, [SAMPLE_FRAME], DEFAULT_SEED)
    write_npz(generate_frames(frames, mode=mode), output_dir)
    return write_object_files(make_objects(frames), output_dir, frames)


def visualize(
    spark: SparkSession, data_dir: str, output_dir: str, spec: GridSpec = GridSpec()
) -> int:
    """Draws every frame of `data_dir` to bev_frame_<id>.png; returns the
    number of pictures."""
    image = render_frames(read_npz(spark, data_dir), read_objects(spark, data_dir), spec)
    return write_png(image, output_dir, spec, npz_frames(spark, data_dir))
