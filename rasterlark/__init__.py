"""Bird's-eye-view rasters of point frames, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from rasterlark.operators.boxes import (
    box_corners_bev,
    box_labels,
    with_color,
    world_to_pixel,
)
from rasterlark.operators.generate import (
    generate_frame,
    generate_frames,
    make_objects,
    sample_points_for_box,
)
from rasterlark.operators.raster import densify, points_to_bev, rotate, scatter_max
from rasterlark.operators.render import draw_objects, painted_pixels, render_frames
from rasterlark.plans.workflows import save_sample, visualize
from rasterlark.session import build_session
from rasterlark.spec import CLASS_COLORS, GridSpec, SceneSpec

# Tasks carry the code they run, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "CLASS_COLORS",
    "GridSpec",
    "SceneSpec",
    "box_corners_bev",
    "box_labels",
    "build_session",
    "densify",
    "draw_objects",
    "generate_frame",
    "generate_frames",
    "make_objects",
    "painted_pixels",
    "points_to_bev",
    "render_frames",
    "rotate",
    "sample_points_for_box",
    "save_sample",
    "scatter_max",
    "visualize",
    "with_color",
    "world_to_pixel",
]
