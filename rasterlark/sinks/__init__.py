"""Writers. Each creates its directory and replaces outputs of the same name."""

from rasterlark.sinks.documents import (
    write_object_files,
    write_object_lines,
)
from rasterlark.sinks.npz import write_npz
from rasterlark.sinks.png import decode_png, write_png
from rasterlark.sinks.scratch import scratch_directory
from rasterlark.sinks.tables import write_points

__all__ = [
    "decode_png",
    "scratch_directory",
    "write_npz",
    "write_object_files",
    "write_object_lines",
    "write_png",
    "write_points",
]
