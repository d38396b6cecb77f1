"""Readers. All take a file or a directory of many frames."""

from rasterlark.sources.documents import read_objects
from rasterlark.sources.npz import npz_frames, read_npz
from rasterlark.sources.tables import read_points

__all__ = ["npz_frames", "read_npz", "read_objects", "read_points"]
