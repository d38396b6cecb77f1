from rasterlark.streaming.raster import read_windows, stream_bev, write_windows
from rasterlark.streaming.tracks import stream_tracks

__all__ = ["read_windows", "stream_bev", "stream_tracks", "write_windows"]
