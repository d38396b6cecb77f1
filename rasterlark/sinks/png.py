"""PNG pictures, one per frame.

Pixels arrive sorted by frame and picture row and are deflated as they come.
A task holds one band of lines, not a picture, and the empty pixels of a frame
exist only in that band.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.sinks.files import absolute, create_directory, file_name, whole_file
from rasterlark.spec import GridSpec

SIGNATURE = b"\x89PNG\r\n\x1a\n"
COMPRESSION = 3
BAND_LINES = 64
COLOR_BITS = 24


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(
        ">I", zlib.crc32(kind + data)
    )


class _Picture:
    """An 8-bit RGB picture that is filled from top to bottom."""

    def __init__(self, directory: str, name: str, width: int, height: int) -> None:
        self._stack = ExitStack()
        self._stream = self._stack.enter_context(whole_file(directory, name))
        self._width, self._height = width, height
        self._deflate = zlib.compressobj(COMPRESSION)
        self._top = 0
        self._band = np.zeros((BAND_LINES, width, 3), np.uint8)
        header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        self._stream.write(SIGNATURE + _chunk(b"IHDR", header))

    def _emit(self, data: bytes) -> None:
        if data:
            self._stream.write(_chunk(b"IDAT", data))

    def _finish_band(self) -> None:
        count = min(BAND_LINES, self._height - self._top)
        # Each line starts with filter type 0.
        lines = np.zeros((count, 1 + 3 * self._width), np.uint8)
        lines[:, 1:] = self._band[:count].reshape(count, -1)
        self._emit(self._deflate.compress(lines.tobytes()))
        self._band[:] = 0
        self._top += count

    def add(self, pixels: np.ndarray) -> None:
        places = pixels >> COLOR_BITS
        rows, cols = places // self._width, places % self._width
        rgb = np.stack([pixels & 255, pixels >> 8 & 255, pixels >> 16 & 255], axis=1)
        begin = 0
        while begin < len(rows):
            while rows[begin] >= self._top + BAND_LINES:
                self._finish_band()
            end = int(np.searchsorted(rows, self._top + BAND_LINES))
            self._band[rows[begin:end] - self._top, cols[begin:end]] = rgb[begin:end]
            begin = end

    def close(self) -> None:
        while self._top < self._height:
            self._finish_band()
        self._emit(self._deflate.flush())
        self._stream.write(_chunk(b"IEND", b""))
        self._stack.close()

    def discard(self, error: BaseException) -> None:
        self._stack.__exit__(type(error), error, error.__traceback__)


def _writer(
    directory: str, width: int, height: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, picture, files = None, None, 0
        try:
            for batch in batches:
                frames = batch.column("frame_id").dictionary_encode()
                codes = frames.indices.to_numpy()
                pixels = batch.column("pixel").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
                for start, stop in zip(starts, starts[1:]):
                    if start == stop:
                        continue
                    frame = frames.dictionary[codes[start]].as_py()
                    if frame != current:
                        if picture is not None:
                            picture.close()
                        current, files = frame, files + 1
                        name = file_name("bev_frame", current, "png")
                        picture = _Picture(directory, name, width, height)
                    # A frame marker is -1 and sorts first.
                    while start < stop and pixels[start] < 0:
                        start += 1
                    picture.add(pixels[start:stop])
            if picture is not None:
                picture.close()
        except BaseException as error:
            if picture is not None:
                picture.discard(error)
            raise
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_png(
    image: DataFrame,
    directory: str,
    spec: GridSpec = GridSpec(),
    frames: DataFrame | None = None,
) -> int:
    """Writes image(frame_id, out_row, out_col, b, g, r), the turned picture;
    returns the number of files. `frames` adds pictures for frames without
    pixels. A pixel outside the picture of `spec`, as from an image of another
    grid, and a NULL frame_id fail."""
    directory = absolute(image.sparkSession, directory)
    create_directory(directory)
    inside = (
        f"frame_id IS NOT NULL AND out_row BETWEEN 0 AND {spec.width - 1} "
        f"AND out_col BETWEEN 0 AND {spec.height - 1}"
    )
    # Place and colour in one number: a narrow row and a single sort key.
    pixels = image.selectExpr(
        "frame_id",
        f"CASE WHEN {inside} THEN "
        f"shiftleft(cast(out_row as bigint) * {spec.height} + out_col, {COLOR_BITS})"
        " + b * 65536 + g * 256 + r "
        "ELSE raise_error('a pixel lies outside the picture or has no frame') END AS pixel",
    )
    if frames is not None:
        pixels = pixels.unionByName(
            frames.select("frame_id", F.lit(-1).cast("bigint").alias("pixel"))
        )
    written = (
        pixels.withColumn("frame_id", F.col("frame_id").cast("string"))
        # A frame has at most one row per pixel of the grid, whatever its points.
        .repartition("frame_id")
        .sortWithinPartitions("frame_id", "pixel")
        .mapInArrow(_writer(directory, spec.height, spec.width), "files BIGINT")
    )
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def decode_png(content: bytes) -> np.ndarray:
    """(rows, columns, RGB) of a picture made by `write_png`."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, size = 8, [], (0, 0)
    while at < len(content):
        (length,) = struct.unpack_from(">I", content, at)
        kind, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + length]
        (checksum,) = struct.unpack_from(">I", content, at + 8 + length)
        if checksum != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    lines = lines.reshape(height, 1 + 3 * width)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].reshape(height, width, 3)
