"""Compressed NumPy archives, one per frame, array name `points`.

Points arrive sorted by frame and point_id and are deflated as they come: a
task holds one batch, not a frame. One file per frame means one task per frame;
for frames too large for that, use Parquet.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.sinks.files import absolute, create_directory, file_name, whole_file

FIELDS = ("x", "y", "z", "intensity")


class _Archive:
    """An archive of a known number of rows, filled from the start."""

    def __init__(self, directory: str, frame_id: str, rows: int, kind: np.dtype) -> None:
        self._stack = ExitStack()
        name = file_name("frame", frame_id, "npz")
        stream = self._stack.enter_context(whole_file(directory, name))
        archive = self._stack.enter_context(zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED))
        member = archive.open("points.npy", "w", force_zip64=True)
        self._member = self._stack.enter_context(member)
        header = {"descr": kind.str, "fortran_order": False, "shape": (rows, len(FIELDS))}
        npy.write_array_header_1_0(self._member, header)
        self._frame, self._rows, self._next, self._kind = frame_id, rows, 0, kind

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        if not np.array_equal(ids, np.arange(self._next, self._next + len(ids))):
            raise ValueError(f"point_id of frame {self._frame} does not run from 0 without gaps")
        self._member.write(np.ascontiguousarray(points, self._kind).tobytes())
        self._next += len(ids)

    def close(self) -> None:
        if self._next != self._rows:
            raise ValueError(f"frame {self._frame} has {self._next} of {self._rows} points")
        self._stack.close()

    def discard(self, error: BaseException) -> None:
        self._stack.__exit__(type(error), error, error.__traceback__)


def _writer(
    directory: str, double: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.dtype("<f8" if double else "<f4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, archive, files, total = None, None, 0, 0
        try:
            for batch in batches:
                frames = batch.column("frame_id").dictionary_encode()
                codes = frames.indices.to_numpy()
                ids = batch.column("point_id").to_numpy()
                points = np.column_stack([batch.column(f).to_numpy() for f in FIELDS])
                starts = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
                for start, stop in zip(starts, starts[1:]):
                    if start == stop:
                        continue
                    frame = frames.dictionary[codes[start]].as_py()
                    if frame != current:
                        if archive is not None:
                            archive.close()
                        current, files = frame, files + 1
                        rows = batch.column("rows")[start].as_py()
                        archive = _Archive(directory, frame, rows, kind)
                    archive.add(ids[start:stop], points[start:stop])
                    total += stop - start
            if archive is not None:
                archive.close()
        except BaseException as error:
            if archive is not None:
                archive.discard(error)
            raise
        yield pa.RecordBatch.from_pydict(
            {"files": pa.array([files], pa.int64()), "rows": pa.array([total], pa.int64())}
        )

    return write


def write_npz(points: DataFrame, directory: str) -> tuple[int, int]:
    """Writes points(frame_id, point_id, x, y, z, intensity); returns the number
    of files and rows.

    A frame is one file, whatever its size, and replaces an older one. point_id
    must number the points of a frame from 0; a gap, a duplicate or a NULL
    frame_id or point_id fails. Archives are float64 if x or y is DOUBLE.
    """
    directory = absolute(points.sparkSession, directory)
    create_directory(directory)
    types = dict(points.dtypes)
    double = "double" in (types["x"], types["y"])
    refuse = "raise_error('frame_id and point_id must not be NULL')"
    rows = points.select(
        F.expr(f"coalesce(cast(frame_id AS string), {refuse})").alias("frame_id"),
        F.expr(f"coalesce(bigint(point_id), {refuse})").alias("point_id"),
        *(F.col(f).cast("double" if double else "float").alias(f) for f in FIELDS),
    )
    # The header of an archive states the number of rows. The count is taken over
    # the exchange and order that the files need anyway; Spark spills large frames.
    frame = Window.partitionBy("frame_id").orderBy("point_id")
    frame = frame.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    written = (
        rows.withColumn("rows", F.count("*").over(frame))
        .select("frame_id", "point_id", *FIELDS, "rows")
        .mapInArrow(_writer(directory, double), "files BIGINT, rows BIGINT")
        .agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)))
        .first()
    )
    return written[0], written[1]
