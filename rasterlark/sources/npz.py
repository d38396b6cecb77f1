"""Compressed NumPy archives as a point table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.sinks.files import parse_file_name

ROWS_PER_BATCH = 65536
MEMBER = "points.npy"


def _header(member: IO[bytes]) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = npy.read_magic(member)
    header = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
    return header(member)


def _row_blocks(content: bytes) -> Iterator[np.ndarray]:
    """Rows of the array, inflated a block at a time. Object arrays are refused."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(MEMBER) as member:
        shape, column_major, dtype = _header(member)
        if dtype.hasobject or len(shape) != 2 or shape[1] < 4:
            raise ValueError(f"expected a number array of four columns, got {shape} {dtype}")
        if column_major:
            body = np.frombuffer(member.read(), dtype)
            yield body.reshape(shape, order="F")
            return
        left, width = shape
        while left:
            count = min(left, ROWS_PER_BATCH)
            yield np.frombuffer(member.read(count * width * dtype.itemsize), dtype).reshape(
                count, width
            )
            left -= count


def _decoder(width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = np.float64 if width == "double" else np.float32

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                frame_id, start = parse_file_name(path.as_py()), 0
                for block in _row_blocks(content.as_py()):
                    count = len(block)
                    columns = [np.ascontiguousarray(block[:, i], dtype=kind) for i in range(4)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([frame_id] * count, pa.string()),
                            pa.array(np.arange(start, start + count, dtype=np.int64)),
                            *(pa.array(c) for c in columns),
                        ],
                        names=["frame_id", "point_id", "x", "y", "z", "intensity"],
                    )
                    start += count

    return decode


def _is_double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether an archive's own width is more than a FLOAT holds."""
    for batch in batches:
        found = []
        for content in batch.column("content"):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                with archive.open(MEMBER) as member:
                    found.append(np.result_type(_header(member)[2], np.float32) != np.float32)
        yield pa.RecordBatch.from_pydict({"double": pa.array(found, pa.bool_())})


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    )


def npz_frames(spark: SparkSession, path: str) -> DataFrame:
    """The distinct frame_id of the archives, from their names alone: without
    the content column no file is opened."""
    stem = F.regexp_extract("path", r"[^/_]*_([^/]*)\.npz$", 1)
    return _archives(spark, path).select(F.url_decode(stem).alias("frame_id")).distinct()


def read_npz(spark: SparkSession, path: str, width: str | None = None) -> DataFrame:
    """Points of every frame_<id>.npz under `path`, a file or directory.

    Coordinates are "float" or "double"; without `width` they have the width of
    the first archive's array, whose header alone is looked at. An archive is
    read as one value, which Spark limits to 2 GB.
    """
    archives = _archives(spark, path)
    if width is None:
        first = archives.select("content").limit(1).mapInArrow(_is_double, "double BOOLEAN").first()
        width = "double" if first and first[0] else "float"
    if width not in ("float", "double"):
        raise ValueError(f"unknown width {width!r}")
    schema = "frame_id STRING, point_id BIGINT, " + ", ".join(
        f"{c} {width}" for c in ("x", "y", "z", "intensity")
    )
    return archives.select("path", "content").mapInArrow(_decoder(width), schema)
