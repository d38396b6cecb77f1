"""Object documents: {"frame_id": ..., "objects": [...]}.

Objects arrive sorted by frame and draw_ord and are written as they come, so a
task holds one object and not a frame.
"""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.sinks.files import absolute, create_directory, file_name, whole_file
from rasterlark.spec import OBJECT_STRUCT

OBJECTS_PER_LINE = 10_000
FIELDS = [f.name for f in OBJECT_STRUCT.fields]


def _checked(objects: DataFrame) -> DataFrame:
    """frame_id (STRING), draw_ord (BIGINT) and the fields; NULL keys fail."""
    refuse = "raise_error('frame_id and draw_ord must not be NULL')"
    return objects.select(
        F.expr(f"coalesce(cast(frame_id AS string), {refuse})").alias("frame_id"),
        F.expr(f"coalesce(bigint(draw_ord), {refuse})").alias("draw_ord"),
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in OBJECT_STRUCT.fields),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; two of a frame with one draw_ord fail."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            place = row["frame_id"], row["draw_ord"]
            if place == last and row["draw_ord"] is not None:
                raise ValueError(f"frame {place[0]} has draw_ord {place[1]} twice")
            last = place
            yield row


def _make_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line for each run of rows with one frame and first place."""
    document = None

    def text() -> pa.RecordBatch:
        line = json.dumps(document, ensure_ascii=False)
        return pa.RecordBatch.from_pydict({"value": pa.array([line])})

    for batch in batches:
        for row in batch.to_pylist():
            of = row["frame_id"], row["first"]
            if document is None or of != (document["frame_id"], document["first"]):
                if document is not None:
                    yield text()
                document = {"frame_id": row["frame_id"], "first": row["first"],
                            "total": row["total"], "objects": []}
            document["objects"].append({f: row[f] for f in FIELDS})
    if document is not None:
        yield text()


def write_object_lines(
    objects: DataFrame, path: str, objects_per_line: int = OBJECTS_PER_LINE
) -> None:
    """Replaces `path` by JSON lines: few, large files.

    Each line holds `objects_per_line` objects of a frame in drawing order, the
    last one the rest, with the place of its first object and the number of the
    frame's objects, so no line grows without bound and a missing one shows when
    reading. draw_ord must be unique within a frame.

    A frame is cut into ranges of draw_ord, whose sizes added up give each object
    its place; lines go by place. So a frame with very many objects is many tasks.
    """
    per_line = f"{objects_per_line}L"
    keys = ["frame_id", "span"]
    rows = _checked(objects).withColumn("span", F.expr(f"draw_ord div {per_line}"))
    frame = Window.partitionBy("frame_id")
    ahead = frame.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    spans = spans.select(
        *keys,
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"),
        F.sum("n").over(frame).alias("total"),
    )
    inner = Window.partitionBy(*keys).orderBy("draw_ord")
    twice = "raise_error(concat('frame ', frame_id, ' has draw_ord ', draw_ord, ' twice'))"
    placed = (
        rows.join(spans, keys)
        .withColumns({"rank": F.row_number().over(inner), "last": F.lag("draw_ord").over(inner)})
        .withColumn("place", F.expr(f"IF(last = draw_ord, {twice}, before + rank - 1)"))
        .withColumn("first", F.expr(f"place div {per_line} * {per_line}"))
    )
    lines = (
        placed.select("frame_id", "first", "place", "total", *FIELDS)
        .repartition("frame_id", "first")
        .sortWithinPartitions("frame_id", "first", "place")
        .mapInArrow(_make_lines, "value STRING")
    )
    lines.write.mode("overwrite").option("lineSep", "\n").format("text").save(path)


class _Document:
    """An indented document, filled object by object."""

    def __init__(self, directory: str, frame_id: str) -> None:
        self._stack = ExitStack()
        name = file_name("objects", frame_id, "json")
        self._stream = self._stack.enter_context(whole_file(directory, name))
        head = json.dumps({"frame_id": frame_id}, ensure_ascii=False, indent=2)
        self._write(head.removesuffix("\n}") + ',\n  "objects": [')
        self._empty = True

    def _write(self, text: str) -> None:
        self._stream.write(text.encode("utf-8"))

    def add(self, item: dict) -> None:
        text = json.dumps(item, ensure_ascii=False, indent=2)
        self._write(("\n" if self._empty else ",\n") + textwrap.indent(text, "    "))
        self._empty = False

    def close(self) -> None:
        self._write(("]" if self._empty else "\n  ]") + "\n}")
        self._stack.close()

    def discard(self, error: BaseException) -> None:
        self._stack.__exit__(type(error), error, error.__traceback__)


def _writer(directory: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, document, files = None, None, 0
        try:
            for row in _rows(batches):
                if row["frame_id"] != current:
                    if document is not None:
                        document.close()
                    current, files = row["frame_id"], files + 1
                    document = _Document(directory, current)
                # A row without draw_ord stands for the frame alone.
                if row["draw_ord"] is not None:
                    document.add({f: row[f] for f in FIELDS})
            if document is not None:
                document.close()
        except BaseException as error:
            if document is not None:
                document.discard(error)
            raise
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


def write_object_files(
    objects: DataFrame, directory: str, frames: DataFrame | None = None
) -> int:
    """One indented UTF-8 document per frame, whatever its size; returns the
    number of files. draw_ord must be unique within a frame. `frames` adds
    documents for frames without objects."""
    directory = absolute(objects.sparkSession, directory)
    create_directory(directory)
    rows = _checked(objects)
    if frames is not None:
        names = frames.select(F.col("frame_id").cast("string").alias("frame_id"))
        rows = rows.unionByName(names, allowMissingColumns=True)
    written = (
        rows.repartition("frame_id")
        .sortWithinPartitions("frame_id", "draw_ord")
        .mapInArrow(_writer(directory), "files BIGINT")
    )
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
