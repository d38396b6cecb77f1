"""Synthetic frames: uniform background plus samples inside oriented boxes.

A frame is a row (frame_id, seed, objects ARRAY<STRUCT>). Its points are laid
out in blocks, block 0 for the background and block n for the n-th object, and
point_id is the position in the frame. Blocks are cut into chunks, and it is
chunks, not frames, that are spread over the cluster: a frame or box with very
many points becomes many tasks of bounded size.

Two sources of randomness feed the same column expressions:

- "hashed" (default): counter-based, stays in codegen;
- "sequential": the draws of NumPy's default generator for the seed, column by
  column within a block. A chunk jumps to its place in that stream, so it is
  parallel too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlark.functions import between, place, unit_draw
from rasterlark.functions.draws import AXES
from rasterlark.operators.spread import spread
from rasterlark.spec import DEFAULT_SEED, OBJECT_STRUCT, SCENE_OBJECTS, SceneSpec

CHUNK_POINTS = 65536
SPENT_COLUMNS = ("seed", "chunk_start", "chunk_points")
CHUNK_COLUMNS = [*SPENT_COLUMNS, "block_start", "points"]
DEFAULT_SCENE = SceneSpec()


def scene_array() -> Column:
    """The built-in scene as an ARRAY<STRUCT> literal."""
    return F.array(
        *(
            F.struct(
                *(
                    F.lit(value).cast(field.dataType).alias(field.name)
                    for field, value in zip(OBJECT_STRUCT.fields, row)
                )
            )
            for row in SCENE_OBJECTS
        )
    )


def make_objects(frames: DataFrame) -> DataFrame:
    """The built-in scene's four objects for every row of `frames`:
    (frame_id, draw_ord, id, class_name, x, y, z, length, width, yaw)."""
    return explode_objects(frames.select("frame_id", scene_array().alias("objects")))


def explode_objects(documents: DataFrame) -> DataFrame:
    """One row per object; draw_ord is its place in the list."""
    return documents.select(
        "frame_id", F.posexplode("objects").alias("draw_ord", "o")
    ).select("frame_id", "draw_ord", "o.*")


def sample_count(class_name: Column, scene: SceneSpec = DEFAULT_SCENE) -> Column:
    """Points per object; an unknown or NULL class gets the default."""
    count = F.lit(scene.points_other_class)
    for name, points in scene.points_by_class.items():
        count = F.when(class_name == F.lit(name), F.lit(points)).otherwise(count)
    return count


def frame_rows(
    spark: SparkSession, frame_ids: Sequence[str], seed: int = DEFAULT_SEED
) -> DataFrame:
    """Frame rows of the built-in scene for a short list of ids."""
    return spark.createDataFrame(
        [(f, seed) for f in frame_ids], "frame_id STRING, seed BIGINT"
    )


# -- blocks and chunks ------------------------------------------------------


def _chunks(blocks: DataFrame) -> DataFrame:
    """Cuts blocks(frame_id, block, block_start, points, ...) into chunks. Only
    these descriptors are exchanged."""
    last = F.expr(f"(points - 1) div {CHUNK_POINTS}")
    chunks = (
        blocks.filter("points > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .selectExpr(
            "*",
            f"chunk * {CHUNK_POINTS} AS chunk_start",
            f"least({CHUNK_POINTS}, points - chunk * {CHUNK_POINTS}) AS chunk_points",
        )
    )
    return spread(chunks, "frame_id", "block", "chunk", growth=CHUNK_POINTS // 4).drop("chunk")


def _hashed(chunks: DataFrame) -> DataFrame:
    """Adds sample (position in the block) and the draws u0..u3."""
    # INT and BIGINT hash differently: a frame number of either type is one key.
    frame = F.col("frame_id")
    if dict(chunks.dtypes)["frame_id"] != "string":
        frame = frame.cast("bigint")
    position = F.sequence(
        F.col("chunk_start"), F.col("chunk_start") + F.col("chunk_points") - 1
    )
    return (
        chunks.withColumn(
            "block_key",
            F.xxhash64(F.col("seed").cast("bigint"), frame, F.col("block").cast("bigint")),
        )
        .withColumn("sample", F.explode(position))
        .withColumn("point_key", F.xxhash64("block_key", "sample"))
        .withColumns(
            {name: unit_draw(F.col("point_key"), axis) for axis, name in enumerate(AXES)}
        )
        .drop("block_key", "point_key", "chunk_start", "chunk_points")
    )


class _Stream:
    """A seed's sequential stream, read at any place."""

    def __init__(self, seed: int) -> None:
        self.seed = seed
        self._bits = np.random.PCG64(seed)
        self._generator = np.random.Generator(self._bits)
        self._at = 0

    def read(self, place: int, count: int) -> np.ndarray:
        if place != self._at:
            self._bits.advance(place - self._at)
        self._at = place + count
        return self._generator.random(count)


def _draw_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws of each chunk from its frame's sequential stream. A block takes
    4 * points numbers, one run of `points` per axis."""
    stream = None
    for batch in batches:
        chunks = batch.select(CHUNK_COLUMNS).to_pydict()
        carried = batch.drop_columns(list(SPENT_COLUMNS))
        counts = chunks["chunk_points"]
        begin = 0
        while begin < len(counts):
            # As many whole chunks as fit one output batch, at least one.
            end, total = begin + 1, counts[begin]
            while end < len(counts) and total + counts[end] <= CHUNK_POINTS:
                total, end = total + counts[end], end + 1
            samples = np.empty(total, np.int64)
            units = np.empty((len(AXES), total))
            done = 0
            for i in range(begin, end):
                if stream is None or stream.seed != chunks["seed"][i]:
                    stream = _Stream(chunks["seed"][i])
                first, count = chunks["chunk_start"][i], counts[i]
                part = slice(done, done + count)
                samples[part] = np.arange(first, first + count)
                for axis in range(len(AXES)):
                    place = 4 * chunks["block_start"][i] + axis * chunks["points"][i] + first
                    units[axis, part] = stream.read(place, count)
                done += count
            rows = carried.take(pa.array(np.repeat(np.arange(begin, end), counts[begin:end])))
            arrays = [*rows.columns, pa.array(samples), *map(pa.array, units)]
            yield pa.RecordBatch.from_arrays(
                arrays, names=[*rows.schema.names, "sample", *AXES]
            )
            begin = end


def _sequential(chunks: DataFrame) -> DataFrame:
    fields = [
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in chunks.schema.fields
        if f.name not in SPENT_COLUMNS
    ]
    fields += ["sample BIGINT", *(f"{u} DOUBLE" for u in AXES)]
    # In stream order within a task, so that reading mostly goes on from where
    # it is.
    return chunks.sortWithinPartitions("seed", "block_start", "chunk_start").mapInArrow(
        _draw_stream, ", ".join(fields)
    )


def draws_of(blocks: DataFrame, mode: str = "hashed") -> DataFrame:
    """Blocks(frame_id, seed, block, block_start, points, ..) with a row for each
    of their points: sample and the draws u0..u3."""
    if mode not in ("hashed", "sequential"):
        raise ValueError(f"unknown draw mode {mode!r}")
    chunks = _chunks(blocks)
    return _hashed(chunks) if mode == "hashed" else _sequential(chunks)


# -- points -----------------------------------------------------------------


def _inside_box(scene: SceneSpec) -> dict[str, Column]:
    """World coordinates of a sample of the box columns x, y, length, width, yaw."""
    half_length, half_width = F.col("length") / 2, F.col("width") / 2
    world_x, world_y = place(
        between(F.col("u0"), -half_length, half_length),
        between(F.col("u1"), -half_width, half_width),
        F.col("x"),
        F.col("y"),
        F.cos("yaw"),
        F.sin("yaw"),
    )
    return {
        "x": world_x,
        "y": world_y,
        "z": between(F.col("u2"), *scene.object_z_range),
        "intensity": between(F.col("u3"), *scene.object_intensity_range),
    }


def _narrow(values: dict[str, Column]) -> list[Column]:
    return [value.cast("float").alias(name) for name, value in values.items()]


def background_points(
    frames: DataFrame,
    scene: SceneSpec = DEFAULT_SCENE,
    mode: str = "hashed",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Uniform noise for frames(frame_id, seed): (frame_id, point_id, x, y, z,
    intensity), and hashed points also the columns `keep` of their block."""
    blocks = frames.select(
        "frame_id",
        F.col("seed").cast("bigint").alias("seed"),
        F.lit(0).alias("block"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.lit(scene.background_points).cast("bigint").alias("points"),
    )
    values = {
        name: between(F.col(unit), *scene.background_ranges[name])
        for name, unit in zip(("x", "y", "z", "intensity"), AXES)
    }
    return draws_of(blocks, mode).select(
        "frame_id", F.col("sample").alias("point_id"), *_narrow(values), *keep
    )


def sample_points_for_box(
    objects: DataFrame,
    num_points: Column | int | None = None,
    seed: int = DEFAULT_SEED,
    scene: SceneSpec = DEFAULT_SCENE,
) -> DataFrame:
    """Points inside the boxes of an object table: (frame_id, draw_ord, sample,
    x, y, z, intensity). By default the class decides how many."""
    if num_points is None:
        num_points = sample_count(F.col("class_name"), scene)
    elif not isinstance(num_points, Column):
        num_points = F.lit(num_points)
    blocks = objects.select(
        "frame_id",
        "draw_ord",
        *(F.col(c).cast("double").alias(c) for c in ("x", "y", "length", "width", "yaw")),
        F.lit(seed).cast("bigint").alias("seed"),
        (F.col("draw_ord").cast("bigint") + 1).alias("block"),
        F.lit(0).cast("bigint").alias("block_start"),
        num_points.cast("bigint").alias("points"),
    )
    return draws_of(blocks, "hashed").select(
        "frame_id", "draw_ord", "sample", *_narrow(_inside_box(scene))
    )


def object_points(
    frames: DataFrame, scene: SceneSpec = DEFAULT_SCENE, mode: str = "hashed"
) -> DataFrame:
    """Samples of all boxes of frames(frame_id, seed, objects), placed after
    the background: (frame_id, point_id, x, y, z, intensity)."""
    start = F.lit(scene.background_points).cast("bigint")
    counts = F.transform("objects", lambda o: sample_count(o["class_name"], scene))
    starts = F.aggregate(
        counts,
        F.array(start),
        lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
    )
    blocks = (
        frames.select(
            "frame_id",
            F.col("seed").cast("bigint").alias("seed"),
            F.col("objects"),
            counts.alias("counts"),
            starts.alias("starts"),
        )
        .select(
            "frame_id", "seed", "counts", "starts", F.posexplode("objects").alias("at", "o")
        )
        .select(
            "frame_id",
            "seed",
            (F.col("at") + 1).alias("block"),
            F.get("starts", F.col("at")).alias("block_start"),
            F.get("counts", F.col("at")).cast("bigint").alias("points"),
            *(f"o.{c}" for c in ("x", "y", "length", "width", "yaw")),
        )
    )
    return draws_of(blocks, mode).select(
        "frame_id",
        (F.col("block_start") + F.col("sample")).alias("point_id"),
        *_narrow(_inside_box(scene)),
    )


def generate_frames(
    frames: DataFrame, scene: SceneSpec = DEFAULT_SCENE, mode: str = "hashed"
) -> DataFrame:
    """All points of frames(frame_id [, seed] [, objects]): background first,
    then the objects in list order. Missing columns take the built-in seed and
    scene."""
    if "seed" not in frames.columns:
        frames = frames.withColumn("seed", F.lit(DEFAULT_SEED).cast("bigint"))
    if "objects" not in frames.columns:
        frames = frames.withColumn("objects", scene_array())
    return background_points(frames, scene, mode).unionByName(
        object_points(frames, scene, mode)
    )


def generate_frame(
    spark: SparkSession, seed: int = DEFAULT_SEED, frame_id: str = "000001"
) -> tuple[DataFrame, DataFrame]:
    """Points and objects of one built-in frame, with the sequential stream."""
    frames = frame_rows(spark, [frame_id], seed)
    return generate_frames(frames, mode="sequential"), make_objects(frames)
