"""Kalman filter with constant velocity over tracks of any length.

The state of a track after an observation depends on all before it. But what a
stretch of observations does to the state in front of it is itself a small
object, and two such objects in a row combine to one, associatively. So a long
track is cut into parts, rows of chunks of frames: every part becomes one object,
in parallel; a short pass over the parts of each track gives the state in front
of each; and then every part is filtered from there, in parallel again. A track
of few observations is one part, however many frames lie between them.

Both axes have the same noise, so they share the variances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.operators.overlap import stored

CHUNK_FRAMES = 4096
PART_ROWS = 4096  # observations from which a track is cut again
BROADCAST_ROWS = 200_000  # up to so many chunks of long tracks are broadcast


@dataclass(frozen=True)
class Motion:
    """Variances: of a measured place, of the change of velocity per frame, and
    of a velocity nothing is known of."""

    measured: float = 0.25
    change: float = 0.01
    velocity: float = 1.0


# A state: x, vx, y, vy and the variances of place, place with velocity, velocity.
State = tuple[float, float, float, float, float, float, float]


def first_state(x: float, y: float, motion: Motion) -> State:
    return x, 0.0, y, 0.0, motion.measured, 0.0, motion.velocity


def step(state: State, frames: float, x: float, y: float, motion: Motion) -> State:
    """The state some frames later, after another observation."""
    px, vx, py, vy, p, c, v = state
    px, py = px + frames * vx, py + frames * vy
    p += 2 * frames * c + frames * frames * v + motion.change * frames * frames * frames / 3
    c += frames * v + motion.change * frames * frames / 2
    v += motion.change * frames
    total = p + motion.measured
    gain, speed = p / total, c / total
    return (
        px + gain * (x - px),
        vx + speed * (x - px),
        py + gain * (y - py),
        vy + speed * (y - py),
        (1 - gain) * p,
        (1 - gain) * c,
        v - speed * c,
    )


# -- stretches ----------------------------------------------------------------------
# A stretch takes the mean m and variance P in front of it to
#   A (I + P J)^-1 (m + P n) + b   and   A (I + P J)^-1 P A' + C.
# The arrays hold one 2 x 2 matrix for each stretch; b and n have a column an axis.

Stretches = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # A, b, C, n, J


def single(frames: np.ndarray, places: np.ndarray, motion: Motion) -> Stretches:
    """Stretches of one observation each, `frames` after the one before."""
    t = frames.astype(float)
    q11, q12, q22 = (motion.change * v for v in (t**3 / 3, t**2 / 2, t))
    total = q11 + motion.measured
    gain, speed = q11 / total, q12 / total
    a = np.stack([1 - gain, (1 - gain) * t, -speed, 1 - speed * t], 1).reshape(-1, 2, 2)
    b = np.stack([gain, speed], 1)[:, :, None] * places[:, None, :]
    c = np.stack([(1 - gain) * q11, (1 - gain) * q12, (1 - gain) * q12, q22 - speed * q12], 1)
    seen = np.stack([np.ones_like(t), t], 1)
    n = seen[:, :, None] * places[:, None, :] / total[:, None, None]
    j = seen[:, :, None] * seen[:, None, :] / total[:, None, None]
    return a, b, c.reshape(-1, 2, 2), n, j


def combine(one: Stretches, two: Stretches) -> Stretches:
    """Each stretch of `one` followed by that of `two`."""
    (a1, b1, c1, n1, j1), (a2, b2, c2, n2, j2) = one, two
    back = a1.swapaxes(1, 2)
    through = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    along = back @ np.linalg.inv(np.eye(2) + j2 @ c1)
    return (
        through @ a1,
        through @ (b1 + c1 @ n2) + b2,
        through @ c1 @ a2.swapaxes(1, 2) + c2,
        along @ (n2 - j2 @ b1) + n1,
        along @ j2 @ a1 + j1,
    )


def reduce_groups(parts: Stretches, group: np.ndarray) -> Stretches:
    """The stretches of each group in a row as one, neighbours combined in
    rounds, those of all groups at once. `group` ascends."""
    while True:
        new = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
        start = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        kept = np.flatnonzero((np.arange(len(group)) - start) % 2 == 0)
        if len(kept) == len(group):
            return parts
        followed = np.append(~new[1:], False)[kept]
        pairs = kept[followed]
        joined = combine(tuple(p[pairs] for p in parts), tuple(p[pairs + 1] for p in parts))
        parts, group = tuple(p[kept] for p in parts), group[kept]
        for p, j in zip(parts, joined):
            p[followed] = j


def reduce_all(parts: Stretches) -> Stretches:
    """All stretches in a row as one."""
    return reduce_groups(parts, np.zeros(len(parts[0]), np.int64))


def pass_through(state: State, flat: list[float]) -> State:
    """The state behind a stretch whose five matrices are given row by row."""
    a, b, c, n, j = np.array(flat).reshape(5, 2, 2)
    mean = np.array([[state[0], state[2]], [state[1], state[3]]])
    variance = np.array([[state[4], state[5]], [state[5], state[6]]])
    through = a @ np.linalg.inv(np.eye(2) + variance @ j)
    mean = through @ (mean + variance @ n) + b
    variance = through @ variance @ a.T + c
    return tuple(
        float(v)
        for v in (mean[0, 0], mean[1, 0], mean[0, 1], mean[1, 1], variance[0, 0], variance[0, 1], variance[1, 1])
    )


# -- tracks -------------------------------------------------------------------------


STATE = ["s_x", "s_vx", "s_y", "s_vy", "s_p", "s_c", "s_v"]
FILTERED = ["x", "vx", "y", "vy", "var_place", "cov", "var_velocity"]


def long_tracks(known: DataFrame, part_rows: int) -> DataFrame:
    """(track_id, chunk, part, before, next_part, last) of the chunks of tracks
    with more than `part_rows` observations: the part that a chunk belongs to,
    the last frame of the part before, the next part and the part's last frame.
    A part begins with the chunk in which `part_rows` more observations are full."""
    along = Window.partitionBy("track_id").orderBy("chunk")
    chunks = known.groupBy("track_id", "chunk").agg(
        F.count("*").alias("n"), F.max("frame_id").alias("last")
    )
    dealt = chunks.select(
        "track_id",
        "chunk",
        "last",
        F.expr(f"(sum(n) OVER (PARTITION BY track_id ORDER BY chunk) - n) DIV {part_rows}").alias("part"),
        F.sum("n").over(Window.partitionBy("track_id")).alias("n"),
    ).where(F.col("n") > part_rows)
    whole = Window.partitionBy("track_id", "part")
    # Frames ascend along a track, so the last frame before a part is the
    # largest of the chunks of smaller parts.
    between = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = dealt.select(
        "track_id",
        "chunk",
        "part",
        F.max("last").over(between).alias("before"),
        F.lead("part").over(along).alias("next_part"),
        "last",
    )
    return chunks.select(
        "track_id",
        "chunk",
        "part",
        F.min(F.struct("chunk", "before")).over(whole)["before"].alias("before"),
        F.max(F.struct("chunk", "next_part")).over(whole)["next_part"].alias("next_part"),
        F.max("last").over(whole).alias("last"),
    )


def _sum_up(motion: Motion):
    """One row for each part: the state after the first observation if the track
    begins there, and the stretch of all others."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, frame = None, 0

        def result(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r["track_id"] for r in rows], kind),
                    pa.array([r["part"] for r in rows], pa.int64()),
                    pa.array([r["next_part"] for r in rows], pa.int64()),
                    pa.array([r["last"] for r in rows], pa.int64()),
                    pa.array([r["first"] for r in rows], pa.list_(pa.float64())),
                    pa.array(
                        [r["stretch"] and np.concatenate([p.reshape(-1) for p in r["stretch"]]) for r in rows],
                        pa.list_(pa.float64()),
                    ),
                ],
                ["track_id", "part", "next_part", "last", "first", "stretch"],
            )

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("track_id").type
            columns = {n: batch.column(n).to_pylist() for n in ("track_id", "part", "before", "next_part", "last")}
            keys = list(zip(columns["track_id"], columns["part"]))
            frames = batch.column("frame_id").to_numpy()
            places = np.stack([batch.column(n).to_numpy() for n in "xy"], 1)
            old = [(held["track_id"], held["part"]) if held else None, *keys[:-1]]
            new = np.array([one != two for one, two in zip(keys, old)])
            previous = np.concatenate([[frame], frames[:-1]])
            use, done = np.ones(len(frames), bool), []
            groups = [held] if held else []  # those with a row here or held from before
            for at in np.flatnonzero(new).tolist():
                group = {n: columns[n][at] for n in columns} | {"first": None, "stretch": None}
                if group["before"] is None:
                    group["first"] = list(first_state(*places[at].tolist(), motion))
                    use[at] = False
                else:
                    previous[at] = group["before"]
                groups.append(group)
            which = (np.cumsum(new) - (0 if held else 1))[use]
            parts = single((frames - previous)[use], places[use], motion)
            parts = reduce_groups(parts, which)
            for k, number in enumerate(np.unique(which).tolist()):
                group, part = groups[number], tuple(p[k : k + 1] for p in parts)
                group["stretch"] = combine(group["stretch"], part) if group["stretch"] else part
            *done, held = groups
            frame = int(frames[-1])
            if done:
                yield result(done, kind)
        if held:
            yield result([held], kind)

    return sum_up


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of the next part, for each part of the tracks in order."""
    state, of = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if of != row["track_id"]:
                state, of = None, row["track_id"]
            if row["first"] is not None:
                state = tuple(row["first"])
            if row["stretch"] is not None:
                state = pass_through(state, row["stretch"])
            out.append(state)
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("track_id", "next_part")),
                    *(pa.array(column, pa.float64()) for column in zip(*out)),
                ],
                ["track_id", "part", *STATE],
            )


def _run(motion: Motion):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, of, frame = None, None, 0
        for batch in batches:
            out = []
            names = ["track_id", "part", "frame_id", "x", "y", "before", *STATE]
            for track, part, at, x, y, before, *front in zip(
                *(batch.column(n).to_pylist() for n in names)
            ):
                if of != (track, part):
                    of = track, part
                    state, frame = (None if before is None else tuple(front)), before
                state = step(state, at - frame, x, y, motion) if state else first_state(x, y, motion)
                frame = at
                out.append(state)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n) for n in ("track_id", "frame_id")),
                        *(pa.array(column, pa.float64()) for column in zip(*out)),
                    ],
                    ["track_id", "frame_id", *FILTERED],
                )

    return run


def filter_tracks(
    observations: DataFrame,
    motion: Motion = Motion(),
    chunk_frames: int = CHUNK_FRAMES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(track_id, frame_id, x, y, vx, vy, var_place, var_velocity): the state of
    each track after each of its observations (track_id, frame_id, x, y).

    frame_id counts frames and may have gaps, over which the state moves on. A
    track starts at rest at its first place. Observations of one frame come in
    the order of x, then y, and nothing moves between them. Rows with a null or
    NaN go. Filtered from (track, part of the track), so a long track is many tasks.
    """
    track = observations.schema["track_id"].dataType.simpleString()
    known = observations.where(
        "track_id IS NOT NULL AND frame_id IS NOT NULL "
        "AND abs(x) < double('infinity') AND abs(y) < double('infinity')"
    ).select(
        "track_id",
        F.col("frame_id").cast("long").alias("frame_id"),
        F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"),
        F.expr(f"floor(frame_id / {chunk_frames}D)").alias("chunk"),
    )
    keys, order = ["track_id", "part"], ["track_id", "part", "frame_id", "x", "y"]
    chunks = stored(long_tracks(known, part_rows), "track-chunks")
    few = chunks.count() <= BROADCAST_ROWS

    def with_chunks(which: DataFrame, how: str) -> DataFrame:
        return known.join(F.broadcast(which) if few else which, ["track_id", "chunk"], how)

    inner = with_chunks(chunks.where("next_part IS NOT NULL"), "inner")
    inner = inner.repartition(*keys).sortWithinPartitions(*order)
    summed = inner.mapInArrow(
        _sum_up(motion),
        f"track_id {track}, part long, next_part long, last long, first array<double>, "
        "stretch array<double>",
    )
    in_front = summed.repartition("track_id").sortWithinPartitions(*keys)
    states = ", ".join(f"{s} double" for s in STATE)
    fronts = stored(in_front.mapInArrow(_fronts, f"track_id {track}, part long, {states}"), "track-states")
    begun = chunks.select("track_id", "chunk", "part", "before").join(fronts, keys, "left")
    placed = with_chunks(begun, "left").withColumn("part", F.coalesce("part", F.lit(0)))
    found = placed.repartition(*keys).sortWithinPartitions(*order).mapInArrow(
        _run(motion), f"track_id {track}, frame_id long, " + ", ".join(f"{f} double" for f in FILTERED)
    )
    return found.select(
        "track_id", "frame_id", "x", "y", "vx", "vy", "var_place", "var_velocity"
    )
