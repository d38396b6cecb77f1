"""Multi-object tracking: detections of a scene joined to tracks, frame by frame.

A scene is a sequence: what a frame is matched with depends on all before it. So
scenes are what is spread over tasks, and a task holds the live tracks of one
scene and the detections of one frame, however long the scene is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.operators.kalman import Motion, first_state, step
from rasterlark.operators.matching import COST_UNITS, assign

Detection = tuple[int, float, float]  # id, x, y


@dataclass(frozen=True)
class Rules:
    gate: float = 4.0  # metres between a track's expected place and a detection
    confirm: int = 3  # detections until a track is confirmed
    patience: int = 3  # frames after its last detection that a track lives on


@dataclass
class Track:
    number: int
    frame: int  # of its last detection
    hits: int
    state: list[float]


@dataclass
class Tracker:
    """The live tracks of a scene. Frames must come in order."""

    born: int = 0
    tracks: list[Track] = field(default_factory=list)

    def see(
        self, frame: int, detections: list[Detection], motion: Motion, rules: Rules
    ) -> list[tuple]:
        """(id, track, hits, confirmed, x, vx, y, vy) of each detection, by id."""
        self.tracks = [t for t in self.tracks if frame - t.frame <= rules.patience]
        expected = [
            (t.state[0] + (frame - t.frame) * t.state[1], t.state[2] + (frame - t.frame) * t.state[3])
            for t in self.tracks
        ]
        detections = sorted(detections)
        pairs = []
        for i, (ex, ey) in enumerate(expected):
            for j, (_, x, y) in enumerate(detections):
                apart = math.hypot(x - ex, y - ey)
                if apart <= rules.gate:
                    pairs.append((i, j, round(apart * COST_UNITS)))
        taken = {j: self.tracks[i] for i, j, _ in assign(pairs)}
        seen = []
        for j, (identity, x, y) in enumerate(detections):
            track = taken.get(j)
            if track is None:
                track = Track(self.born, frame, 0, list(first_state(x, y, motion)))
                self.born += 1
                self.tracks.append(track)
            else:
                track.state = list(step(tuple(track.state), frame - track.frame, x, y, motion))
            track.frame, track.hits = frame, track.hits + 1
            seen.append(
                (identity, track.number, track.hits, track.hits >= rules.confirm, *track.state[:4])
            )
        return seen

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Tracker:
        held = json.loads(text)
        return Tracker(held["born"], [Track(**t) for t in held["tracks"]])


COLUMNS = ["scene_id", "frame_id", "id", "track", "hits", "confirmed", "x", "vx", "y", "vy"]


def track_schema(scene_kind: str) -> str:
    return (
        f"scene_id {scene_kind}, frame_id long, id long, track long, hits long, "
        "confirmed boolean, x double, vx double, y double, vy double"
    )


def sound_detections(detections: DataFrame, *more: str) -> DataFrame:
    """Rows that can be tracked: without nulls, NaN or infinite places."""
    return detections.where(
        "scene_id IS NOT NULL AND frame_id IS NOT NULL AND id IS NOT NULL "
        "AND abs(x) < double('infinity') AND abs(y) < double('infinity')"
    ).select(
        "scene_id",
        F.col("frame_id").cast("long").alias("frame_id"),
        F.col("id").cast("long").alias("id"),
        F.col("x").cast("double").alias("x"),
        F.col("y").cast("double").alias("y"),
        *more,
    )


def track_objects(
    detections: DataFrame, motion: Motion = Motion(), rules: Rules = Rules()
) -> DataFrame:
    """(scene_id, frame_id, id, track, hits, confirmed, x, vx, y, vy): the track of
    each detection (scene_id, frame_id, id, x, y), numbered in a scene by birth,
    and its state after it.

    Each frame's detections are matched with the expected places of live tracks
    within the gate: as many as possible, at the least total distance. Others
    begin tracks. A track is confirmed from its third detection on and dies when
    it was not seen for more than `patience` frames. Ties go to lower tracks and
    ids; repeated rows are detections of their own.
    """
    kind = detections.schema["scene_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scene = frame = tracker = None
        held: list[Detection] = []

        def close() -> list[tuple]:
            if tracker is None:
                return []
            return [(scene, frame, *s) for s in tracker.see(frame, held, motion, rules)]

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.scene_id, row.frame_id) != (scene, frame):
                    out += close()
                    held = []
                    if row.scene_id != scene:
                        scene, tracker = row.scene_id, Tracker()
                    frame = row.frame_id
                held.append((row.id, row.x, row.y))
            yield pd.DataFrame(out, columns=COLUMNS)
        yield pd.DataFrame(close(), columns=COLUMNS)

    ordered = sound_detections(detections).repartition("scene_id")
    return ordered.sortWithinPartitions("scene_id", "frame_id", "id").mapInPandas(
        run, track_schema(kind)
    )
