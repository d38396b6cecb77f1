"""Multi-object tracking over a stream of detections."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterlark.operators.kalman import Motion
from rasterlark.operators.tracking import (
    COLUMNS,
    Rules,
    Tracker,
    sound_detections,
    track_schema,
)


class _Scene(StatefulProcessor):
    """State of a scene: its tracker, and the frames that wait for the watermark.

    Each frame sets a timer at its time. When it rings, no more rows of the frame
    can come; the frames up to that time are tracked in order. Tracks are born,
    confirmed and die by frame numbers alone, so micro-batches change nothing.
    """

    def __init__(self, motion: Motion, rules: Rules) -> None:
        self.motion, self.rules = motion, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "text string")
        self.waiting = handle.getMapState("waiting", "frame long", "at long, rows string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for frame, own in batch.groupby("frame_id", sort=True):
                at = int(own["at"].max())
                held = list(zip(own["id"].tolist(), own["x"].tolist(), own["y"].tolist()))
                if self.waiting.containsKey((int(frame),)):
                    before, text = self.waiting.getValue((int(frame),))
                    at, held = max(at, before), json.loads(text) + held
                self.waiting.updateValue((int(frame),), (at, json.dumps(held)))
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], v[1]) for k, v in self.waiting.iterator() if v[0] <= now)
        tracker = Tracker.of(self.tracker.get()[0]) if self.tracker.exists() else Tracker()
        out = []
        for frame, text in due:
            rows = [tuple(r) for r in json.loads(text)]
            seen = tracker.see(frame, rows, self.motion, self.rules)
            out += [(key[0], frame, *s) for s in seen]
            self.waiting.removeKey((frame,))
        if due:
            self.tracker.update((tracker.text(),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_tracks(
    detections: DataFrame,
    event_time: str,
    lateness: str,
    motion: Motion = Motion(),
    rules: Rules = Rules(),
) -> DataFrame:
    """`track_objects` over a stream, in append mode: a frame's rows come out once
    the watermark, `lateness` behind the newest detection, has passed it.

    All detections of a frame have one event time, and later frames later ones.
    Detections later than the watermark are lost. What comes out is what the
    batch form makes of the same frames, whatever the micro-batches. Needs the
    RocksDB state store.
    """
    kind = detections.schema["scene_id"].dataType.simpleString()
    timed = detections.withWatermark(event_time, lateness)
    rows = sound_detections(timed, event_time).withColumn("at", F.unix_millis(event_time))
    return rows.groupBy("scene_id").transformWithStateInPandas(
        statefulProcessor=_Scene(motion, rules),
        outputStructType=track_schema(kind),
        outputMode="append",
        timeMode="eventTime",
    )
