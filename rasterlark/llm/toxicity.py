"""Toxicity of texts by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on what is
peculiar to toxic text, the words that recur in toxic documents at many times
their ordinary rate. Every window of a text is compressed twice, with the
ordinary dictionary and with both laid end to end. Ordinary wording is found in
both at the same distance, so the two lengths differ only by what the toxic
dictionary explains. How many windows save at least 1, 2, .. bytes is weighed
against the length of the text; the weights of these thresholds are calibrated
on labelled documents that the dictionaries have not seen.

Words are counted over all labelled documents. The windows for the ordinary
dictionary and the documents for calibration are samples of about a given size,
drawn by a hash of document and place at the rate that gives it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 24  # words that are compressed together
THRESHOLDS = (1, 2, 3, 5)  # bytes a window saves
LEVEL = 9  # of compression: the lazy search finds short matches
ORDINARY_BYTES = 110_000
TOXIC_BYTES = 4_000
PIECE = 8  # words of a training window
SAMPLE_BYTES = 5_000_000  # of training windows that reach the driver, about
SAMPLE_WINDOW_BYTES = 256  # longer ones are not sampled
SAMPLE_DOCUMENTS = 20_000  # whose features reach the driver for calibration, about
PECULIAR_WORDS = 100
PECULIAR_LENGTH = 64  # characters of a peculiar word at most
PECULIAR_RATE = 6.0  # times the ordinary rate
RECURS = 3  # toxic documents with the word
REPEATS = 1000  # samples of one word for the toxic dictionary at most
CUT = 0.3


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _train(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their own text."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Scale:
    """What windows save with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            # Eight bytes is the least a dictionary may have.
            kept = zstandard.ZstdCompressionDict(
                content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            kept.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=kept, compression_params=options)

        # The toxic part lies farther back, so that ordinary matches cost the same.
        self.plain = compressor(ordinary)
        self.both = compressor(toxic + ordinary)

    def features(self, text: str | None) -> list[float]:
        """One, then shares of the windows of the text that save so many bytes,
        their mean saving, the largest one and the log of their number."""
        words = (text or "").lower().encode("utf-8", "replace").split()
        saved = []
        for low in range(0, len(words), WINDOW):
            window = b" " + b" ".join(words[low : low + WINDOW]) + b" "
            saved.append(len(self.plain.compress(window)) - len(self.both.compress(window)))
        count = len(saved) + 1
        return [
            1.0,
            *(sum(s >= t for s in saved) / count for t in THRESHOLDS),
            sum(saved) / count,
            float(max([0, *saved])),
            math.log(count),
        ]


FEATURES = len(THRESHOLDS) + 4


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of a logistic regression, by Newton's steps on scaled features."""
    scale = np.maximum(np.abs(features).max(0, initial=0.0), 1e-9)
    x = features / scale
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - chance) - penalty * weights
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple((weights / scale).tolist())


def sample_windows(texts: DataFrame, size: int = SAMPLE_BYTES) -> list[bytes]:
    """Windows of PIECE words of (key, text), about `size` bytes in all. Each
    window has the same chance, drawn from its document's key and its place, so
    frequent wording comes often, and no task hands on more than its share."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    below = min(1.0, size / total) * 2.0**32

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").lower().encode("utf-8", "replace").split()
                start = zlib.crc32(str(key).encode())
                for low in range(0, len(words), PIECE):
                    if zlib.crc32(low.to_bytes(8, "little"), start) < below:
                        window = b" " + b" ".join(words[low : low + PIECE]) + b" "
                        if len(window) <= SAMPLE_WINDOW_BYTES:
                            kept.append((key if key is None else str(key), low, window))
            columns = list(zip(*kept)) if kept else [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "place", "piece"]
            )

    found = texts.select("key", "text").mapInArrow(windows, "key string, place long, piece binary")
    pieces = found.toArrow().sort_by([("place", "ascending"), ("key", "ascending"), ("piece", "ascending")])
    return pieces.column(2).to_pylist()


def peculiar_words(labelled: DataFrame) -> list[tuple[str, int]]:
    """(word, toxic documents with it) of the words that toxic documents hold at
    over PECULIAR_RATE times the ordinary rate, the most telling ones."""
    totals = labelled.agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    ).first()
    words = labelled.select(
        "toxic",
        F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"),
    ).where(F.length("word").between(2, PECULIAR_LENGTH))
    counted = words.groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    )
    rate = F.log((F.col("bad") + 0.5) / (totals.bad + 1.0)) - F.log(
        (F.col("good") + 0.5) / (totals.good + 1.0)
    )
    told = counted.withColumn("rate", rate).where(
        (F.col("bad") >= RECURS) & (F.col("rate") > math.log(PECULIAR_RATE))
    )
    best = told.orderBy(F.desc(F.col("bad") * F.col("rate")), "word").limit(PECULIAR_WORDS)
    return [(r.word, r.bad) for r in best.collect()]


def learn_toxicity(labelled: DataFrame) -> Model:
    """From (key, text, toxic, calibrates): documents with label 0 or 1; the
    boolean says whether a document is for calibration or for the dictionaries,
    samples are drawn by the key. Rows without label are not looked at. Without documents of both labels for
    calibration every text gets about the share of toxic ones."""
    labelled = labelled.where("toxic IN (0, 1)").select("key", "text", "toxic", "calibrates")
    seen = labelled.where("NOT calibrates")
    ordinary = _train(ORDINARY_BYTES, sample_windows(seen.where("toxic = 0")), k=32, d=6)
    peculiar = peculiar_words(seen)
    drawn = [(i, word) for word, n in peculiar for i in range(min(n, REPEATS))]
    # Mixed: the trainer takes one segment from each stretch of its samples.
    drawn.sort(key=lambda x: zlib.crc32(f"{x[0]} {x[1]}".encode()))
    samples = [f" {word} ".encode() for _, word in drawn]
    toxic = _train(TOXIC_BYTES, samples, k=16, d=8)
    held = labelled.where("calibrates")
    rate = min(1.0, SAMPLE_DOCUMENTS / max(1, held.count()))
    drawn = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 32)) < rate * 2.0**32
    rows = _featured(
        held.where(drawn).select(F.struct("key", "toxic").alias("kept"), "text"), ordinary, toxic
    )
    rows = rows.select("kept.key", "kept.toxic", "features").collect()
    rows.sort(key=lambda r: (r.key is None, str(r.key), r.toxic, r.features))
    features = np.array([r.features for r in rows], float).reshape(-1, FEATURES)
    labels = np.array([r.toxic for r in rows], float)
    return Model(ordinary, toxic, fit(features, labels))


def _featured(rows: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(kept, features) of rows (kept, text)."""
    shipped = rows.sparkSession.sparkContext.broadcast((ordinary, toxic))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = Scale(*shipped.value)
        for batch in batches:
            found = [scale.features(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["kept", "features"]
            )

    kind = rows.schema["kept"].dataType.simpleString()
    return rows.select("kept", "text").mapInArrow(look, f"kept {kind}, features array<double>")


def score_texts(documents: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of the documents, with score (0 to 1) and predicted (1 from a
    score of CUT on). Whole texts are scored; a null text counts as empty, which
    has a score too; repeated rows are scored each for itself."""
    rows = documents.select(F.struct(*columns).alias("kept"), "text")
    weights = F.array(*(F.lit(w) for w in model.weights))
    products = F.zip_with("features", weights, lambda x, w: x * w)
    logit = F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
    scored = _featured(rows, model.ordinary, model.toxic).withColumn(
        "score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    )
    return scored.select(
        "kept.*", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
