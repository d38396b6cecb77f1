"""Packing of documents into full sequences, mixed by source.

Each source is a queue of tokens. A scheduler goes round: in every window each
queue gets a quantum, its target share of the window, added to its deficit, and
hands on as many whole tokens as the deficit holds; the fraction is carried to
the next window. An empty queue drops out and the others share its part. The
windows end to end are cut into sequences.

What a queue has handed on after t windows is a closed formula, so every task
places its own documents: it needs the position of a document in its queue,
which two-level prefix sums give, and the totals of the queues.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.llm.common import stored, tidy
from rasterlark.llm.encoding import encoder_for

SEQUENCE = 2048  # tokens
WINDOW = 32 * SEQUENCE  # tokens in which the target proportions hold
CELLS = 1 << 20  # windows times queues looked at together
BUCKET_DOCUMENTS = 500  # documents whose order one task decides
FRACTION = 10  # bits of a token's fraction in deficits
WIDTH = 2  # bytes of a stored id
ROWS_AT_ONCE = 2000
LEAN = 0.25


@dataclass(frozen=True)
class Epoch:
    """A time in which the same queues are served."""

    first: np.ndarray  # tokens each queue handed on before
    amount: np.ndarray  # tokens it hands on in this epoch
    quantum: np.ndarray  # per window, in 2**-FRACTION tokens
    carried: np.ndarray  # deficit at the start
    base: int  # tokens of all queues before

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens [..., queue] handed on after that many windows."""
        due = (self.carried + windows[..., None] * self.quantum) >> FRACTION
        return np.minimum(due, self.amount)


def schedule(totals: np.ndarray, shares: np.ndarray, window: int = WINDOW) -> list[Epoch]:
    """Epochs until every queue is empty; at most one for each queue.

    A queue whose share is zero waits until the others are empty; then those
    left share by what they hold.
    """
    return list(epochs_of(totals, shares, window))


def epochs_of(totals: np.ndarray, shares: np.ndarray, window: int) -> Iterator[Epoch]:
    """The same one after another: with many queues all are not kept at once."""
    totals, shares = np.asarray(totals, np.int64), np.asarray(shares, float)
    first, carried, base = np.zeros_like(totals), np.zeros_like(totals), 0
    while (left := totals - first).any():
        weight = np.where(left > 0, shares, 0.0)
        if not weight.any():
            weight = left.astype(float)
        quantum = np.floor(weight / weight.sum() * (window << FRACTION)).astype(np.int64)
        quantum = np.where(weight > 0, np.maximum(quantum, 1), 0)
        carried = np.where(left > 0, carried, 0)
        active = quantum > 0
        windows = -(-((left << FRACTION) - carried)[active] // quantum[active])
        rounds = int(windows.min())
        due = np.where(active, (carried + rounds * quantum) >> FRACTION, 0)
        amount = np.minimum(due, left)
        yield Epoch(first.copy(), amount, quantum, carried.copy(), base)
        carried = np.where(active, (carried + rounds * quantum) & ((1 << FRACTION) - 1), carried)
        first = first + amount
        base += int(amount.sum())


def place(
    epochs: Iterable[Epoch], queue: np.ndarray, start: np.ndarray, size: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, start in row, length, place in the mixed stream) of documents
    that lie at `start` of their queues."""
    found = []
    for epoch in epochs:
        first = epoch.first[queue]
        low = np.maximum(start, first)
        high = np.minimum(start + size, first + epoch.amount[queue])
        row = np.flatnonzero(low < high)
        if not len(row):
            continue
        q, low, high = queue[row], (low - first)[row], (high - first)[row]

        def window_of(token: np.ndarray, q: np.ndarray) -> np.ndarray:
            due = ((token + 1) << FRACTION) - epoch.carried[q]
            return np.maximum(-(-due // epoch.quantum[q]) - 1, 0)

        # Of a queue with less than a token a window many windows hold none, so
        # its tokens are taken one by one.
        times = np.where(epoch.quantum[q] < 1 << FRACTION, high - low, 1)
        if (times > 1).any():
            at = np.repeat(np.arange(len(row)), times)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            low, high = low[at] + inner, np.where(times[at] > 1, low[at] + inner + 1, high[at])
            row, q = row[at], q[at]
        w0, w1 = window_of(low, q), window_of(high - 1, q)
        times = w1 - w0 + 1
        at = np.repeat(np.arange(len(row)), times)
        w = np.repeat(w0, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        windows, number = np.unique(w, return_inverse=True)
        order = np.argsort(number, kind="stable")
        step = max(1, CELLS // len(epoch.quantum))
        for least in range(0, len(windows), step):
            part = windows[least : least + step]
            before, after = epoch.served(part), epoch.served(part + 1)
            handed = np.cumsum(after - before, axis=1) - (after - before)
            handed += epoch.base + before.sum(1)[:, None] - before
            ends = np.searchsorted(number[order], [least, least + len(part)])
            here = order[ends[0] : ends[1]]
            each, own, to = number[here] - least, q[at[here]], at[here]
            begin = np.maximum(low[to], before[each, own])
            end = np.minimum(high[to], after[each, own])
            place_ = handed[each, own] + begin
            start_ = begin + first[row[to]] - start[row[to]]
            some = begin < end
            found.append(tuple(x[some] for x in (row[to], start_, end - begin, place_)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def cut(row, start, length, place_, sequence: int = SEQUENCE):
    """The same runs, cut at the ends of sequences."""
    first, last = place_ // sequence, (place_ + length - 1) // sequence
    times = last - first + 1
    at = np.repeat(np.arange(len(row)), times)
    number = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    begin = np.maximum(place_[at], number * sequence)
    end = np.minimum((place_ + length)[at], (number + 1) * sequence)
    return row[at], start[at] + begin - place_[at], end - begin, number, begin - number * sequence


def tokenize(
    documents: DataFrame, tokenizer_file: str, end_id: int, width: int = WIDTH, remember: bool = True
) -> DataFrame:
    """(doc_id, source, size, ids): ids of `width` bytes each, the end included.

    `remember`: worker processes keep the tokenizer and the parts it has encoded
    for later tasks, idle ones too. Without, memory is held by running tasks
    alone, and these work in LEAN of the encoder's memory, with more time.
    """
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_file, keeps_space=False, share=1 if remember else LEAN)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                ids = [
                    np.frombuffer(x + end, "<u4")
                    for x in encoder.encode(part.column(2).cast(pa.binary()).to_pylist())
                ]
                if ids and int(max(map(np.max, ids))) >> (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "source", "size", "ids"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(encode, drop_shelf=not remember), f"doc_id {kind}, source string, size long, ids binary")


def pack(
    tokens: DataFrame,
    targets: dict[str | None, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    seed: int = 0,
) -> DataFrame:
    """Pieces of the documents in `tokens` (as `tokenize` returns them, reread
    from storage): doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, queue.

    `targets` gives sources' token shares; sources without one come last.
    None takes the shares of the corpus, so that all queues end together. Every
    source has a queue, those with targets come first, then the larger ones.
    Null is a source. Documents of a queue go in the order of a
    seeded hash of doc_id; equal rows are packed as often as they occur.
    """
    targets = targets or {}
    sizes = tokens.groupBy("source").agg(F.sum("size").alias("size")).collect()
    sizes.sort(key=lambda r: (r.source not in targets, -r.size, r.source is not None, r.source or ""))
    queues = tokens.sparkSession.createDataFrame(
        [(r.source, i) for i, r in enumerate(sizes)], "named string, queue long"
    )
    buckets = max(1, -(-tokens.count() // BUCKET_DOCUMENTS))
    dealt = tokens.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("named"))).withColumn(
        "order", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    )
    dealt = dealt.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    before = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(dealt.groupBy("queue", "bucket").agg(F.sum("size").alias("part")), "pack-parts")
    totals = np.array([r.size for r in sizes], np.int64)
    if targets:
        shares = np.array([targets.get(r.source, 0.0) for r in sizes])
    else:
        shares = totals.astype(float)
    bases = parts.select(
        "queue", "bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("queue", "bucket").orderBy("order", "doc_id", "size", "ids")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, ["queue", "bucket"])
        .select("doc_id", "queue", (F.col("base") + F.col("inner")).alias("at"), "size", "ids")
    )
    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                queues, at, size = (
                    part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)
                )
                row, start, length, number, offset = cut(
                    *place(epochs_of(totals, shares, window), queues, at, size), sequence
                )
                ids = [
                    np.frombuffer(x, f"<u{len(x) // n}").astype("<u4")
                    for x, n in zip(part.column(4).to_pylist(), size.tolist())
                ]
                crc = [
                    zlib.crc32(ids[r][s : s + n])
                    for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, size[row], number, offset)),
                        pa.array(queues[row], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(
        tidy(cut_pieces),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, queue long",
    )


def pack_documents(
    documents: DataFrame,
    tokenizer_file: str,
    end_id: int = 1,
    targets: dict[str | None, float] | None = None,
    remember: bool = True,
) -> DataFrame:
    """Encodes doc_id, source and text once, then packs. A null text is empty:
    its one token is the end. `remember`: as for `tokenize`."""
    tokens = tokenize(documents, tokenizer_file, end_id, remember=remember)
    return pack(stored(tokens, "pack-tokens"), targets)
