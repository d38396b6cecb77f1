"""Periodic runs of words: stretches that repeat themselves.

A run is a stretch with smallest period q and length of at least
max(LEAST, 2q) that no neighbour extends. Words q apart are equal all along it,
so it has a stretch of at least max(q, LEAST - q) places that match the places
q further on. At each dyadic scale, blocks of L words are laid so closely that
one of them lies in that stretch for every q the scale looks for. The sum of
squared differences between a block and each place of the window behind it is a
convolution, taken exactly modulo a prime by a number-theoretic transform. A
sum of zero means no mismatch, and its distance q is a seed: compared word by
word to both sides it gives the maximal stretch.

Blocks that cannot have an occurrence there are not transformed: those with a
word that does not come again within the window, and those whose whole window
lies in a known run of a period p <= L, where only multiples of p match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12  # words of a run
WORDS_AT_ONCE = 1 << 18  # of the documents whose words are looked at together
CELLS = 1 << 18  # numbers in one batch of transforms

# A prime with a factor 2**27 below it, and a generator.
MODULUS = 15 * 2**27 + 1
GENERATOR = 31

FIRST_BLOCK = 4  # words at the lowest scale
_M = np.uint64(MODULUS)


# -- number-theoretic transform ---------------------------------------------------


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first size/2 powers of a root of unity of that order."""
    root = pow(GENERATOR, (MODULUS - 1) // size, MODULUS)
    if inverse:
        root = pow(root, MODULUS - 2, MODULUS)
    powers = np.ones(max(1, size // 2), np.uint64)
    step = 1
    while step < len(powers):
        powers[step : 2 * step] = powers[:step] * np.uint64(pow(root, step, MODULUS)) % _M
        step *= 2
    return powers


def transform(values: np.ndarray) -> np.ndarray:
    """Transforms of rows whose length is a power of two, places bit-reversed."""
    rows, size = values.shape
    powers = _powers(size, inverse=False)
    out = values.copy()
    half = size // 2
    while half:
        pairs = out.reshape(rows, -1, 2, half)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0] = (low + high) % _M
        pairs[:, :, 1] = (low + _M - high) * powers[:: size // (2 * half)] % _M
        half //= 2
    return out


def restore(values: np.ndarray) -> np.ndarray:
    """The inverse of `transform`."""
    rows, size = values.shape
    powers = _powers(size, inverse=True)
    out = values.copy()
    half = 1
    while half < size:
        pairs = out.reshape(rows, -1, 2, half)
        low = pairs[:, :, 0].copy()
        high = pairs[:, :, 1] * powers[:: size // (2 * half)] % _M
        pairs[:, :, 0] = (low + high) % _M
        pairs[:, :, 1] = (low + _M - high) % _M
        half *= 2
    return out * np.uint64(pow(size, MODULUS - 2, MODULUS)) % _M


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """[row, o]: squared differences of a block of L numbers and the window of 4L
    at offset o in 0..3L, summed modulo the prime."""
    length = blocks.shape[1]
    turned = np.zeros_like(windows)
    turned[:, :length] = blocks[:, ::-1]
    product = restore(transform(turned) * transform(windows) % _M)[:, length - 1 :]
    squares = np.zeros((len(windows), windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows % _M, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _M).sum(1, dtype=np.uint64)
    there = squares[:, length:] - squares[:, :-length]
    return (own[:, None] + there + np.uint64(2) * (_M - product)) % _M


# -- runs -------------------------------------------------------------------------


def _reach(equal_from: Callable[[int, int], np.ndarray], most: int) -> int:
    """Number of leading true values, asked for in growing pieces."""
    done, step = 0, 64
    while done < most:
        here = equal_from(done, min(most, done + step))
        stop = np.flatnonzero(~here)
        if len(stop):
            return done + int(stop[0])
        done += len(here)
        step *= 4
    return done


def _extend(ids: np.ndarray, at: int, length: int, q: int) -> tuple[int, int] | None:
    """The maximal stretch (start, end) of period q around a block and its
    occurrence q further on; None if they differ."""
    if not np.array_equal(ids[at : at + length], ids[at + q : at + q + length]):
        return None
    left = _reach(
        lambda a, b: ids[at - b : at - a][::-1] == ids[at - b + q : at - a + q][::-1], at
    )
    end = at + length
    right = _reach(
        lambda a, b: ids[end + a : end + b] == ids[end + a + q : end + b + q],
        len(ids) - end - q,
    )
    return at - left, end + right + q


def _primes_of(number: int) -> Iterator[int]:
    factor = 2
    while factor * factor <= number:
        if number % factor == 0:
            yield factor
            while number % factor == 0:
                number //= factor
        factor += 1
    if number > 1:
        yield number


def _primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether no divisor of q is a period of the stretch that starts there, has
    period q and is at least 2q long."""
    return not any(
        np.array_equal(ids[start : start + q], ids[start + q // f : start + q // f + q])
        for f in _primes_of(q)
    )


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Distance to the next equal number; a large one where there is none."""
    order = np.argsort(ids, kind="stable")
    away = np.full(len(ids), np.iinfo(np.int64).max)
    same = ids[order[1:]] == ids[order[:-1]]
    away[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return away


def find_in(ids: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in the word numbers of documents laid end to
    end, by start, then period. No number occurs in two documents; `longest` is
    the length of the longest one."""
    runs: list[tuple[int, int, int]] = []
    away = _next_same(ids)
    padding = np.uint64(int(ids.max(initial=0)) + 1)
    length, low = FIRST_BLOCK, 1
    while low <= longest // 2:
        high = low + 3 * length
        # The shortest stretch of matches that a run of such a period has.
        shortest = low if 2 * low > least else -(-least // 2)
        while length > shortest:
            length //= 2
            high = low + 3 * length
        stride = min(length, shortest - length + 1)
        starts = np.arange(0, len(ids) - length + 1, stride)
        back = np.concatenate([[0], np.cumsum(away <= high)])
        starts = starts[back[starts + length] - back[starts] == length]
        if len(starts) and runs:
            known = sorted((s, s + n) for s, n, p in runs if p <= length)
            if known:
                begin = np.array([s for s, _ in known])
                end = np.maximum.accumulate([e for _, e in known])
                at = np.searchsorted(begin, starts, "right") - 1
                covered = (at >= 0) & (end[np.maximum(at, 0)] >= starts + length + high)
                starts = starts[~covered]
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // (4 * length))
        for first in range(0, len(starts), step):
            some = starts[first : first + step]
            blocks = ids[some[:, None] + np.arange(length)].astype(np.uint64)
            places = some[:, None] + low + np.arange(4 * length)
            inside = places < len(ids)
            windows = np.where(inside, ids[np.where(inside, places, 0)].astype(np.uint64), padding)
            row, offset = np.nonzero(mismatches(blocks, windows) == 0)
            seeds.append((some[row], low + offset))
        if seeds:
            at, q = (np.concatenate(x) for x in zip(*seeds))
            order = np.lexsort((at, q))
            at, q = at[order], q[order]
            edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                period, here, i = int(q[a]), at[a:b], 0
                while i < len(here):
                    found = _extend(ids, int(here[i]), length, period)
                    i += 1
                    if not found:
                        continue
                    start, end = found
                    if end - start >= max(least, 2 * period) and _primitive(ids, start, period):
                        runs.append((start, end - start, period))
                    # Blocks in the same stretch of matches give the same run.
                    i = max(i, int(np.searchsorted(here, end - period - length, "right")))
        low, length = high + 1, 2 * length
    return sorted((s, n, p) for s, n, p in runs)


# -- documents --------------------------------------------------------------------

Words = list[bytes]
Reword = Callable[[object, Words], Words]


def _looked_at(
    texts: list[tuple[object, bytes]], reword: Reword | None
) -> Iterator[tuple[list, bytes]]:
    """Runs and collapsed text of each document, by groups of documents."""
    group: list[Words] = []
    ids: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[tuple[list, bytes]]:
        sizes = [len(w) for w in group]
        numbers = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        runs = find_in(numbers, max(sizes, default=0))
        base = at = 0
        for words, size in zip(group, sizes):
            own = []
            while at < len(runs) and runs[at][0] < base + size:
                start, length, period = runs[at]
                own.append((start - base, length, period))
                at += 1
            base += size
            if own:
                keep = np.ones(size, bool)
                for start, length, period in own:
                    keep[start + period : start + length] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            yield own, b" ".join(words)

    for key, text in texts:
        words = text.split()  # of bytes: at the blanks of ASCII
        if reword:
            words = reword(key, words)
        if held and held + len(words) > WORDS_AT_ONCE:
            yield from flush()
            group, ids, held = [], [], 0
        first: dict[bytes, int] = {}
        group.append(words)
        ids.append(np.fromiter(map(first.setdefault, words, count(held)), np.int64, len(words)))
        held += len(words)
    yield from flush()


def collapse_runs(documents: DataFrame, reword: Reword | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of doc_id and text.

    `runs` is an array of start, length and period in words, by start, then
    period. `collapsed` has the words joined by one space, without those that
    a run contains after its first period. Words are separated by the blanks of
    ASCII. A null text has no words; repeated rows are looked at each for itself.
    `reword` may change the words, given doc_id and the words as bytes. Other
    columns are dropped.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(
            pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        )
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = (t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist())
            runs, collapsed = [], []
            for own, text in _looked_at(zip(keys, texts), reword):
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                collapsed.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(runs, spans),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "runs", "collapsed"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        look,
        f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )
