"""Removal of long repeated byte strings, found with suffix arrays.

A string of `length` bytes is repeated if it starts at two places of the corpus.
Every such string has an anchor: of its k-grams the one with the smallest hash.
Equal strings have equal anchors at equal places, so strings meet by exchanging
anchors, and an anchor that occurs once ends the matter. The strings around the
others, as snippets, are sorted in blocks: on the block's Burrows-Wheeler
transform, breadth-first backward extension finds the common prefixes of
neighbouring suffixes by increasing value and stops at `length`; suffixes
between which no boundary has been found by then start with the same string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import stored, tidy

LENGTH = 400  # bytes of a repeated string
GRAM = 64  # bytes of an anchor
SEGMENT = 1 << 19  # bytes hashed together
BLOCK = 300_000  # bytes sorted together; an anchor with more is refined
_ODD = np.uint64(0x9E3779B97F4A7C15)


# -- the block: suffix array, transform, interval expansion -------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and their ranks, by prefix doubling. Symbols are below
    512; only suffixes that are not yet told apart are sorted again."""
    n = len(text)
    packed = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    for i in range(7):
        packed = (packed << 9) | wide[i : i + n]
    order = np.argsort(packed, kind="stable")
    sorted_ = packed[order]
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    reach = 7
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, rank
        some = order[open_]
        beyond = some + reach
        next_ = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = (rank[some] << 32) | next_
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        order[open_] = some[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[open_] = new
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        reach *= 2


def boundaries(text: np.ndarray, order: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """found[i]: the suffixes in slots i - 1 and i share fewer than `length`
    symbols. Symbol 0 ends a string and is never extended, so a suffix that
    meets one may stand with its right neighbour unseparated."""
    n = len(text)
    before = np.where(order > 0, order - 1, n - 1)
    transform = np.where(order > 0, text[before], 0).astype(np.int64)
    step = rank[before]
    run_at = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
    run_end = np.append(run_at[1:], n)
    run_of = np.cumsum(np.bincount(run_at, minlength=n)) - 1
    symbol = transform[run_at]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        # The runs of the transform inside each interval.
        first, last = run_of[low], run_of[high - 1]
        times = last - first + 1
        interval = np.repeat(np.arange(len(low)), times)
        run = np.arange(len(interval)) + np.repeat(first - (np.cumsum(times) - times), times)
        real = symbol[run] > 0
        interval, run = interval[real], run[real]
        if not len(run):
            break
        begin = step[np.maximum(run_at[run], low[interval])]
        end = step[np.minimum(run_end[run], high[interval]) - 1] + 1
        key = interval * 512 + symbol[run]
        if len(key) > 1:
            by_key = np.argsort(key, kind="stable")
            key, begin, end = key[by_key], begin[by_key], end[by_key]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low = begin[heads]
        high = end[np.append(heads[1:], len(key)) - 1]
        new = ~found[high]
        low, high = low[new], high[new]
        found[high] = True
    return found


def repeated_starts(snippets: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each snippet, the starts of strings of `length` bytes that occur at
    two places. A snippet stands for `weight` places."""
    sizes = np.array([len(s) + 1 for s in snippets])
    flat = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes) - 1
    flat[ends] = 0
    order, rank = suffix_array(flat)
    group = np.cumsum(boundaries(flat, order, rank, length)[:-1])
    owner = np.repeat(np.arange(len(snippets)), sizes)
    whole = np.flatnonzero(np.arange(len(flat)) + length <= ends[owner])
    group_of = group[rank[whole]]
    total = np.bincount(group_of, np.array(weights)[owner[whole]])
    found = whole[total[group_of] >= 2]
    cuts = np.searchsorted(found, np.concatenate([[0], ends + 1]))
    return [
        found[a:b] - base
        for a, b, base in zip(cuts[:-1], cuts[1:], np.concatenate([[0], ends[:-1] + 1]))
    ]


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes within `length` of the sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    low = starts[np.concatenate([[0], gap + 1])]
    high = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return list(zip(low.tolist(), high.tolist()))


# -- anchors ------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place, by doubling."""
    x = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(32)
    width = 1
    while width < gram:
        n = min(width, gram - width)
        y = x[: len(x) - n] * np.uint64(0xD1342543DE82EF95) + x[n:]
        y ^= y >> np.uint64(29)
        x, width = y * _ODD, width + n
    return x


def window_minima(x: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while width < window:
        n = min(width, window - width)
        x, width = np.minimum(x[: len(x) - n], x[n:]), width + n
    return x


def anchor_ranges(
    data: np.ndarray, valid: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor, anchor hash) of each run of string
    starts with one anchor. `valid` marks the starts of whole strings."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hashes = gram_hashes(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    # 40 bits of the hash, then the place: the leftmost of the smallest.
    keys = ((hashes >> np.uint64(24)) << np.uint64(24)) | place
    anchor = (window_minima(keys, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(valid[: len(anchor)])
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    chosen = anchor[starts]
    new = (np.diff(chosen) != 0) | (np.diff(starts) != 1)
    first = starts[np.concatenate([[True], new])]
    last = starts[np.concatenate([new, [True]])]
    at = chosen[np.concatenate([[True], new])]
    return first, last, at, hashes[at].view(np.int64)


def _find_anchors(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest

        def flush(pieces: list[tuple]) -> pa.RecordBatch:
            """pieces: (doc_id, hash, offset in the document, bytes)."""
            sizes = np.array([len(p[3]) for p in pieces])
            whole = b"".join([p[3] for p in pieces])
            data = np.frombuffer(whole, np.uint8)
            base = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(pieces)), sizes)
            valid = np.arange(len(data)) + length <= (base + sizes)[owner]
            first, last, at, code = anchor_ranges(data, valid, length, gram)
            who = owner[first] if len(first) else np.zeros(0, np.int64)
            begin, end = first.tolist(), (last + length).tolist()
            marks = np.frombuffer(
                b"".join([digest(whole[a:b]) for a, b in zip(begin, end)]), "<i8"
            ).reshape(-1, 2)
            offset = np.array([p[2] for p in pieces], np.int64)
            ids = pa.array([p[0] for p in pieces], pa.int64()).take(pa.array(who))
            texts = np.array([p[1] for p in pieces], np.int64)[who]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(code, pa.int64()),
                    pa.array(np.ascontiguousarray(marks[:, 0])),
                    pa.array(np.ascontiguousarray(marks[:, 1])),
                    ids,
                    pa.array(texts, pa.int64()),
                    pa.array(first - base[who] + offset[who], pa.int64()),
                    pa.array(last - first + length, pa.int64()),
                    pa.array(at - first, pa.int64()),
                ],
                ["anchor", "s1", "s2", "doc_id", "th", "start", "size", "at"],
            )

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py() or b""
                if len(text) < length:
                    continue
                doc_id, th = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for low in range(0, len(text) - length + 1, SEGMENT):
                    part = text[low : low + SEGMENT + length - 1]
                    held.append((doc_id, th, low, part))
                    size += len(part)
                    if size >= SEGMENT:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return find


# -- coverage of snippets -----------------------------------------------------

COVER = "s1 long, s2 long, low long, high long"


def _sort_blocks(length: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple]) -> pa.RecordBatch:
            starts = repeated_starts([r[4] for r in rows], [r[3] for r in rows], length)
            out = [
                (r[1], r[2], low, high)
                for r, s in zip(rows, starts)
                for low, high in covered(s, length)
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)],
                ["s1", "s2", "low", "high"],
            )

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[-1][0] and size >= BLOCK:
                    yield result(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) + 1
        if rows:
            yield result(rows)

    return sort


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Halves the room around the anchor: strings that reach at least half of it
    to the right share a longer anchor to the right, the others to the left."""
    import xxhash

    for batch in batches:
        out = []
        for s1, s2, weight, at, room, data in zip(*(c.to_pylist() for c in batch.columns)):
            length = room >> 32
            slack = room & 0xFFFFFFFF
            gram, half = length - slack, slack // 2
            cut = max(0, at - half)  # the first start of the right-hand strings
            last = len(data) - length
            for side, low, high, where, wide, left in (
                (0, cut, last, at, gram + slack - half, half),
                (1, 0, min(cut - 1, last), at - half - 1, gram + half + 1, slack - half - 1),
            ):
                if low > high:
                    continue
                part = data[low : high + length]
                mark = np.frombuffer(xxhash.xxh3_128_digest(part), "<i8")
                word = bytes([side]) + data[where : where + wide]
                code = np.frombuffer(xxhash.xxh3_64_digest(word)[::-1], "<i8")[0]
                out.append(
                    (int(code), int(mark[0]), int(mark[1]), weight, len(part), where - low,
                     (length << 32) | left, part, s1, s2, low)
                )
        names = "anchor s1 s2 weight size at room snippet p1 p2 shift".split()
        kinds = [pa.int64()] * 7 + [pa.binary()] + [pa.int64()] * 3
        columns = list(zip(*out)) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names
        )


def cover(items: DataFrame, length: int) -> DataFrame:
    """(s1, s2, low, high): repeated bytes of distinct snippets.

    Takes anchor, s1, s2, weight, size, at, room and snippet. A snippet that is
    alone with its anchor is repeated as a whole if it stands for two places.
    Anchors whose snippets fit a block are sorted; for others the strings are
    dealt to longer anchors, each string to one, until all fit. At the latest
    the anchor is the whole string and equal snippets are one.
    """
    per_anchor = items.groupBy("anchor").agg(
        F.sum("weight").alias("places"),
        F.count("*").alias("kinds"),
        F.sum(F.col("size") + 1).alias("bytes"),
    )
    dealt = stored(items.join(per_anchor.where("places > 1"), "anchor"), "suffix-items")
    alone = dealt.where("kinds = 1").selectExpr("s1", "s2", "0L AS low", "size AS high")
    blocks = dealt.where(f"kinds > 1 AND bytes <= {BLOCK}")
    sorted_ = (
        blocks.select("anchor", "s1", "s2", "weight", "snippet")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "s1", "s2")
        .mapInArrow(tidy(_sort_blocks(length)), COVER)
    )
    result = alone.unionByName(sorted_)
    large = dealt.where(f"kinds > 1 AND bytes > {BLOCK}")
    if large.isEmpty():
        return result
    children = stored(
        large.select("s1", "s2", "weight", "at", "room", "snippet").mapInArrow(
            tidy(_refine),
            "anchor long, s1 long, s2 long, weight long, size long, at long, room long, "
            "snippet binary, p1 long, p2 long, shift long",
        ),
        "suffix-refined",
    )
    distinct = children.groupBy("anchor", "s1", "s2").agg(
        F.sum("weight").alias("weight"),
        *(F.first(c).alias(c) for c in ("size", "at", "room", "snippet")),
    )
    inner = cover(distinct, length)
    parents = children.select("s1", "s2", "p1", "p2", "shift").distinct()
    lifted = parents.join(inner, ["s1", "s2"]).selectExpr(
        "p1 AS s1", "p2 AS s2", "low + shift AS low", "high + shift AS high"
    )
    return result.unionByName(lifted)


# -- documents ----------------------------------------------------------------


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [tuple(r) for r in merged]


def repeated_ranges(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, ranges): bytes of each document that lie in a string of
    `length` bytes that starts at another place too. th is the text's hash;
    documents without such bytes are absent. Takes doc_id, th and binary text.

    The snippets of equal documents are equal, so copies are counted, not
    compared. Texts are exchanged once, to fetch one example of each snippet.
    """
    anchors = stored(
        documents.select("doc_id", "th", "text").mapInArrow(
            tidy(_find_anchors(length, gram)),
            "anchor long, s1 long, s2 long, doc_id long, th long, start long, size long, at long",
        ),
        "suffix-anchors",
    )
    shared = (
        anchors.groupBy("anchor")
        .agg(
            F.count("*").alias("places"),
            F.min("s1").alias("least"),
            F.max("s1").alias("most"),
        )
        .where("places > 1")
        .selectExpr("anchor", "least < most AS differ")
    )
    # Written first: Spark splits the places of one anchor over tasks only in a
    # join that does not take over the partitions of the aggregation.
    shared = stored(shared, "suffix-shared").hint("merge")
    members = stored(anchors.join(shared, "anchor"), "suffix-members")
    same = members.where("NOT differ").selectExpr(
        "doc_id", "th", "start AS low", "start + size AS high"
    )
    examples = (
        members.where("differ")
        .groupBy("anchor", "s1", "s2")
        .agg(
            F.count("*").alias("weight"),
            F.first("size").alias("size"),
            F.first("at").alias("at"),
            F.min(F.struct("doc_id", "th", "start")).alias("m"),
        )
        .select("anchor", "s1", "s2", "weight", "size", "at", "m.*")
    )
    texts = documents.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    items = (
        examples.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
        .selectExpr(
            "anchor",
            "s1",
            "s2",
            "weight",
            "size",
            "at",
            f"{(length << 32) | (length - gram)}L AS room",
            "substring(text, CAST(start + 1 AS INT), CAST(size AS INT)) AS snippet",
        )
        .dropDuplicates(["anchor", "s1", "s2"])
    )
    found = stored(cover(items, length), "suffix-cover")
    rest = (
        members.where("differ")
        .join(found, ["s1", "s2"])
        .selectExpr("doc_id", "th", "start + low AS low", "start + high AS high")
    )
    ranges = same.unionByName(rest).groupBy("doc_id", "th")
    return stored(ranges.agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "suffix-ranges")


def remove_repeats(
    documents: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """Columns `keep` plus n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)
    and spans, the maximal removed runs as (low, high).

    Texts are bytes in UTF-8, a null text is empty; matches never cross texts,
    and strings are judged on the input. Rows with equal doc_id and text count
    as two places, like other copies.
    """
    rows = documents.select(
        *keep,
        F.col("doc_id").cast("long").alias("_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"),
    ).withColumn("_th", F.xxhash64("_text"))
    plain = rows.select(
        F.col("_id").alias("doc_id"), F.col("_th").alias("th"), F.col("_text").alias("text")
    )
    ranges = repeated_ranges(plain, length, gram).selectExpr("doc_id AS d", "th AS t", "ranges")
    joined = rows.join(
        ranges, F.col("_id").eqNullSafe(F.col("d")) & (F.col("_th") == F.col("t")), "left"
    ).select(*keep, "_text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low_ in range(0, whole.num_rows, 500):
                batch = whole.slice(low_, 500)
                size, removed, count, sha, kept, spans = [], [], [], [], [], []
                for text, found in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                    data = text.as_py()
                    runs = merge([(r["low"], r["high"]) for r in found.as_py() or []])
                    ends = [0, *(x for run in runs for x in run), len(data)]
                    rest = b"".join([data[a:b] for a, b in zip(ends[::2], ends[1::2])])
                    size.append(len(data))
                    removed.append(len(data) - len(rest))
                    count.append(len(runs))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                    spans.append([{"low": a, "high": b} for a, b in runs])
                span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(keep)],
                        *(pa.array(c, pa.int64()) for c in (size, removed, count)),
                        pa.array(sha, pa.string()),
                        pa.array(kept, pa.binary()),
                        pa.array(spans, span),
                    ],
                    [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
                )

    schema = "".join(
        f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)]
    )
    return joined.mapInArrow(
        tidy(cut),
        schema + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
        "spans array<struct<low: long, high: long>>",
    )
