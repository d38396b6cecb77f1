"""Similarity join of documents by MinHash banding.

A document is its set of word n-grams. Bands of MinHash rows, chosen for a
target recall, are exchanged by their hash; documents that share a band are
candidates, and candidates are compared on their full sets. Equal sets are
one candidate with a count, so exact copies are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import stored, tidy

WORDS = 5  # of an n-gram
ROWS_AT_ONCE = 500
GROUP_GRAMS = 500_000  # n-grams of candidates that one task compares at once
MAX_HASHES = 128
FETCH_ROWS = 500_000  # up to so many candidates are broadcast to fetch their texts
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    bands: int
    rows: int

    def recall(self, similarity: float) -> float:
        return 1.0 - (1.0 - similarity**self.rows) ** self.bands


def choose_bands(threshold: float, recall: float, hashes: int = MAX_HASHES) -> Bands:
    """The most rows per band, so the fewest chance candidates, with which pairs
    at the threshold are still found with the target recall."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if Bands(bands, rows).recall(threshold) >= recall:
                return Bands(bands, rows)
    raise ValueError("no banding reaches that recall with so few hashes")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of hashed word n-grams. Words are runs of non-white space, A-Z in
    lower case; a text of fewer words than WORDS is one n-gram, a text without
    words has none. Hashes have 64 bits: two n-grams of one pair of documents
    coincide with a chance below 1e-9 even at millions of words."""

    def __init__(self) -> None:
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest
        self.known: dict[bytes, int] = {}

    def grams(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = self.hash(word)
        x = np.array([known[word] for word in words], np.uint64)
        n = min(WORDS, len(x))
        grams = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):
            grams = _mixed(grams * _PRIME + x[i : i + len(grams)])
        return np.unique(grams)


def signature(grams: np.ndarray, bands: Bands) -> np.ndarray:
    """One hash per band of the minima of `rows` hash functions each."""
    count = bands.bands * bands.rows
    odd = _mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    shift = _mixed(np.arange(1, count + 1, dtype=np.uint64) + _PRIME)
    least = np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(grams), 1 << 14):
        some = grams[None, start : start + (1 << 14)]
        for low in range(0, count, 16):
            part = slice(low, low + 16)
            values = some * odd[part, None] + shift[part, None]
            values ^= values >> np.uint64(32)
            least[part] = np.minimum(least[part], values.min(axis=1))
    keys = np.zeros(bands.bands, np.uint64)
    for row in range(bands.rows):
        keys = _mixed(keys * _PRIME + least[row :: bands.rows])
    return keys.view(np.int64)


def _describe(bands: Bands):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(low, ROWS_AT_ONCE)
                high, low_, sizes, keys = [], [], [], []
                for text in part.column(1):
                    grams = shingler.grams(text.as_py())
                    digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                    high.append((digest >> 64) - (1 << 63))
                    low_.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    sizes.append(len(grams))
                    keys.append(signature(grams, bands) if len(grams) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(high, pa.int64()),
                        pa.array(low_, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "h1", "h2", "size", "keys"],
                )

    return describe


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, label): the smallest node of each connected component, for every
    node of `edges` (a, b).

    Labels spread along edges and are then replaced by their own labels, so the
    longest path halves each round. Nothing but two counts reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), f"{purpose}-edges")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS label"),
        f"{purpose}-labels",
    )
    total = None
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("m"))
        )
        spread = labels.join(near, labels.node == near.a).selectExpr(
            "node", "least(label, m) AS label"
        )
        spread = stored(spread, f"{purpose}-labels")
        up = spread.selectExpr("node AS label", "label AS higher")
        labels = stored(
            spread.join(up, "label", "left").selectExpr(
                "node", "least(label, coalesce(higher, label)) AS label"
            ),
            f"{purpose}-labels",
        )
        # Labels only fall: an equal sum means that nothing changed.
        new = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if new == total:
            return labels
        total = new


def compare(
    copies: np.ndarray, grams: list[np.ndarray], side: np.ndarray, threshold: float
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set, counted in documents, and a spanning forest of them.

    Side 0 is compared with side 1; without a split (side -1) all with all.
    Intersections are counted through posting lists, a set at a time.
    """
    sizes = np.array([len(g) for g in grams])
    code, gram = np.unique(np.concatenate(grams), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    posting = np.repeat(np.arange(len(grams)), sizes)[order]
    first = np.searchsorted(gram[order], np.arange(len(code) + 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    links = np.zeros(len(grams), np.int64)
    label = np.arange(len(grams))
    forest = []
    for row in np.flatnonzero(side <= 0):
        g = gram[offsets[row] : offsets[row + 1]]
        low, n = first[g], first[g + 1] - first[g]
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(posting[at], minlength=len(grams))
        near = shared >= threshold * (sizes[row] + sizes - shared) - 1e-9
        near &= (side == 1) if side[row] == 0 else (np.arange(len(grams)) > row)
        near = np.flatnonzero(near)
        links[row] += copies[near].sum()
        links[near] += copies[row]
        labels, at = np.unique(label[near], return_index=True)
        new = labels != label[row]
        if new.any():
            forest += [(int(row), int(x)) for x in near[at[new]]]
            label[np.isin(label, labels[new])] = label[row]
    return links, forest


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by job: (group, low chunk, high chunk)."""

        def result(rows: list[tuple]) -> pa.RecordBatch:
            ids = [r[3] for r in rows]
            grams = [np.frombuffer(r[6], np.uint64) for r in rows]
            links, forest = compare(
                np.array([r[4] for r in rows]), grams, np.array([r[5] for r in rows]), threshold
            )
            linked = np.flatnonzero(links)
            a = [ids[i] for i in linked] + [ids[x] for x, _ in forest]
            b = [None] * len(linked) + [ids[y] for _, y in forest]
            n = [int(x) for x in links[linked]] + [0] * len(forest)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "links"]
            )

        job, rows = None, []
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if rows and row[:3] != job:
                        if len(rows) > 1:
                            yield result(rows)
                        rows = []
                    job = row[:3]
                    rows.append(row)
        if len(rows) > 1:
            yield result(rows)

    return verify


def near_duplicates(
    documents: DataFrame, threshold: float = 0.8, recall: float = 0.995
) -> DataFrame:
    """(doc_id, class_id, n_links): for each document the smallest doc_id of its
    class, the documents joined by chains of links, and how many other documents
    it is linked to, that is with Jaccard similarity of word 5-grams of at least
    the threshold. Takes integer doc_id and text.

    Texts with equal n-gram sets are linked; null texts and texts without words
    have no links. Rows of one doc_id are one document: of different texts the
    one whose digest is smallest counts. Rows without doc_id are one document
    with null class_id and no links.
    """
    bands = choose_bands(threshold, recall)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    described = rows.mapInArrow(
        tidy(_describe(bands)), "doc_id long, h1 long, h2 long, size long, keys array<long>"
    )
    described = stored(
        described.groupBy("doc_id")
        .agg(F.min(F.struct("h1", "h2", "size", "keys")).alias("d"))
        .select("doc_id", "d.*"),
        "near-signatures",
    )
    # One candidate for each distinct set: its smallest document.
    sets = stored(
        described.where("size > 0 AND doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(
            F.min("doc_id").alias("id"),
            F.count("*").alias("copies"),
            F.first("keys").alias("keys"),
            F.first("size").alias("size"),
        ),
        "near-sets",
    )
    by_band = sets.select("id", F.posexplode("keys").alias("band", "key"))
    heads = by_band.groupBy("band", "key").agg(
        F.min("id").alias("a"), F.count("*").alias("n")
    ).where("n > 1")
    edges = by_band.join(heads, ["band", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    groups = components(edges, "near-candidates").withColumnRenamed("node", "id")

    # Full sets of candidates, once each; a group above GROUP_GRAMS is cut into
    # chunks and every two of its chunks are one job.
    members = stored(
        groups.join(sets.select("id", "copies", "size", "h1", "h2"), "id"), "near-members"
    )
    weights = members.groupBy("label").agg(F.sum("size").alias("grams"))
    chunks = F.when(F.col("grams") <= GROUP_GRAMS, F.lit(1).cast("long"))
    weights = weights.withColumn(
        "chunks", chunks.otherwise(F.ceil(F.col("grams") * 2 / GROUP_GRAMS))
    )
    dealt = members.join(weights, "label").withColumn(
        "chunk", F.pmod(F.xxhash64("id", F.lit(1)), "chunks")
    )
    wanted = members.select("id", "h1", "h2")
    if members.count() <= FETCH_ROWS:
        wanted = F.broadcast(wanted)  # 24 bytes a row; texts then stay where they are
    texts = rows.withColumnRenamed("doc_id", "id").join(wanted, "id")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(low, ROWS_AT_ONCE)
                keep, sets_ = [], []
                for i, (text, h1, h2) in enumerate(zip(*(part.column(c) for c in (1, 2, 3)))):
                    grams = shingler.grams(text.as_py())
                    digest = xxhash.xxh3_128_intdigest(grams.tobytes())
                    same = (digest >> 64) - (1 << 63) == h1.as_py()
                    if same and (digest & ((1 << 64) - 1)) - (1 << 63) == h2.as_py():
                        keep.append(i)
                        sets_.append(grams.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(sets_, pa.binary())],
                    ["id", "grams"],
                )

    grams = stored(
        texts.mapInArrow(tidy(shingle), "id long, grams binary").dropDuplicates(["id"]), "near-grams"
    )
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    jobs = (
        dealt.select("label", "id", "copies", "chunk", others.alias("other"))
        .selectExpr(
            "label",
            "least(chunk, other) AS low",
            "greatest(chunk, other) AS high",
            "id",
            "copies",
            "CASE WHEN chunk = other THEN -1 WHEN chunk < other THEN 0 ELSE 1 END AS side",
        )
        .join(grams, "id")
    )
    found = stored(
        jobs.select("label", "low", "high", "id", "copies", "side", "grams")
        .repartition("label", "low", "high")
        .sortWithinPartitions("label", "low", "high", "id")
        .mapInArrow(tidy(_verify(threshold)), "a long, b long, links long"),
        "near-links",
    )
    classes = components(found.where("b IS NOT NULL").select("a", "b"), "near-classes")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    verdict = (
        sets.select("id", "h1", "h2", "copies")
        .join(classes, sets.id == classes.node, "left")
        .join(links, sets.id == links.a, "left")
        .selectExpr(
            "h1",
            "h2",
            "coalesce(label, id) AS class_id",
            "coalesce(links, 0L) + copies - 1 AS n_links",
        )
    )
    known = described.select("doc_id", "h1", "h2", F.expr("doc_id IS NOT NULL").alias("named"))
    verdict = verdict.withColumn("named", F.lit(True))
    return known.join(verdict, ["h1", "h2", "named"], "left").selectExpr(
        "doc_id", "coalesce(class_id, doc_id) AS class_id", "coalesce(n_links, 0L) AS n_links"
    )
