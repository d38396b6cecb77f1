"""Exact top-k search by inner product.

Vectors are stored by falling length. A block of queries is rotated onto the
principal directions of the vectors, so that the leading coordinates carry most
of an inner product; what the others can add is bounded by the lengths of the
two remainders (Cauchy-Schwarz). A pair is computed exactly only if this bound
reaches the query's k-th best score so far, and a stretch of the sorted vectors
is skipped for queries that even its longest vector cannot help. Products that
could leave 64 bits are computed with whole numbers of any size. Vectors of each
length are searched among their own kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.llm.common import stored

SCALE = 1024
QUERIES_AT_ONCE = 4096  # size of a query block; the only thing that is broadcast
HEAD = 2048  # longest vectors, which give first thresholds
STRETCH = 2048  # vectors a task looks at together
NARROW = 2.0**62  # products of lengths below this are computed in 64 bits
MOST, LEAST = 2**63 - 1, -(2**63)  # what a score can be
ROOM = 272  # bytes of the number beyond a score: products of doubles fit
LEVEL = b"\x80"  # nothing beyond


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, norm2) of the rows that take part.

    x holds the components as doubles; scores are those of floor(1024 * component).
    Rows without vec_id, null vectors and those with a null, NaN or infinite
    component take no part. norm2 is the squared length, up to rounding.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: c.cast("double")).alias("x"),
    )
    sound = F.forall("x", lambda c: F.coalesce(F.abs(c) < math.inf, F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    square = F.aggregate("x", F.lit(0.0), lambda total, c: total + c * c)
    return rows.withColumn("norm2", square)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def _whole(vector: np.ndarray) -> list[int]:
    """floor(1024 * component), exact for every finite double."""
    return [math.floor(c * SCALE) if abs(c) < 1e300 else int(c) * SCALE for c in vector.tolist()]


def _beyond(score: int) -> bytes:
    """What a score leaves over 64 bits, so that bytes compare as the numbers do."""
    rest = score - max(LEAST, min(MOST, score))
    return LEVEL if rest == 0 else (rest + (1 << 8 * ROOM - 1)).to_bytes(ROOM, "big")


def principal_directions(vectors: DataFrame) -> np.ndarray:
    """Eigenvectors of the sum of outer products, largest first: columns. Tasks
    sum over their rows; as many numbers as the matrix has reach the driver.
    Vectors whose squares are too large for a double are left out: any rotation
    gives right results, this one the tightest bounds."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            x = x[(np.abs(x) < 1e140).all(1)]
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None and total.size:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = vectors.select("x").mapInArrow(outer, "i long, j long, v double")
    sums = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if sums.empty:
        return np.zeros((0, 0))
    gram = np.zeros((int(sums.i.max()) + 1,) * 2)
    gram[sums.i, sums.j] = sums.v
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


class Vectors:
    """Vectors with what the bounds take: scaled components, lengths, rotated form."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, rotation: np.ndarray):
        self.ids, self.raw = ids, raw
        self.lead = max(1, raw.shape[1] // 4)
        with np.errstate(over="ignore", invalid="ignore"):
            self.x = np.floor(raw * SCALE)
            self.norm = np.sqrt((self.x**2).sum(1))
            self.rotated = self.x @ rotation
            self.rest = np.sqrt((self.rotated[:, self.lead :] ** 2).sum(1))
        self.narrow = self.norm < NARROW
        self.whole = np.where(self.narrow[:, None], self.x, 0).astype(np.int64)


class Block:
    """Some queries and the best candidates found for them."""

    def __init__(self, ids, raw, rotation, k, floor=None):
        self.own, self.k = Vectors(ids, raw, rotation), k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def products(self, others: Vectors, q, c) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of pairs, cut to 64 bits, and what lies beyond."""
        score, beyond = np.zeros(len(q), np.int64), np.full(len(q), LEVEL, object)
        with np.errstate(over="ignore", invalid="ignore"):
            fits = self.own.norm[q] * others.norm[c] < NARROW
        fits &= self.own.narrow[q] & others.narrow[c]
        plain = np.flatnonzero(fits)
        for low in range(0, len(plain), 1 << 16):
            part = plain[low : low + (1 << 16)]
            score[part] = np.einsum("ij,ij->i", self.own.whole[q[part]], others.whole[c[part]])
        left: dict[int, list[int]] = {}
        right: dict[int, list[int]] = {}
        for at in np.flatnonzero(~fits):
            i, j = int(q[at]), int(c[at])
            a = left.get(i) or left.setdefault(i, _whole(self.own.raw[i]))
            b = right.get(j) or right.setdefault(j, _whole(others.raw[j]))
            value = sum(u * v for u, v in zip(a, b))
            score[at], beyond[at] = max(LEAST, min(MOST, value)), _beyond(value)
        return score, beyond

    def look(self, ids: np.ndarray, raw: np.ndarray, rotation: np.ndarray) -> None:
        own, others = self.own, Vectors(ids, raw, rotation)
        # A bound that is no number, of vectors too long for a double, prunes nothing.
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * (1 + others.norm.max(initial=0.0) * own.norm.max(initial=0.0))
            alive = np.flatnonzero(~(own.norm * others.norm.max(initial=0.0) + slack < self.floor))
            if not len(alive):
                return
            bound = own.rotated[alive, : own.lead] @ others.rotated[:, : own.lead].T
            bound += own.rest[alive][:, None] * others.rest[None, :] + slack
            q, c = np.nonzero(~(bound < self.floor[alive][:, None]))
        q = alive[q]
        other = own.ids[q] != ids[c]
        q, c = q[other], c[other]
        score, beyond = self.products(others, q, c)
        good = score >= self.floor[q]
        self.found.append((q[good], ids[c[good]], score[good], beyond[good]))
        self.held += int(good.sum())
        if self.held > 4 * self.k * len(own.ids):
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        """Keeps the k best of each query and raises its threshold."""
        if not self.found:
            return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, object))
        q, ids, score, beyond = (np.concatenate(x) for x in zip(*self.found))
        level = np.zeros(len(q), np.int64)
        if (beyond != LEVEL).any():
            level = np.unique(beyond, return_inverse=True)[1]
        order = np.lexsort((ids, -level, ~score, q))
        q, ids, score, beyond = q[order], ids[order], score[order], beyond[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep, last = place < self.k, place == self.k - 1
        # As a double, never above the whole number.
        least = np.where(np.abs(score) < 2**53, score, np.nextafter(score.astype(float), -np.inf))
        self.floor[q[last]] = np.maximum(self.floor[q[last]], least[last])
        best = (q[keep], ids[keep], score[keep], beyond[keep])
        self.found, self.held = [best], len(best[0])
        return best


FOUND = "query_id long, vec_id long, score long, beyond binary"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner
    products with the rows of `vectors` of another vec_id, ties to the smaller.

    Both frames come from `integer_vectors`. Repeated candidate rows count each;
    of queries with one vec_id the smallest vector is taken. A query meets the
    vectors of its own length; vectors without components have product 0. Ranks
    go by the exact product; a score outside 64 bits is given as the nearest
    number inside. Query blocks of bounded size are broadcast one after another,
    candidates stay where they are: only each task's k best per query are
    exchanged.
    """
    spark = vectors.sparkSession
    queries = stored(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    lengths = queries.select(F.size("x").alias("d")).distinct().orderBy("d").collect()
    results = None
    for row in lengths:
        of_length = F.size("x") == row.d
        found = _top_of_length(vectors.where(of_length), queries.where(of_length), k)
        if found is not None:
            results = found if results is None else results.unionByName(found)
    if results is None:
        results = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _top_of_length(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """Each task's k best for each query, of vectors of one length."""
    spark = vectors.sparkSession
    ordered = stored(
        vectors.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(
            F.desc("norm2"), "vec_id"
        ),
        "vectors",
    )
    rotation = principal_directions(ordered)
    head = ordered.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).select("vec_id", "x").toArrow()
    head = head.combine_chunks()
    head_ids = head.column(0).to_numpy()
    if not len(head_ids):
        return None
    head_x = _matrix(head.column(1).combine_chunks())
    if not rotation.size:  # no components, or none that a double can hold squared
        rotation = np.eye(head_x.shape[1])

    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    results = None
    for number in range(blocks):
        rows = dealt.where(F.col("block") == number).select("vec_id", "x").toArrow().combine_chunks()
        ids = rows.column(0).to_numpy()
        if not len(ids):
            continue
        x = _matrix(rows.column(1).combine_chunks())
        first = Block(ids, x, rotation, k)
        first.look(head_ids, head_x, rotation)
        first.shrink()
        shipped = spark.sparkContext.broadcast((ids, x, rotation, first.floor))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, x, rotation, floor = shipped.value
            block = Block(ids, x, rotation, k, floor)
            for batch in batches:
                for low in range(0, batch.num_rows, STRETCH):
                    part = batch.slice(low, STRETCH)
                    block.look(part.column(0).to_numpy(), _matrix(part.column(1)), rotation)
            q, found, score, beyond = block.shrink()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(found), pa.array(score), pa.array(beyond, pa.binary())],
                ["query_id", "vec_id", "score", "beyond"],
            )

        best = ordered.select("vec_id", "x").mapInArrow(search, FOUND)
        results = best if results is None else results.unionByName(best)
    return results
