"""Compression of vectors to short codes by product quantisation.

A vector is cut into equal consecutive parts; each part is replaced by the
number of the nearest entry in the codebook of its position. Codebooks are
learned by rounds of assignment and averaging, all in integers.

The nearest entry is found by slices and bit masks. For each dimension of a
codebook the coordinates are sorted, and before each place stands the set of
the entries up to it, as 64-bit masks. A radius cuts a range out of every
dimension; the two masks at its ends give the entries in the range, and the
masks of all dimensions, ANDed, the entries in the cube around the part. The
radius starts small and doubles until the cube holds an entry. The distance to
the best one found is then the radius of a last cube, which holds every entry
that is as near: comparing distances in it is exact.

Tasks sum over their rows; what reaches the driver is bounded by the size of
the codebooks. Nothing but those sums is exchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import stored

SCALE = 1024
PARTS = 4
ENTRIES = 256  # of a codebook; two hexadecimal digits
ROUNDS = 4
NARROW = 2.0**26  # scaled components below it, and their squares, fit 64 bits
LIMB = 40  # bits of a sum that are exchanged as one number
ROWS_AT_ONCE = 1024
LABELS_AT_ONCE = 50_000  # label sums that are broadcast; more are joined by exchange

Codebooks = dict[int, list[np.ndarray]]  # vector length -> entries x dimensions, by part


def integer_parts(flat: np.ndarray) -> np.ndarray:
    """floor(1024 * x): 64-bit integers, or Python's where these would not do."""
    wide = np.abs(flat) >= NARROW / SCALE
    whole = np.floor(np.where(wide, 0, flat) * SCALE).astype(np.int64)
    if not wide.any():
        return whole
    whole = whole.astype(object)
    for i in np.flatnonzero(wide):
        x = float(flat[i])
        whole[i] = int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE)
    return whole


def _squares(difference: np.ndarray) -> np.ndarray:
    if difference.dtype == object:
        return (difference * difference).sum(1) if difference.shape[1] else np.zeros(len(difference), object)
    return np.einsum("ij,ij->i", difference, difference)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Integers not below the square roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(int(s)) + 1 for s in squares], object)
    return np.sqrt(squares.astype(float)).astype(np.int64) + 1


class Slices:
    """One codebook, its coordinates sorted by dimension with prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        count, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0).T.copy()
        own = np.zeros((count, -(-count // 64)), np.uint64)
        numbers = np.arange(count)
        own[numbers, numbers // 64] = np.uint64(1) << (numbers % 64).astype(np.uint64)
        self.all = np.bitwise_or.reduce(own)
        self.prefix = np.zeros((width, count + 1, own.shape[1]), np.uint64)
        for d in range(width):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(own[order[:, d]])
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """Half of the median distance, in the largest coordinate, from an entry
        to the next one: a cube that most often holds few entries."""
        if len(self.entries) < 2 or not self.entries.shape[1]:
            return 1
        nearest = []
        for i in range(len(self.entries)):
            away = np.abs(self.entries - self.entries[i]).max(1)
            nearest.append(int(min(np.delete(away, i))))
        return max(1, sorted(nearest)[len(nearest) // 2] // 2)

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries in the cube of that radius around each part."""
        masks = np.tile(self.all, (len(parts), 1))
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[d], parts[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[d], parts[:, d] + radius, "right")
            masks &= self.prefix[d, high] ^ self.prefix[d, low]
        return masks

    def best(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry among those of each mask, the lower if equal, and its
        squared distance. No mask is empty."""
        bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        squares = _squares(parts[row] - self.entries[entry])
        first = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(squares, first)
        hit = np.flatnonzero(squares == least[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(parts)))]
        return entry[hit], least

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part."""
        kind = object if object in (parts.dtype, self.entries.dtype) else np.int64
        parts = parts.astype(kind)
        masks = np.zeros((len(parts), len(self.all)), np.uint64)
        radius = np.full(len(parts), self.radius, kind)
        empty = np.arange(len(parts))
        while len(empty):
            masks[empty] = self.within(parts[empty], radius[empty])
            empty = empty[~masks[empty].any(1)]
            radius[empty] *= 2
        _, squares = self.best(parts, masks)
        # Nearer entries than the best one so far lie in the cube of its distance.
        return self.best(parts, self.within(parts, _roots(squares)))


class Quantizer:
    """Codebooks of all vector lengths, with their slices."""

    def __init__(self, codebooks: Codebooks) -> None:
        self.slices = {n: [Slices(b) for b in books] for n, books in codebooks.items()}

    def assign(self, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """For the vectors of each length: length, rows, components, and for each
        part the entries and squared distances. Rows of a length without
        codebooks have no parts."""
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            for low in range(0, len(at), ROWS_AT_ONCE):
                rows = at[low : low + ROWS_AT_ONCE]
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                whole = integer_parts(flat.astype(float)).reshape(len(rows), length)
                books = self.slices.get(length, [])
                width = length // max(1, len(books))
                found = [
                    book.nearest(whole[:, i * width : (i + 1) * width])
                    for i, book in enumerate(books)
                ]
                yield length, rows, whole, found


def sound_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors without null or non-finite components."""
    finite = F.forall(
        "embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False))
    )
    return vectors.select("vec_id", "label", "embedding").where(finite)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """Parts of the vectors with the smallest vec_id (nulls last, then by value),
    for each vector length that can be cut into that many parts."""
    lengths = sorted(r.n for r in rows.select(F.size("embedding").alias("n")).distinct().collect())
    books: Codebooks = {}
    for length in lengths:
        if length % parts:
            continue
        same = rows.where(F.size("embedding") == length)
        first = same.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
        flat = np.array([x for r in first for x in r.embedding], float)
        whole = integer_parts(flat).reshape(len(first), length)
        books[length] = np.split(whole, parts, axis=1)
    return books


def _limbs(value: int, count: int) -> list[int]:
    """`value` as that many numbers of LIMB bits, the last with the sign."""
    low = [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(count - 1)]
    return [*low, value >> (LIMB * (count - 1))]


def next_codebooks(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of
    the mean of its parts. Entries without parts stay."""
    shipped = rows.sparkSession.sparkContext.broadcast(books)
    width = max((b[0].shape[1] for b in books.values()), default=0)
    names = [f"s{d}" for d in range(width)]
    # A double has up to 1024 bits before the point.
    limbs = 2 if all(b.dtype != object for x in books.values() for b in x) else 28

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer = Quantizer(shipped.value)
        total: dict[tuple[int, int], np.ndarray] = {}
        count: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, _, whole, found in quantizer.assign(batch.column(0)):
                for part, (entry, _) in enumerate(found):
                    size = len(quantizer.slices[length][part].entries)
                    own = whole[:, part * (length // len(found)) :][:, : length // len(found)]
                    key = (length, part)
                    if key not in total:
                        total[key] = np.zeros((size, own.shape[1]), np.int64)
                        count[key] = np.zeros(size, np.int64)
                    if own.dtype == object and total[key].dtype != object:
                        total[key] = total[key].astype(object)
                    np.add.at(total[key], entry, own)
                    count[key] += np.bincount(entry, minlength=size)
        out = []
        for (length, part), added in total.items():
            for entry in np.flatnonzero(count[length, part]).tolist():
                values = [int(v) for v in added[entry]]
                number = max(limbs, 28 if added.dtype == object else 0)
                split = [_limbs(v, number) for v in values]
                for limb in range(number):
                    here = [s[limb] for s in split] + [0] * (width - len(split))
                    if limb == 0 or any(here):
                        counted = int(count[length, part][entry]) if limb == 0 else 0
                        out.append((length, part, entry, limb, counted, *here))
        columns = list(zip(*out)) if out else [[] for _ in range(5 + width)]
        fields = ["length", "part", "entry", "limb", "n", *names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

    schema = ", ".join(f"{n} long" for n in ("length", "part", "entry", "limb", "n", *names))
    summed = rows.select("embedding").mapInArrow(sums, schema)
    summed = summed.groupBy("length", "part", "entry", "limb").agg(
        F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names)
    )
    means: dict[tuple[int, int, int], list[int]] = {}
    counts: dict[tuple[int, int, int], int] = {}
    for r in summed.collect():
        key = (r.length, r.part, r.entry)
        own = means.setdefault(key, [0] * books[r.length][r.part].shape[1])
        for d in range(len(own)):
            own[d] += r[5 + d] << (LIMB * r.limb)
        counts[key] = counts.get(key, 0) + r.n
    fresh: Codebooks = {}
    for length, old in books.items():
        fresh[length] = []
        for part, book in enumerate(old):
            values = book.astype(object)
            for entry in range(len(book)):
                if (length, part, entry) in counts:
                    n = counts[length, part, entry]
                    values[entry] = [s // n for s in means[length, part, entry]]
            small = all(abs(v) < NARROW for v in values.ravel())
            fresh[length].append(values.astype(np.int64) if small else values)
    shipped.unpersist()
    return fresh


def digest(books: list[np.ndarray]) -> str:
    numbers = (str(v) for book in books for v in book.ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def encode_rows(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of each row."""
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer = Quantizer(shipped.value)
        digests = {length: digest(b) for length, b in shipped.value.items()}
        for batch in batches:
            code, error, sums = ([None] * batch.num_rows for _ in range(3))
            for length, at, _, found in quantizer.assign(batch.column(2)):
                if not found:
                    continue
                text = np.stack([e for e, _ in found], 1).astype(np.uint8).tobytes().hex()
                squares = sum(s.astype(object) for _, s in found).tolist()
                step = 2 * len(found)
                for i, row in enumerate(at.tolist()):
                    code[row] = text[i * step : (i + 1) * step]
                    error[row] = int(squares[i]) if squares[i] < 1 << 63 else None
                    sums[row] = digests[length]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(code, pa.string()),
                    pa.array(error, pa.int64()),
                    pa.array(sums, pa.string()),
                ],
                ["vec_id", "label", "code", "error", "codebooks_sha256"],
            )

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    return rows.select("vec_id", "label", "embedding").mapInArrow(
        encode,
        f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, "
        "codebooks_sha256 string",
    )


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256).

    Rows whose vector is null or holds a null or non-finite component are left
    out; all others stay, repeated ones too. Each length of vector has its own
    codebooks. A length that cannot be cut into `parts` equal parts has none:
    its rows have null in code, error and hash. An error that does not fit 64
    bits is null, and so is the sum over a label with such an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    rows = sound_rows(vectors)
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        books = next_codebooks(rows, books)
    coded = stored(encode_rows(rows, books), "vector-codes")
    sums = coded.groupBy("label").agg(
        F.try_sum("error").alias("label_error"),
        F.bool_or(F.col("error").isNull() & F.col("code").isNotNull()).alias("wide"),
    )
    sums = stored(
        sums.select(
            F.col("label").alias("of"), F.expr("IF(wide, NULL, label_error)").alias("label_error")
        ),
        "label-errors",
    )
    if sums.count() <= LABELS_AT_ONCE:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
