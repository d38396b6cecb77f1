"""Language-model scores by marginals over all segmentations of each word.

A text is a sequence of words and one end. A word is either taken whole, with
its share of the training words, or spelt: the lattice of a word has an edge for
every vocabulary piece at every place, and the forward recursion sums the
probabilities of all paths in log space. The vocabulary is a given file; its
pieces' weights start from the file's scores and are re-estimated by
expectation-maximisation over the distinct training words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import stored, tidy

WORDS_IN_MEMORY = 150_000  # distinct words a task counts before it hands them on
FREQUENT = 100_000  # at most so many words are scored from a broadcast table
ROUNDS = 2  # of expectation-maximisation
WORDS_AT_ONCE = 4_000
ROWS_AT_ONCE = 500
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 19


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as byte strings; a leading space marks a word's start.

    log_p is normalised over the pieces that start a word, and over the others
    together with `log_stop`, the end of a word. Each of the 256 bytes is a
    piece, so no word is without a path. `table` maps a hash slot to a piece or
    prefix, `keys` holds the full hash, `ids` the piece or -1 for a mere prefix.
    """

    pieces: tuple[bytes, ...]
    log_p: np.ndarray
    log_stop: float
    keys: np.ndarray
    ids: np.ndarray
    longest: int

    def plain(self) -> tuple:
        """The fields, to be broadcast: workers may lack this package, and with it
        this class, which tasks make anew."""
        return self.pieces, self.log_p, self.log_stop, self.keys, self.ids, self.longest

    @property
    def starts(self) -> np.ndarray:
        return np.array([p.startswith(b" ") for p in self.pieces])


def _extend(hashed: np.ndarray, byte: np.ndarray) -> np.ndarray:
    mixed = (hashed ^ (byte.astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
    return mixed ^ (mixed >> np.uint64(29))


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)


def make_pieces(scores: dict[bytes, float]) -> Pieces:
    """Weights are the exponentials of `scores`; bytes that are no piece get
    the lowest of them."""
    scores = {p: s for p, s in scores.items() if p and p != b" " and b" " not in p[1:]}
    lowest = min(scores.values(), default=0.0)
    for byte in range(256):
        scores.setdefault(bytes([byte]), lowest)
    pieces = tuple(sorted(scores))
    prefixes: dict[bytes, int] = {}
    for i, piece in enumerate(pieces):
        for end in range(1, len(piece)):
            prefixes.setdefault(piece[:end], -1)
        prefixes[piece] = i
    keys, ids = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -2, np.int32)
    for prefix, i in prefixes.items():
        hashed = np.zeros(1, np.uint64)
        for byte in prefix:
            hashed = _extend(hashed, np.array([byte]))
        at = int(_slot(hashed)[0])
        while ids[at] != -2:
            at = (at + 1) % _SLOTS
        keys[at], ids[at] = hashed[0], i
    made = Pieces(pieces, np.zeros(0), 0.0, keys, ids, max(map(len, pieces)))
    return weigh(made, np.exp([scores[p] for p in pieces]), 0.3 * sum(map(np.exp, scores.values())))


def weigh(pieces: Pieces, weights: np.ndarray, stop: float) -> Pieces:
    starts = pieces.starts
    inner = weights[~starts].sum() + stop
    log_p = np.log(weights) - np.log(np.where(starts, weights[starts].sum(), inner))
    return replace(pieces, log_p=log_p, log_stop=float(np.log(stop / inner)))


def read_pieces(model_file: str) -> Pieces:
    """The vocabulary of a sentencepiece model, in lower case as the texts are.

    A merge-rank model stores minus the rank as a score; a piece then weighs
    the inverse of its rank. Scores of other models are log-probabilities.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    scores = {}
    ranked = all(
        model.get_score(i) == int(model.get_score(i)) for i in range(model.get_piece_size())
    )
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        score = float(model.get_score(i))
        if piece == piece.lower():
            scores[piece] = -np.log(2.0 - score) if ranked else score
    return make_pieces(scores)


@dataclass
class Lattice:
    """Edges of many words: word, start and end byte, piece; sorted by end."""

    ends: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def build_lattice(words: list[bytes], pieces: Pieces) -> Lattice:
    sizes = np.array([len(w) + 1 for w in words])
    flat = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    last = (base + sizes)[owner]
    place, hashed = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
    found = []
    for length in range(1, pieces.longest + 1):
        inside = place + length <= last[place]
        place, hashed = place[inside], hashed[inside]
        if not len(place):
            break
        hashed = _extend(hashed, flat[place + length - 1])
        slot = _slot(hashed)
        piece = np.full(len(place), -2, np.int32)
        open_ = np.arange(len(place))
        while len(open_):
            at = slot[open_]
            hit = pieces.keys[at] == hashed[open_]
            hit &= pieces.ids[at] != -2
            piece[open_[hit]] = pieces.ids[at[hit]]
            open_ = open_[~hit & (pieces.ids[at] != -2)]
            slot[open_] = (slot[open_] + 1) % _SLOTS
        known = piece >= 0
        at = place[known]
        found.append((owner[at], at - base[owner[at]], np.full(len(at), length), piece[known]))
        alive = piece != -2
        place, hashed = place[alive], hashed[alive]
    word, start, length, piece = (np.concatenate(x) for x in zip(*found))
    end = start + length
    order = np.lexsort((word, end))
    return Lattice(sizes, word[order], start[order], end[order], piece[order])


def _sum_logs(terms: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group heads and log-sum-exp of each run of equal groups."""
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    top = np.maximum.reduceat(terms, heads)
    repeat = np.repeat(top, np.diff(np.append(heads, len(terms))))
    return groups[heads], top + np.log(np.add.reduceat(np.exp(terms - repeat), heads))


def forward(lattice: Lattice, pieces: Pieces) -> np.ndarray:
    """alpha[w, j]: log-probability of the first j bytes of word w over all
    segmentations. Places no path reaches are -inf."""
    base = np.concatenate([[0], np.cumsum(lattice.ends + 1)])
    alpha = np.full(base[-1], -np.inf)
    alpha[base[:-1]] = 0.0
    steps = np.searchsorted(lattice.end, np.arange(1, lattice.ends.max(initial=0) + 2))
    for low, high in zip(steps[:-1], steps[1:]):
        if low == high:
            continue
        word = lattice.word[low:high]
        terms = alpha[base[word] + lattice.start[low:high]] + pieces.log_p[lattice.piece[low:high]]
        usable = terms > -np.inf
        if usable.any():
            words, sums = _sum_logs(terms[usable], word[usable])
            alpha[base[words] + lattice.end[low]] = sums
    return alpha


def log_marginals(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural log-probability of spelling each word, its end included."""
    if not words:
        return np.zeros(0)
    lattice = build_lattice(words, pieces)
    alpha = forward(lattice, pieces)
    return alpha[np.cumsum(lattice.ends + 1) - 1] + pieces.log_stop


def expected_counts(words: list[bytes], pieces: Pieces) -> np.ndarray:
    """How often each piece occurs in the words, over all segmentations."""
    lattice = build_lattice(words, pieces)
    alpha = forward(lattice, pieces)
    base = np.concatenate([[0], np.cumsum(lattice.ends + 1)])
    total = alpha[base[1:] - 1]
    beta = np.full(base[-1], -np.inf)
    beta[base[1:] - 1] = 0.0
    order = np.lexsort((lattice.word, lattice.start))
    word, start, end, piece = (
        x[order] for x in (lattice.word, lattice.start, lattice.end, lattice.piece)
    )
    steps = np.searchsorted(start, np.arange(0, lattice.ends.max() + 1))
    for low, high in reversed(list(zip(steps[:-1], steps[1:]))):
        if low == high:
            continue
        terms = beta[base[word[low:high]] + end[low:high]] + pieces.log_p[piece[low:high]]
        usable = terms > -np.inf
        if usable.any():
            words_, sums = _sum_logs(terms[usable], word[low:high][usable])
            beta[base[words_] + start[low]] = sums
    share = alpha[base[word] + start] + pieces.log_p[piece] + beta[base[word] + end]
    return np.bincount(piece, np.exp(share - total[word]), len(pieces.pieces))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text; those of held-out texts count nothing but are named."""
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "word": pa.array(list(seen), pa.binary()),
                "n": pa.array(list(seen.values()), pa.int64()),
            }
        )

    for batch in batches:
        for text, trains in zip(batch.column(0), batch.column(1).to_pylist()):
            words = (text.as_py() or b"").lower().split()
            if trains:
                seen.update(words)
            else:
                for word in words:
                    seen.setdefault(word, 0)
            if len(seen) > WORDS_IN_MEMORY:
                yield rows()
                seen.clear()
    yield rows()


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n): every word of the texts and its count in training texts.
    Takes text and trains; tasks count before the exchange."""
    parts = documents.selectExpr("CAST(text AS BINARY) AS text", "trains").mapInArrow(
        tidy(_count_words), "word binary, n long"
    )
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def estimate(types: DataFrame, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Re-estimates the weights on distinct words, each counted once, because it
    is new words that are spelt. Only sums per piece reach the driver."""
    for _ in range(rounds):
        shipped = types.sparkSession.sparkContext.broadcast(pieces.plain())

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(*shipped.value)
            sums, words = np.zeros(len(pieces.pieces)), 0
            for batch in batches:
                whole = batch.column(0).to_pylist()
                words += len(whole)
                for low in range(0, len(whole), WORDS_AT_ONCE):
                    sums += expected_counts(whole[low : low + WORDS_AT_ONCE], pieces)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict(
                {
                    "piece": pa.array([*used, -1], pa.int64()),
                    "n": pa.array([*sums[used], float(words)], pa.float64()),
                }
            )

        found = types.select("word").mapInArrow(tidy(expect), "piece long, n double")
        sums = found.groupBy("piece").agg(F.sum("n").alias("n")).toPandas().set_index("piece")["n"]
        words = float(sums.get(-1, 0.0))
        weights = np.full(len(pieces.pieces), 0.01)
        used = sums.index[sums.index >= 0].to_numpy(np.int64)
        weights[used] += sums[used].to_numpy()
        pieces = weigh(pieces, weights, words + 1.0)
    return pieces


def score_texts(documents: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """Scores every text; takes doc_id, text and trains, the last being whether
    the model learns from the row.

    Returns doc_id, trains, n_tokens, n_known, train_tokens, base_score and score
    (log10). A null text counts as empty: one token, the end. Rows with the same
    doc_id and text are told apart by number only, so each comes back.

    The most frequent words, FREQUENT at most, so every hot one, are scored from
    a broadcast table; only other words are exchanged, as one
    row per document and word, so no join key is hot.
    """
    spark = documents.sparkSession
    rows = documents.selectExpr(
        "doc_id", "CAST(coalesce(text, '') AS BINARY) AS text", "coalesce(trains, false) AS trains"
    )
    counts = stored(count_words(rows), "lm-words")
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)),
        F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)),
    ).first()
    ends = rows.where("trains").count()
    word_tokens, types, once = map(int, totals)
    tokens, distinct = word_tokens + ends, types + (ends > 0)
    pieces = estimate(counts.where("n > 0"), pieces) if types else pieces

    log_end = float(np.log10((ends + 1) / (tokens + 2)))
    log_word = float(np.log10((word_tokens + 1) / (tokens + 2)))
    # The share of words seen once estimates how often a word is new.
    spelt = (once + 1) / (word_tokens + 2)
    base_total = tokens + distinct + 1
    shipped = spark.sparkContext.broadcast(pieces.plain())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*shipped.value)
        for batch in batches:
            words, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            whole = words.to_pylist()
            marginal = [
                log_marginals(whole[low : low + WORDS_AT_ONCE], pieces)
                for low in range(0, len(whole), WORDS_AT_ONCE)
            ]
            logs = np.concatenate(marginal) if marginal else np.zeros(0)
            with np.errstate(divide="ignore"):
                kept = np.log((1 - spelt) * n / max(word_tokens, 1))
            logs = np.logaddexp(kept, np.log(spelt) + logs) / np.log(10) + log_word
            base = np.log10((n + 1) / base_total)
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(n > 0), pa.array(base), pa.array(logs)],
                ["word", "known", "base", "log_p"],
            )

    scores = stored(
        counts.mapInArrow(tidy(spell), "word binary, known boolean, base double, log_p double"),
        "lm-scores",
    )
    # Count classes of an eighth of an octave; as many of the top ones as fit.
    grade = F.floor(F.log2("n") * 8).cast("int")
    classes = counts.where("n > 0").groupBy(grade.alias("grade")).count().collect()
    least, room = None, frequent
    for row in sorted(classes, reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.grade
    top = scores.join(
        counts.where(F.lit(False) if least is None else (F.col("n") > 0) & (grade >= least)),
        "word",
        "left_semi",
    ).select("word", "base", "log_p").toArrow()
    hot = spark.sparkContext.broadcast(
        (
            {word: i for i, word in enumerate(top.column("word").to_pylist())},
            np.stack([top.column(c).to_numpy() for c in ("base", "log_p")]),
        )
    )

    def sum_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, logs = hot.value
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                sums, rest, rest_n = [], [], []
                for text in batch.column(3):
                    words = text.as_py().lower().split()
                    at, times, other, other_n = [], [], [], []
                    for word, n in Counter(words).items():
                        number = numbers.get(word)
                        if number is None:
                            other.append(word)
                            other_n.append(n)
                        else:
                            at.append(number)
                            times.append(n)
                    base, log_p = logs[:, at] @ np.array(times, float)
                    sums.append((len(words), sum(times), base, log_p))
                    rest.append(other)
                    rest_n.append(other_n)
                tokens_, known, base, log_p = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:3],
                        pa.array(tokens_, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(log_p, pa.float64()),
                        pa.array(rest, pa.list_(pa.binary())),
                        pa.array(rest_n, pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "trains", "tokens", "known", "base", "log_p", "rest", "rest_n"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    partial = stored(
        rows.selectExpr("xxhash64(doc_id, text) AS row", "doc_id", "trains", "text").mapInArrow(
            tidy(sum_hot),
            f"row long, doc_id {id_type}, trains boolean, tokens long, known long, base double, "
            "log_p double, rest array<binary>, rest_n array<long>",
        ),
        "lm-partial",
    )
    rare = (
        partial.selectExpr("row", "explode(arrays_zip(rest, rest_n)) AS w")
        .selectExpr("row", "w.rest AS word", "w.rest_n AS n")
        .join(scores, "word")
        .selectExpr("row", "n * CAST(known AS INT) AS known", "n * base AS base", "n * log_p AS log_p")
    )
    sums = (
        partial.selectExpr("row", "doc_id", "trains", "tokens", "1L AS copies", "known", "base", "log_p")
        .unionByName(rare, allowMissingColumns=True)
        .groupBy("row")
        .agg(
            F.first("doc_id", True).alias("doc_id"),
            F.first("trains", True).alias("trains"),
            *(F.sum(c).alias(c) for c in ("tokens", "copies", "known", "base", "log_p")),
        )
    )
    end_base = float(np.log10((ends + 1) / base_total))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).selectExpr(
        "doc_id",
        "trains",
        "tokens div copies + 1 AS n_tokens",
        f"known div copies + {int(ends > 0)} AS n_known",
        f"{tokens}L AS train_tokens",
        f"base / copies + {end_base!r}D AS base_score",
        f"log_p / copies + {log_end!r}D AS score",
    )
