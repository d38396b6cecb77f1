"""Lattice scores against sums over all segmentations."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from rasterlark.llm import lattice


@pytest.fixture(scope="module")
def pieces():
    scores = {b" the": -2.0, b" t": -3.0, b"he": -2.5, b"h": -4.0, b"e": -3.5, b" ": -9.0,
              b"he ": -1.0, b"then": -1.5, "é".encode(): -3.0, b" th": -2.2, b"en": -2.1}
    return lattice.make_pieces(scores)


def by_hand(word, pieces):
    """Sum over all cuts of the word with its leading space."""
    text = b" " + word
    known = dict(zip(pieces.pieces, pieces.log_p))
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, low = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(text[low:i])
                low = i
        parts.append(text[low:])
        if all(p in known for p in parts):
            total += math.exp(sum(known[p] for p in parts))
    return math.log(total) + pieces.log_stop


@pytest.mark.parametrize("word", [b"the", b"then", b"hehe", b"x", "thé".encode(), b"\xff\x00", b"ttt"])
def test_marginal_is_the_sum_over_segmentations(pieces, word):
    assert lattice.log_marginals([word], pieces)[0] == pytest.approx(by_hand(word, pieces))


def test_words_of_different_lengths_in_one_batch(pieces):
    words = [b"the", b"a" * 5000, b"hehe", b"the"]
    alone = [lattice.log_marginals([w], pieces)[0] for w in words]
    assert lattice.log_marginals(words, pieces) == pytest.approx(alone)
    assert len(lattice.log_marginals([], pieces)) == 0


def test_expected_counts_are_those_of_the_paths(pieces):
    counts = lattice.expected_counts([b"the", b"then"], pieces)
    lengths = sum(c * len(p) for c, p in zip(counts, pieces.pieces))
    assert lengths == pytest.approx(len(" the") + len(" then"))


def test_spelling_probabilities_sum_to_at_most_one(pieces):
    alphabet = [bytes([b]) for b in range(256)]
    short = [b""] + alphabet
    assert np.exp(lattice.log_marginals(short, pieces)).sum() <= 1 + 1e-9


def test_scores_of_awkward_texts(documents, awkward, pieces):
    from pyspark.sql import functions as F

    rows = documents(awkward).withColumn("trains", F.coalesce(F.col("doc_id") != 7, F.lit(True)))
    found = lattice.score_texts(rows, pieces, frequent=20).collect()
    assert len(found) == len(awkward)
    counts = Counter()
    split = {}
    for doc_id, text, *_ in awkward:
        words = (text or "").encode().lower().split()
        split[doc_id, text or ""] = words
        if doc_id != 7:
            counts.update([*words, None])
    tokens, types = sum(counts.values()), len(counts)
    expected = Counter()
    for doc_id, text, *_ in awkward:
        words = [*split[doc_id, text or ""], None]
        base = sum(math.log10((counts[w] + 1) / (tokens + types + 1)) for w in words)
        expected[doc_id, len(words), sum(counts[w] > 0 for w in words), round(base, 6)] += 1
    assert expected == Counter(
        (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found
    )
    assert all(r.train_tokens == tokens and math.isfinite(r.score) and r.score < 0 for r in found)


def test_known_words_score_better_than_unknown(documents, prose, pieces):
    from pyspark.sql import functions as F

    rows = [(i, prose(200, i)) for i in range(30)] + [(100, prose(200, 3)), (101, "qz vx " * 100)]
    docs = documents(rows).withColumn("trains", F.col("doc_id") < 100)
    found = {r.doc_id: r.score for r in lattice.score_texts(docs, pieces).collect()}
    assert found[100] > found[101]


def test_nothing_to_learn_from(documents, pieces):
    from pyspark.sql import functions as F

    docs = documents([(1, "a b"), (2, None)]).withColumn("trains", F.lit(False))
    found = {r.doc_id: r for r in lattice.score_texts(docs, pieces).collect()}
    assert found[1].n_tokens == 3 and found[1].n_known == 0 and found[1].train_tokens == 0
    assert found[2].base_score == 0.0 and found[2].score < 0
    assert lattice.score_texts(docs.where("false"), pieces).count() == 0
