from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from rasterlark.llm import near_duplicates
from rasterlark.llm.near_duplicates import choose_bands


def grams(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(texts, threshold=0.8):
    sets = {i: grams(t) for i, t in texts.items()}
    links, root = defaultdict(set), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), len(links[i])) for i in sets}


def run(frame, **options):
    found = near_duplicates.near_duplicates(frame, **options).collect()
    result = {r.doc_id: (r.class_id, r.n_links) for r in found}
    assert len(result) == len(found)
    return result


def copies(prose, n):
    """Texts of ten families with some words changed, and exact copies."""
    rng = random.Random(2)
    texts = {}
    for i in range(n):
        words = prose(150, i % 10).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        texts[i] = " ".join(words)
    return texts


def test_links_and_classes(documents, prose):
    texts = copies(prose, 120)
    assert run(documents(list(texts.items()))) == brute(texts)


def test_groups_of_many_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP_GRAMS", 600)
    monkeypatch.setattr(near_duplicates, "FETCH_ROWS", 0)
    texts = copies(prose, 90)
    assert run(documents(list(texts.items()))) == brute(texts)


def test_awkward_texts(documents, awkward):
    found = run(documents(awkward))
    assert set(found) == {r[0] for r in awkward}
    assert found[1] == (1, 1) and found[2] == (1, 1)
    assert found[3] == (3, 0) and found[4] == (4, 0) and found[5] == (5, 0)
    assert found[None] == (None, 0)


def test_short_texts_and_case(documents):
    found = run(documents([(1, "A b"), (2, "a B "), (3, "a b c"), (4, "É b"), (5, "é b")]))
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}


def test_no_documents(documents):
    assert run(documents([])) == {}


@pytest.mark.parametrize("threshold, recall", [(0.8, 0.995), (0.5, 0.9), (0.95, 0.999), (1.0, 0.99)])
def test_bands_reach_the_recall(threshold, recall):
    bands = choose_bands(threshold, recall)
    assert bands.recall(threshold) >= recall
    assert bands.bands * bands.rows <= near_duplicates.MAX_HASHES
    # With one row more the recall needs too many hashes.
    more = bands.rows + 1
    fewer = near_duplicates.MAX_HASHES // more
    assert fewer == 0 or near_duplicates.Bands(fewer, more).recall(threshold) < recall


def test_signatures_agree_as_often_as_sets_overlap():
    bands = near_duplicates.Bands(128, 1)
    a = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first, second = (near_duplicates.signature(x, bands) for x in (a[:2000], a[1000:]))
    assert (first == second).mean() == pytest.approx(1 / 3, abs=0.12)
    long = np.arange(40_000, dtype=np.uint64)
    assert len(near_duplicates.signature(long, bands)) == 128


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 800), (5, 5)], "a long, b long")
    found = {r.node: r.label for r in near_duplicates.components(edges, "chain").collect()}
    assert found == {**{i: 0 for i in range(201)}, 800: 800, 900: 800}
