from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlark.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(d, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def run(frame, length=suffix_dedup.LENGTH, gram=suffix_dedup.GRAM):
    found = suffix_dedup.remove_repeats(frame, ["doc_id"], length, gram).collect()
    for r in found:
        assert sum(s.high - s.low for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert len(r.kept) == r.n_bytes - r.n_removed
    return Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def shared(prose):
    """Texts with common passages, copies, runs and small alphabets."""
    rng = random.Random(8)
    passage = prose(90, 70)
    texts = []
    for i in range(40):
        parts = [prose(rng.randint(10, 120), 100 + i)]
        for _ in range(rng.randint(0, 2)):
            low = rng.randint(0, 200)
            parts.insert(rng.randint(0, 1), passage[low : low + rng.randint(100, 500)])
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3] + "!", "ab" * 700, "a" * 399, "a" * 400, "b" * 401]
    texts.append("".join(rng.choices("ab", k=900)))
    return texts


def test_removed_bytes(documents, prose):
    texts = shared(prose)
    assert run(documents(list(enumerate(texts)))) == brute(texts, 400)


@pytest.mark.parametrize("block", [500, 5000])
def test_anchors_with_more_than_a_block(documents, prose, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = shared(prose)
    assert run(documents(list(enumerate(texts)))) == brute(texts, 400)


def test_short_strings_and_many_segments(documents, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    texts = shared(prose)[:20] + ["aab" * 60, "\x00\x00\x01" * 40, "é\U0001f600" * 30]
    assert run(documents(list(enumerate(texts))), 24, 8) == brute(texts, 24)


def test_places_of_one_anchor_are_split_over_tasks(spark, documents, prose, monkeypatch):
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.files.maxPartitionBytes": "16k",  # many tasks that write places
        "spark.sql.files.openCostInBytes": "16k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",  # as for many shared anchors
        "spark.sql.shuffle.partitions": "20",
    }
    old = {key: spark.conf.get(key) for key in settings}
    tasks = []

    def watched(frame, purpose):
        if purpose == "suffix-members":
            placed = frame.withColumn("task", F.spark_partition_id())
            tasks.extend((r.anchor, r.task) for r in placed.collect())
        return stored(frame, purpose)

    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", watched)
    texts = shared(prose)[:20] + [prose(40, 500 + i) + "ab" * 400 + prose(40, 600 + i) for i in range(60)]
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert run(documents(list(enumerate(texts))).repartition(8)) == brute(texts, 400)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    anchor, places = Counter(a for a, _ in tasks).most_common(1)[0]
    most = max(Counter(t for a, t in tasks if a == anchor).values())
    assert places > 1000 and most < places / 2


def test_awkward_texts(documents, awkward):
    texts = [r[1] for r in awkward]
    assert run(documents(awkward)) == brute(texts, 400)


def test_no_documents(documents):
    assert run(documents([])) == Counter()


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 400).astype(np.uint16)
    order, rank = suffix_dedup.suffix_array(text)
    suffixes = [tuple(text[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    assert (rank[order] == np.arange(400)).all()


def test_boundaries_are_short_common_prefixes():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 500), 0).astype(np.uint16)
    order, rank = suffix_dedup.suffix_array(text)
    for length in (1, 3, 6):
        found = suffix_dedup.boundaries(text, order, rank, length)
        for i in range(1, len(order)):
            a, b = tuple(text[order[i - 1] :][:length]), tuple(text[order[i] :][:length])
            if 0 not in a:
                assert found[i] == (a != b)


def test_weights_count_places():
    data = [b"x" + bytes(range(65, 85)), b"y" + bytes(range(65, 85)), b"qqqwww" * 4]
    starts = suffix_dedup.repeated_starts(data, [1, 1, 1], 20)
    assert [s.tolist() for s in starts[:2]] == [[1], [1]]
    assert suffix_dedup.repeated_starts(data[:1], [2], 20)[0].tolist() == [0, 1]
