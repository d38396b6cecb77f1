from __future__ import annotations

import random

import pytest

from rasterlark.llm import queries, toxicity

BAD = ["wretch", "dolt", "rascal"]


def texts(prose, n, seed=0):
    """(text, toxic): every fourth one has some of three words strewn in."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng.randint(20, 120), seed * 10_000 + i).split()
        toxic = int(i % 4 == 0)
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((" ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def model(spark, prose):
    rows = [(i, t, x, i % 5 < 2) for i, (t, x) in enumerate(texts(prose, 400))]
    rows += [(900, None, 0, True), (901, "", 1, False), (902, "no label", None, False), (None, "odd", 7, True)]
    frame = spark.createDataFrame(rows, "key long, text string, toxic int, calibrates boolean")
    return toxicity.learn_toxicity(frame.repartition(3))


SCORED = "doc_id long, text string, score string, kept string, features string"


def test_held_out_accuracy(spark, prose, model):
    rows = texts(prose, 200, 7)
    frame = spark.createDataFrame([(i, t, "", "", "") for i, (t, _) in enumerate(rows)], SCORED)
    found = {r.doc_id: r for r in toxicity.score_texts(frame, model, ["doc_id"]).collect()}
    right = sum(found[i].predicted == x for i, (_, x) in enumerate(rows))
    assert right >= 0.95 * len(rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found.values())


def test_samples_of_windows_have_their_size(spark, prose):
    rows = [(i, prose(500, i)) for i in range(40)] + [(i, "the same " * 400) for i in range(40, 60)]
    frame = spark.createDataFrame(rows, "key long, text string")
    total = sum(len(t) for _, t in rows)
    whole = toxicity.sample_windows(frame.repartition(3), 10 * total)
    words = sorted(w for _, t in rows for w in t.lower().encode().split())
    assert sorted(w for p in whole for w in p.split()) == words
    part = toxicity.sample_windows(frame.repartition(3), total // 10)
    assert 0.5 * total / 10 < sum(map(len, part)) < 1.6 * total / 10
    assert part == toxicity.sample_windows(frame.repartition(5), total // 10)


def test_only_what_differs_is_in_the_toxic_dictionary(model):
    assert all(f" {word} ".encode() in model.toxic for word in BAD)


def test_features_follow_the_lengths(model):
    """Each feature from plain compressions of the windows."""
    scale = toxicity.Scale(model.ordinary, model.toxic)
    words = [w.encode() for w in ("the wretch " * 20 + "of and " * 30).split()]
    saved = []
    for low in range(0, len(words), toxicity.WINDOW):
        window = b" " + b" ".join(words[low : low + toxicity.WINDOW]) + b" "
        saved.append(len(scale.plain.compress(window)) - len(scale.both.compress(window)))
    found = scale.features(b" ".join(words).decode().upper())
    shares = [sum(s >= t for s in saved) / (len(saved) + 1) for t in toxicity.THRESHOLDS]
    assert found[1 : 1 + len(shares)] == shares and found[-2] == max(0, *saved)


def test_awkward_texts(spark, documents, awkward, model):
    found = toxicity.score_texts(documents(awkward), model, ["doc_id"]).collect()
    assert len(found) == len(awkward)
    assert all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1


@pytest.mark.parametrize("rows", [[], [(1, "a b", 1, True)], [(1, "a b", 0, False), (2, "c", None, True)]])
def test_little_to_learn_from(spark, rows, documents):
    frame = spark.createDataFrame(rows, "key long, text string, toxic int, calibrates boolean")
    learnt = toxicity.learn_toxicity(frame)
    found = toxicity.score_texts(documents([(1, "a b c"), (2, None)]), learnt, ["doc_id"])
    assert {r.doc_id for r in found.collect() if 0 <= r.score <= 1} == {1, 2}


def test_query_takes_repeated_labels_and_both_joins(spark, documents, prose, monkeypatch, tmp_path):
    rows = texts(prose, 120, 3)
    documents([(i, t) for i, (t, _) in enumerate(rows)]).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, x) for i, (_, x) in enumerate(rows)] * 2 + [(None, 1, 1), (5000, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    first = queries.op12_compression_toxicity(spark, str(tmp_path)).collect()
    monkeypatch.setattr(queries, "LABELS_AT_ONCE", 0)
    second = queries.op12_compression_toxicity(spark, str(tmp_path)).collect()
    assert len(first) == 120
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))
