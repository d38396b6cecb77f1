from __future__ import annotations

import random

import numpy as np
import pytest

from rasterlark.llm import languages

PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["ver", "ung", "sch"], "cc": ["ção", "ñe", "ura"]}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(n))


@pytest.fixture(scope="module")
def model(documents):
    rows = [(i, text(lang, i), lang) for i in range(40) for lang in PARTS]
    return languages.learn_languages(documents(rows))


def predict(docs, model):
    return languages.predict_languages(docs, model, ["doc_id"]).collect()


def test_held_out_texts(documents, model):
    rows = [(i, text(lang, 1000 + i), lang) for i, lang in enumerate(list(PARTS) * 10)]
    found = {r.doc_id: r for r in predict(documents(rows), model)}
    assert all(found[i].lang_pred == lang and found[i].lang_set == [lang] for i, _, lang in rows)


def test_proportions_of_a_mixture(documents, model):
    rows = [(1, text("aa", 7, 300) + " " + text("bb", 8, 100)), (2, text("cc", 9, 5))]
    found = {r.doc_id: r for r in predict(documents(rows), model)}
    assert found[1].lang_set == ["aa", "bb"] and found[1].score == pytest.approx(
        300 * 7 / (300 * 7 + 100 * 10), abs=0.03
    )
    assert sum(found[1].lang_shares) == pytest.approx(1)
    assert found[2].lang_pred == "cc"


def test_awkward_texts(documents, awkward, model):
    found = predict(documents(awkward), model)
    assert len(found) == len(awkward)
    by_id = {r.doc_id: r for r in found if r.doc_id}
    for doc_id in (3, 4, 5, 9):
        assert by_id[doc_id].lang_pred == "und" and by_id[doc_id].score == 0
    assert all(0 <= r.score <= 1 for r in found)


def test_letters_beyond_ascii_count_as_letters(documents, model):
    found = {r.doc_id: r.lang_pred for r in predict(documents([(1, "日本"), (2, "１２！")]), model)}
    assert found[1] != "und" and found[2] == "und"


def test_nothing_learned(documents):
    empty = languages.learn_languages(documents([(1, None, "en"), (2, "abc", None)]))
    assert empty.languages == ()
    assert predict(documents([(1, "abc")]), empty)[0].lang_pred == "und"
    assert predict(documents([]), empty) == []


def test_likelihood_never_falls():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50), 4).T
    counts = rng.integers(1, 9, 50).astype(float)
    share, likelihood = languages._proportions(p, counts)
    start = float(counts @ np.log(p.mean(axis=1)))
    assert share.sum() == pytest.approx(1) and likelihood >= start
