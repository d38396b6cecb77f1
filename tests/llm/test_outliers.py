from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from rasterlark.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    again = np.zeros(len(words), bool)
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            again[i : i + 3] = True
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        int(again.sum()),
    )


def test_counts(documents, awkward):
    rng = random.Random(1)
    texts = [r[1] for r in awkward] + ["a b c a b c d", "a a a a", "x\nx\n\n\ny x\nx", "#|<> * $"]
    for _ in range(60):
        texts.append("".join(rng.choices(["a", "b", " ", "\n", "#", "c d", " "], k=60)))
    frame = documents(list(enumerate(texts)))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    found = {r.doc_id: tuple(r[n] for n in names) for r in outliers.text_statistics(frame).collect()}
    assert found == {i: counts(t) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def corpus(prose):
    rows = [(i, prose(60 + i % 200, i), "en", f"s{i % 2}") for i in range(600)]
    junk = []
    for i in range(40):
        words = prose(120, 5000 + i).split()
        junk.append((1000 + i, " ".join(w + "***" for w in words), "en", f"s{i % 2}"))
    return rows, junk


def test_junk_goes_and_prose_stays(documents, corpus):
    rows, junk = corpus
    found = {r.doc_id: r for r in outliers.judge(documents(rows + junk)).collect()}
    assert all(found[r[0]].kept and not found[r[0]].base_failed for r in rows)
    assert not any(found[r[0]].kept or found[r[0]].base_failed for r in junk)
    assert len({r.group for r in found.values()}) == 2


def test_small_groups_are_drawn_to_all(documents, corpus):
    rows, junk = corpus
    odd = [(2000, rows[5][1], None, None), (2001, junk[0][1], "xx", "tiny")]
    found = {r.doc_id: r for r in outliers.judge(documents(rows + odd)).collect()}
    assert found[2000].group == "[null,null]" and found[2001].group == '["xx","tiny"]'
    assert found[2000].kept and not found[2001].kept


def test_copies_of_junk_in_a_third_of_a_group(documents, corpus):
    rows, junk = corpus
    clean = [(i, t, "en", "s") for i, t, *_ in rows[:400]]
    copies = [(5000 + i, junk[0][1], "en", "s") for i in range(200)]
    found = {r.doc_id: r for r in outliers.judge(documents(clean + copies)).collect()}
    assert not any(found[r[0]].kept for r in copies)
    assert all(found[r[0]].kept for r in clean)


def odd_texts(prose):
    """One text for each feature, odd in that alone."""
    words = prose(300, 77).split()
    lines = [prose(6, 900 + i) for i in range(20)]
    phrase = " ".join(words[:40])
    return {
        "word_length": " ".join(w + "qu" * 4 for w in words),
        "symbols": " ".join(w + "*" if i % 2 else w for i, w in enumerate(words)),
        "dup_lines": "\n".join(["yes"] * 12 + lines + [prose(300, 78)]),
        "repeats": " ".join([phrase] * 3 + words[40:200]),
    }


@pytest.mark.parametrize("size", [30, 300])
def test_each_feature_alone_can_reject(documents, prose, corpus, size):
    """In a group of thirty as in a larger one."""
    rows = [(i, t, "en", "s") for i, t, *_ in corpus[0][:size]]
    rest = [(3000 + i, t, "en", "t") for i, t, *_ in corpus[0][300:]]
    odd = [(9000 + i, t, "en", "s") for i, t in enumerate(odd_texts(prose).values())]
    found = {r.doc_id: r for r in outliers.judge(documents(rows + rest + odd)).collect()}
    assert [found[r[0]].kept or found[r[0]].base_failed for r in odd] == [False] * 4
    assert all(found[r[0]].kept for r in rows + rest)


def plain_minimum_determinant(x, starts=60, seed=1):
    """Fast form of the estimate with random starts; cores as index sets."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    h = min(n, (n + p + 1) // 2)
    best = None
    for _ in range(starts):
        some = x[rng.choice(n, p + 1, replace=False)]
        mean, scatter = some.mean(0), np.cov(some.T, bias=True) + np.eye(p)
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
            core = x[np.argsort(d, kind="stable")[:h]]
            mean = core.mean(0)
            scatter = outliers.core_factor(0.5) * np.cov(core.T, bias=True) + np.eye(p)
        size = np.linalg.slogdet(scatter)[1]
        if best is None or size < best[0] - 1e-9:
            best = size, mean, scatter
    _, mean, scatter = best
    d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(scatter), x - mean)
    inside = x[d <= outliers.chi_squared_quantile(outliers.INSIDE)]
    factor = outliers.core_factor(outliers.INSIDE)
    return inside.mean(0), factor * np.cov(inside.T, bias=True) + np.eye(p)


def test_estimate_is_that_of_a_plain_version(spark):
    """Correlated data with a third of it elsewhere, partly as copies."""
    rng = np.random.default_rng(3)
    rows = []
    for group, n in (("a", 900), ("b", 150)):
        mix = rng.normal(size=(4, 4)) * 2
        x = rng.normal(size=(n, 4)) @ mix + 5
        x[: n // 6] = x[: n // 6] * 0.2 + 40
        x[n // 6 : n // 3] = 30.0
        rows += [(group, str(i), *map(float, v)) for i, v in enumerate(x)]
    frame = spark.createDataFrame(
        rows, "group string, key string, x0 double, x1 double, x2 double, x3 double"
    ).repartition(3)
    found = {r.group: r for r in outliers.minimum_determinant(frame, 2).collect()}
    for group in "ab":
        x = np.array([r[2:] for r in rows if r[0] == group])
        mean, scatter = plain_minimum_determinant(x)
        at = found[group]
        got = np.zeros((4, 4))
        for i, j in outliers.PAIRS:
            got[i, j] = got[j, i] = at[f"c{i}{j}"]
        # Cores differ by rows of one class of distances at the bound.
        spread = np.sqrt(np.diag(scatter))
        assert at.n == len(x)
        assert np.abs((np.array([at[m] for m in outliers.MEANS]) - mean) / spread).max() < 0.1
        assert np.abs((got - scatter) / np.outer(spread, spread)).max() < 0.15


def test_equal_rows_up_to_the_breakdown_point(spark):
    """The core has (79 + 5) / 2 = 42 rows, of 44 that belong together."""
    rows = [("g", str(i), 0.1 * (i % 7), 0.0, 0.0, 0.0) for i in range(44)]
    rows += [("g", str(100 + i), 50.0, 0.0, 0.0, 0.0) for i in range(35)]
    frame = spark.createDataFrame(
        rows, "group string, key string, x0 double, x1 double, x2 double, x3 double"
    )
    at = outliers.minimum_determinant(frame, 1).first()
    assert at.m0 < 1 and at.c00 < 2


def test_a_class_at_the_bound_counts_with_the_share_needed(spark):
    """Ten rows at the start, thirty equal ones beyond: the core of 22 takes 12."""
    rows = [("g", "", 0.0, 0.0, 0.0, 0.0)] * 10 + [("g", "", 3.0, 0.0, 0.0, 0.0)] * 30
    frame = spark.createDataFrame(
        rows, "group string, key string, x0 double, x1 double, x2 double, x3 double"
    )
    unit = ", ".join(f"{int(i == j)}D AS c{i}{j}" for i, j in outliers.PAIRS)
    start = spark.sql(f"SELECT 'g' AS group, 0 AS start, 0D m0, 0D m1, 0D m2, 0D m3, {unit}")
    step = outliers._concentrate(frame, start, 1).first()
    assert step.m0 == pytest.approx(3 * 12 / 22)


def test_sql_of_the_same_rule(spark, documents, corpus, awkward, tmp_path):
    import duckdb

    from rasterlark.llm.oracle import all_oracles

    rows, junk = corpus
    more = [(7000 + i, *r[1:]) for i, r in enumerate(awkward)]
    path = str(tmp_path / "documents.parquet")
    documents(rows[:300] + junk + more).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    expected = connection.sql(all_oracles()["op4_robust_outliers"]).fetchall()
    found = outliers.judge(spark.read.parquet(path)).drop("lang", "source", "group", "distance2")
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_awkward_texts(documents, awkward):
    found = outliers.judge(documents(awkward)).collect()
    assert len(found) == len(awkward)
    assert {r.doc_id for r in found if r.base_failed} == {3, 4, 5, 7, 8, 9, None}
    assert all(not r.kept for r in found if r.base_failed)
    assert outliers.judge(documents([])).count() == 0
    assert [r.kept for r in outliers.judge(documents([(1, None)])).collect()] == [False]


def test_core_factor_of_a_normal_sample():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400_000, outliers.SIZE))
    near = np.sort((x**2).sum(1))[int(len(x) * 0.75)]
    core = x[(x**2).sum(1) <= near]
    assert outliers.core_factor(0.75) == pytest.approx(1 / core.var(axis=0).mean(), rel=0.01)


def test_no_python_in_the_plan(documents, corpus):
    from conftest import plan

    assert "Python" not in plan(outliers.judge(documents(corpus[0])))
