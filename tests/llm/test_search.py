from __future__ import annotations

import math

import numpy as np
import pytest

from rasterlark.llm import search

SCHEMA = "vec_id long, embedding array<float>, label int, x string, norm2 string"


def brute(rows, queries, k=10):
    sound = [
        (i, [math.floor(1024 * float(np.float32(c))) for c in v])
        for i, v in rows
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = set()
    for q in {i for i, _ in sound if queries(i)}:
        mine = min(v for i, v in sound if i == q)
        scored = [
            (-sum(a * b for a, b in zip(mine, v)), i)
            for i, v in sound
            if i != q and len(v) == len(mine)
        ]
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            out.add((q, rank, i, max(-(2**63), min(2**63 - 1, -score))))
    return out


def run(spark, rows, queries, k=10):
    frame = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA).repartition(3)
    vectors = search.integer_vectors(frame)
    found = search.top_k(vectors, vectors.where(queries), k).collect()
    result = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found}
    assert len(result) == len(found)
    return result


def test_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "HEAD", 16)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.exponential()).tolist()) for i in range(300)]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_awkward_rows(spark):
    rows = [(i, [1.0, 0.5]) for i in range(40)]
    rows += [(40, None), (41, [None, 1.0]), (42, [math.nan, 1.0]), (43, [math.inf, 1.0])]
    rows += [(44, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [2.0, 2.0]), (45, []), (46, [-0.1, 0.0])]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0)


def test_every_length_has_its_own_search(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=i % 4).tolist()) for i in range(120)] + [(5, []), (20, [9.0, 9.0])]
    assert run(spark, rows, "vec_id % 5 = 0") == brute(rows, lambda i: i % 5 == 0)


def test_large_components(spark, monkeypatch):
    """The longest vectors are the likeliest hits; products that 64 bits do not
    hold are ranked exactly."""
    monkeypatch.setattr(search, "STRETCH", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100)]
    rows += [(100 + i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 36)).tolist()) for i in range(100)]
    rows += [(300 + i, [9e5 + i] * 6) for i in range(20)] + [(330, [2e6] * 6), (331, [-3e38] * 6)]
    rows += [(332, [0.0] * 6), (340, [3.3e38] * 6), (341, [3.3e38] * 6), (342, [3.2e38] * 6)]
    assert run(spark, rows, "vec_id % 5 = 0") == brute(rows, lambda i: i % 5 == 0)


def test_largest_doubles(spark):
    vectors = [[1.7e308, 1.0], [1.6e308, 1.0], [-1.7e308, 0.0], [1.0, 1.0], [0.0, 0.0]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = search.integer_vectors(frame)
    found = search.top_k(whole, whole.where("vec_id = 0"), 10).orderBy("rank").collect()
    most, least = 2**63 - 1, -(2**63)
    assert [(r.vec_id, r.score) for r in found] == [(1, most), (3, most), (4, 0), (2, least)]


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0])], [(100, None)]])
def test_too_few_vectors(spark, rows):
    assert run(spark, rows, "vec_id % 100 = 0") == set()


def test_bound_is_never_below_the_product():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (50, 12))
    rotation = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    own = search.Vectors(np.arange(50), x / search.SCALE, rotation)
    lead = own.rotated[:, : own.lead] @ own.rotated[:, : own.lead].T
    bound = lead + own.rest[:, None] * own.rest[None, :]
    assert (bound + 1e-6 >= x @ x.T).all()
