from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from compare import difference

from rasterlark.llm import oracle, queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, of long"


def brute(rows, parts=4, entries=256, rounds=4):
    """By plain lists of Python's integers."""

    def whole(x):
        return int(x) * 1024 if abs(x) >= 2.0**52 else math.floor(x * 1024)

    kept = [
        (i, [whole(c) for c in v], label)
        for i, v, label in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out, errors = [], defaultdict(int)
    for size in {len(v) for _, v, _ in kept}:
        same = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if size % parts:
            out += [(i, label, None, None, None) for i, _, label in same]
            continue
        w = size // parts
        books = [[v[p * w : (p + 1) * w] for _, v, _ in same[:entries]] for p in range(parts)]

        def nearest(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                held = defaultdict(list)
                for _, v, _ in same:
                    part = v[p * w : (p + 1) * w]
                    held[nearest(part, books[p])[1]].append(part)
                for k, own in held.items():
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
        text = ",".join(str(c) for book in books for e in book for c in e)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i, v, label in same:
            found = [nearest(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
            error = sum(d for d, _ in found)
            out.append((i, label, "".join(f"{k:02x}" for _, k in found), error, sha))
    fits = {label: True for _, label, *_ in out}
    for _, label, code, error, _ in out:
        if code is not None:
            errors[label] += error
            fits[label] &= error < 1 << 63
    return [
        (
            i,
            label,
            code,
            error if error is None or error < 1 << 63 else None,
            errors[label] if fits[label] and label in errors and errors[label] < 1 << 63 else None,
            sha,
        )
        for i, label, code, error, sha in out
    ]


def check(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, n, "", 0) for i, v, n in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in vector_codes.compress(frame, **options).collect()]
    assert sorted(found, key=str) == sorted(brute(rows, **options), key=str)
    return found


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(150)]
    check(spark, rows, entries=32)


def test_ties_copies_and_awkward_rows(spark):
    rows = [(i, [1.0, -0.5] * 4, i % 2) for i in range(30)] + [(i, [0.1 * i] * 8, None) for i in range(30, 60)]
    rows += [(7, [3.0] * 8, 1), (None, [2.0] * 8, 5), (None, None, 5), (60, None, 1)]
    rows += [(61, [None] * 8, 1), (62, [math.nan] * 8, 1), (63, [math.inf] * 8, 2)]
    rows += [(64, [1.0] * 4, 1), (65, [2.0] * 4, 1), (66, [1.0] * 5, 8), (67, [], 9)]
    check(spark, rows, entries=16)


def test_components_beyond_64_bits(spark):
    rows = [(i, [float(i), 2.0, 3e300, -1.0], 0) for i in range(5)]
    rows += [(9, [1e30, 2.0, 3.0, 4.0], 1), (10, [1.0, 9e5, -7e4, 70000.5], 2), (11, [1.0, 2.0, 3.0, 4.0], 3)]
    assert all(r[3] is None for r in check(spark, rows, entries=4) if r[0] < 5)
    assert all(r[3] == 0 for r in check(spark, rows, entries=7) if r[0] < 5)


def test_errors_beyond_64_bits(spark):
    rows = [(i, [float(i), 2.0, 3e300, -1.0], i % 2) for i in range(5)] + [(9, [1.0, 2.0, 3.0, 4.0], 2)]
    assert all(r[2] and r[3] is None and r[4] is None for r in check(spark, rows, entries=1))


def test_slices_hold_every_nearest_entry():
    rng = np.random.default_rng(2)
    book = rng.integers(-20, 20, (200, 5))
    parts = rng.integers(-60, 60, (500, 5))
    entry, squares = vector_codes.Slices(book).nearest(parts)
    every = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (squares == every.min(1)).all() and (entry == every.argmin(1)).all()


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0, 3.0, 4.0], 0)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_labels_joined_by_exchange(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS_AT_ONCE", 0)
    check(spark, [(i, [float(i)] * 4, i % 3 or None) for i in range(20)])


def test_equal_to_sql(spark):
    sql = oracle.all_oracles()["op13_vector_codes"]
    assert difference(spark, "/root/testdata/sf0.001", queries.op13_vector_codes, sql) is None
