"""Matching of gated pairs and the filter of tracks."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from rasterlark.operators import kalman, matching

PLACE = "frame_id long, id long, x double, y double"
PAIR = "frame_id long, left_id long, right_id long, cost double"


def permuted(pairs):
    """Best matching by trying all: most pairs, least cost, first right ids."""
    costs = {}
    for left, right, cost in pairs:
        costs[left, right] = min(cost, costs.get((left, right), cost))
    lefts, rights = sorted({p[0] for p in costs}), sorted({p[1] for p in costs})
    best = None
    for chosen in itertools.permutations([*rights, *[None] * len(lefts)], len(lefts)):
        made = [(a, b) for a, b in zip(lefts, chosen) if b is not None]
        if any(p not in costs for p in made):
            continue
        key = (-len(made), sum(costs[p] for p in made), [math.inf if b is None else b for b in chosen])
        if best is None or key < best[0]:
            best = key, made
    return sorted((a, b, costs[a, b]) for a, b in best[1]) if best else []


@pytest.mark.parametrize("seed", range(40))
def test_assign_equals_permutations(seed):
    rng = random.Random(seed)
    lefts, rights = rng.randint(1, 5), rng.randint(1, 5)
    share, span = rng.choice([0.3, 0.7, 1.0]), rng.choice([1, 3, 50])
    pairs = [
        (a, b, rng.randint(0, span) - 1)
        for a in range(lefts)
        for b in range(rights)
        if rng.random() < share
    ]
    assert matching.assign(pairs) == permuted(pairs)


def test_assign_of_size_eight():
    rng = random.Random(1)
    cost = [[rng.randint(0, 20) for _ in range(8)] for _ in range(8)]
    pairs = [(a, b, cost[a][b]) for a in range(8) for b in range(8)]
    least = min(sum(cost[a][b] for a, b in enumerate(p)) for p in itertools.permutations(range(8)))
    found = matching.assign(pairs)
    assert len(found) == 8 and sum(c for _, _, c in found) == least
    ties = matching.assign([(a, b, 5) for a in range(8) for b in range(8)])
    assert ties == [(a, a, 5) for a in range(8)]


@pytest.mark.parametrize("frame_pairs", [50_000, 0])
def test_frames_and_components(spark, frame_pairs):
    rng = random.Random(2)
    rows = [
        (f, 4 * g + a, 4 * g + b, float(rng.randint(0, 3)))
        for f in range(2)
        for g in range(8)
        for a in range(4)
        for b in range(4)
        if rng.random() < 0.6
    ]
    rows += [(0, 1, 1, 0.5), (0, 1, 1, 0.5), (1, None, 3, 1.0), (None, 1, 1, 1.0), (1, 1, 3, math.nan)]
    found = matching.match(spark.createDataFrame(rows, PAIR), frame_pairs).collect()
    expected = set()
    for f in range(2):
        for g in range(8):
            own = [r[1:] for r in rows if r[0] == f and r[1] is not None and r[1] // 4 == g and r[3] == r[3]]
            expected |= {(f, *pair) for pair in permuted(own)}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_components_of_a_long_chain(spark):
    chain = [(0, i, i, 1.0) for i in range(60)] + [(0, i + 1, i, 1.0) for i in range(59)]
    rows = chain + [(0, 100 + i, 100 + i, 1.0) for i in range(3)] + [(1, 7, 7, 1.0)]
    found = matching.components(spark.createDataFrame(rows, PAIR)).collect()
    labels = {(r.frame_id, r.left_id): r.component for r in found}
    assert labels == {(0, i): 0 for i in range(60)} | {(0, 100 + i): 100 + i for i in range(3)} | {(1, 7): 7}


@pytest.mark.parametrize("hot_rows", [20_000, 2])
def test_gate(spark, hot_rows):
    rng = random.Random(3)
    left = [(i % 2, i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(60)]
    right = [(i % 2, i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(50)] + [(0, 99, left[0][2] + 1.5, left[0][3])]
    bad = [(0, 200, None, 0.0), (0, 201, math.nan, 0.0), (None, 202, 0.0, 0.0), (0, None, 0.0, 0.0)]
    found = matching.gated_pairs(
        spark.createDataFrame(left + bad, PLACE), spark.createDataFrame(right + bad, PLACE), 1.5, hot_rows
    )
    expected = {
        (a[0], a[1], b[1])
        for a in left
        for b in right
        if a[0] == b[0] and math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) <= 1.5
    }
    rows = found.collect()
    assert {tuple(r)[:3] for r in rows} == expected and len(rows) == len(expected) > 30
    with pytest.raises(ValueError):
        matching.gated_pairs(found, found, 0.0)


# -- filter -----------------------------------------------------------------------

OBSERVED = "track_id string, frame_id long, x double, y double"


def recursion(rows, motion):
    out = []
    state, frame = None, None
    for _, at, x, y in sorted(rows, key=lambda r: r[1:]):
        if state is None:
            state = kalman.first_state(x, y, motion)
        else:
            state = kalman.step(state, at - frame, x, y, motion)
        frame = at
        out.append((at, *state))
    return out


def test_step_equals_matrices():
    motion, dt = kalman.Motion(0.3, 0.02, 2.0), 3.0
    state = (1.0, 0.5, -2.0, 0.1, 0.4, 0.1, 0.9)
    f = np.array([[1, dt], [0, 1]])
    q = motion.change * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
    p = f @ np.array([[state[4], state[5]], [state[5], state[6]]]) @ f.T + q
    gain = p[:, :1] / (p[0, 0] + motion.measured)
    found = kalman.step(state, dt, 2.5, -1.0, motion)
    for at, z in ((0, 2.5), (2, -1.0)):
        mean = f @ np.array(state[at : at + 2])
        assert found[at : at + 2] == pytest.approx(mean + gain[:, 0] * (z - mean[0]))
    p = p - gain @ p[:1]
    assert found[4:] == pytest.approx((p[0, 0], p[0, 1], p[1, 1]))


@pytest.mark.parametrize("chunk_frames", [4096, 64, 7, 1])
def test_equals_the_recursion(spark, chunk_frames):
    rng, motion = random.Random(5), kalman.Motion(0.5, 0.03, 4.0)
    rows, at = [], 0
    for _ in range(300):
        at += rng.choice([1, 1, 1, 2, 40])
        rows.append(("long", at, 0.3 * at + rng.gauss(0, 1), rng.gauss(0, 3)))
    rows += [("one", 5, 1.0, 2.0), ("two", -3, 1.0, 2.0), ("two", 900, 4.0, 2.0)]
    rows += [("same", 8, 2.0, 1.0), ("same", 8, 1.0, 7.0), ("same", 8, 1.0, 3.0), ("same", 9, 1.0, 3.0)]
    bad = [("bad", None, 1.0, 1.0), (None, 1, 1.0, 1.0), ("long", 4, None, 1.0), ("long", 4, 1.0, math.nan)]
    table = spark.createDataFrame(rows + bad, OBSERVED).repartition(5)
    found = kalman.filter_tracks(table, motion, chunk_frames).collect()
    for track in ("long", "one", "two", "same"):
        expected = recursion([r for r in rows if r[0] == track], motion)
        own = sorted(((r.frame_id, r.x, r.vx, r.y, r.vy, r.var_place, r.var_velocity) for r in found if r.track_id == track))
        wanted = sorted((e[0], e[1], e[2], e[3], e[4], e[5], e[7]) for e in expected)
        assert len(own) == len(wanted)
        for a, b in zip(own, wanted):
            assert a == pytest.approx(b, abs=1e-9)
    assert len(found) == len(rows)


@pytest.mark.parametrize("chunk_frames, part_rows", [(64, 50), (1, 1), (7, 20), (4096, 2000)])
def test_parts_equal_the_recursion(spark, chunk_frames, part_rows):
    """Parts over several Arrow batches, several parts in one, frames beyond 2^53."""
    rng, motion = random.Random(8), kalman.Motion(0.5, 0.03, 4.0)
    rows = []
    for track, base, count in (("a", 0, 400), ("b", 2**55 + 1, 150), ("c", 7, 12), ("d", -900, 1)):
        at = base
        for i in range(count):
            at += rng.choice([0, 1, 1, 2, 40, 300])
            rows.append((track, at, 0.3 * i + rng.gauss(0, 1), rng.gauss(0, 3)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        table = spark.createDataFrame(rows, OBSERVED).repartition(5)
        found = kalman.filter_tracks(table, motion, chunk_frames, part_rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for track in "abcd":
        expected = recursion([r for r in rows if r[0] == track], motion)
        own = sorted(tuple(r)[1:] for r in found if r.track_id == track)
        wanted = sorted((e[0], e[1], e[3], e[2], e[4], e[5], e[7]) for e in expected)
        assert [o[0] for o in own] == [w[0] for w in wanted]
        assert np.allclose([o[1:] for o in own], [w[1:] for w in wanted], rtol=0, atol=1e-8)


def test_only_long_tracks_are_cut(spark):
    """Observations far apart lie in a chunk each; they are one part all the same."""
    rows = spark.range(6000).selectExpr("id % 300 AS track_id", "id * 5000 AS frame_id", "id DIV 4 AS chunk")
    assert kalman.long_tracks(rows, 20).isEmpty()
    long = spark.range(1000).selectExpr("-1L AS track_id", "id * 5000 AS frame_id", "id AS chunk")
    parts = kalman.long_tracks(rows.union(long), 300).orderBy("chunk").collect()
    assert [(r.track_id, r.part) for r in parts] == [(-1, i // 300) for i in range(1000)]
    assert {(r.part, r.before, r.next_part, r.last) for r in parts} == {
        (0, None, 1, 299 * 5000), (1, 299 * 5000, 2, 599 * 5000), (2, 599 * 5000, 3, 899 * 5000), (3, 899 * 5000, None, 999 * 5000),
    }


def test_stretches_of_groups_combine_at_once():
    rng, motion = np.random.default_rng(3), kalman.Motion()
    group = np.repeat([2, 5, 6, 9], [1, 7, 4, 2])
    parts = kalman.single(rng.integers(1, 5, len(group)), rng.normal(size=(len(group), 2)), motion)
    found = kalman.reduce_groups(parts, group)
    for k, number in enumerate(np.unique(group)):
        alone = kalman.reduce_all(tuple(p[group == number] for p in parts))
        assert all(np.allclose(a, b[k : k + 1], atol=1e-12) for a, b in zip(alone, found))


def test_stretches_combine_in_any_order():
    rng, motion = np.random.default_rng(1), kalman.Motion()
    parts = kalman.single(rng.integers(1, 5, 9), rng.normal(size=(9, 2)), motion)
    one = [tuple(p[i : i + 1] for p in parts) for i in range(9)]
    left = one[0]
    for other in one[1:]:
        left = kalman.combine(left, other)
    for a, b in zip(left, kalman.reduce_all(parts)):
        assert np.allclose(a, b, atol=1e-12)


def test_no_observations(spark):
    assert kalman.filter_tracks(spark.createDataFrame([], OBSERVED)).count() == 0
