from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from rasterlark.llm import mixing

ROW = "doc_id long, domain string, lang string, source string, n_tokens long, copies string, cut string"


def fill(budget, nodes):
    """Shares by weight; full ones leave the rest to the others."""
    budget = min(budget, sum(c for _, c, _ in nodes))
    given, todo = {}, sorted(nodes, key=lambda n: (n[1] / n[2], n[0] or ""))
    weights = sum(w for _, _, w in nodes)
    while todo and todo[0][1] * weights <= budget * todo[0][2]:
        name, room, weight = todo.pop(0)
        given[name] = room
        budget, weights = budget - room, weights - weight
    return given | {name: min(room, budget * w // weights) for name, room, w in todo}


def brute(rows, weights, budget, epochs, seed):
    out = {}

    def down(rows, depth, budget):
        if depth == 3:
            tokens = sum(r[4] for r in rows)
            whole, room = divmod(budget, tokens) if tokens else (0, 0)
            by_key = defaultdict(list)
            for r in rows:
                key = f"{seed}:{whole}:{'' if r[0] is None else r[0]}"
                by_key[hashlib.md5(key.encode()).hexdigest()].append(r)
            used = 0
            for key in sorted(by_key):
                used += sum(r[4] for r in by_key[key])
                for r in by_key[key]:
                    copies = whole + (room > 0 and used <= room)
                    if copies:
                        out[r] = copies
            return
        groups = defaultdict(list)
        for r in rows:
            groups[r[1 + depth]].append(r)
        level = weights.get(mixing.LEVELS[depth], {})
        nodes = [
            (name, epochs * sum(r[4] for r in g), level.get(name, 1)) for name, g in groups.items()
        ]
        for name, part in fill(budget, nodes).items():
            down(groups[name], depth + 1, part)

    if rows:
        down(rows, 0, budget)
    return out


def run(spark, rows, weights, budget, epochs, seed=3):
    frame = spark.createDataFrame([(*r, None, None) for r in rows], ROW).repartition(3)
    frame = frame.drop("copies", "cut")
    leaves = mixing.plan(frame, weights, budget, epochs=epochs, seed=seed)
    return mixing.take(frame, leaves, seed=seed).collect()


def table(n):
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, "web" if hot or i % 2 else None, ["en", "de", None][i % 3], f"s{i % 7 if not hot else 0}", 5 + i * 37 % 90))
    return rows


@pytest.mark.parametrize("budget", [0, 1, 500, 3000, 9000, 10**9])
@pytest.mark.parametrize("epochs", [1, 3])
def test_plan_is_the_tree_by_hand(spark, monkeypatch, budget, epochs):
    monkeypatch.setattr(mixing, "BUCKET_DOCUMENTS", 4)
    rows = table(150)
    weights = {"domain": {"web": 3}, "lang": {"en": 2}, "source": {"s0": 4}}
    found = {tuple(r)[:5]: r.copies for r in run(spark, rows, weights, budget, epochs)}
    assert found == brute(rows, weights, budget, epochs, 3)


def test_siblings_come_before_ancestors(spark):
    rows = [(i, "a", "en", "small", 10) for i in range(3)]
    rows += [(10 + i, "a", "en", "large", 10) for i in range(50)]
    rows += [(100 + i, "b", "en", "other", 10) for i in range(50)]
    taken = defaultdict(int)
    for r in run(spark, rows, None, 400, 1):
        taken[r.source] += r.n_tokens
    # small lacks 70 of its 100; large, its sibling, gets them, other gets none.
    assert taken == {"small": 30, "large": 170, "other": 200}


def test_awkward_rows(spark):
    rows = [(1, None, None, None, 0), (2, "a", "en", "s", 0), (None, "a", "en", "s", 7)]
    found = run(spark, rows + [rows[2]], None, 14, 2)
    # The whole leaf is one epoch, its document without words included.
    assert sorted((r.doc_id or 0, r.copies) for r in found) == [(0, 1), (0, 1), (2, 1)]
    assert run(spark, [], None, 10, 2) == []
    with pytest.raises(ValueError):
        run(spark, rows, {"lang": {"en": 0}}, 5, 1)


def test_many_leaves_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 0)
    rows = table(60)
    found = {tuple(r)[:5]: r.copies for r in run(spark, rows, None, 900, 2)}
    assert found == brute(rows, {}, 900, 2, 3)
