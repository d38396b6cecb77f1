"""Assignment of detections: minimum-cost matching of gated pairs.

Pairs farther apart than the gate are forbidden, so the pair graph of a frame
falls into components, and each is matched for itself. A frame with few pairs is
one group; in larger ones the components are found first, by labels passed along
pairs and shortened, and become the groups.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.operators.overlap import stored
from rasterlark.operators.tiles import BROADCAST_ROWS, HOT_ROWS, SLACK, split_hot

FRAME_PAIRS = 50_000  # of a frame that are one group
COST_UNITS = 1_000_000  # costs are compared in millionths

Pair = tuple[int, int, int]  # left, right, cost


def gated_pairs(
    left: DataFrame, right: DataFrame, radius: float, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(frame_id, left_id, right_id, cost): pairs of a frame at most `radius`
    apart, from (frame_id, id, x, y) on both sides; cost is the distance. Rows
    with a null or NaN coordinate, frame or id have no pairs."""
    if not radius > 0:
        raise ValueError("the gate must be positive")
    edge = 2 * radius

    def located(rows: DataFrame, side: str) -> DataFrame:
        known = rows.where("frame_id IS NOT NULL AND id IS NOT NULL")
        known = known.where("abs(x) < double('infinity') AND abs(y) < double('infinity')")
        return known.select(
            "frame_id",
            F.col("id").cast("long").alias(f"{side}_id"),
            F.col("x").cast("double").alias(f"{side}_x"),
            F.col("y").cast("double").alias(f"{side}_y"),
        )

    near = located(left, "left")
    for axis in "xy":
        reach = F.lit(radius) + SLACK * (F.abs(f"left_{axis}") + radius)
        tiles = F.array(
            F.floor((F.col(f"left_{axis}") - reach) / edge),
            F.floor((F.col(f"left_{axis}") + reach) / edge),
        )
        low, high = tiles[0], tiles[1]
        # At most three: the reach is a little more than half an edge.
        near = near.withColumn(f"tile_{axis}", F.explode(F.sequence(low, high)))
    there = located(right, "right").withColumns(
        {f"tile_{a}": F.floor(F.col(f"right_{a}") / edge) for a in "xy"}
    )
    keys = ["frame_id", "tile_x", "tile_y"]
    there, near = split_hot(there, near, keys, F.col("right_id"), hot_rows)
    distance = F.sqrt(
        (F.col("left_x") - F.col("right_x")) * (F.col("left_x") - F.col("right_x"))
        + (F.col("left_y") - F.col("right_y")) * (F.col("left_y") - F.col("right_y"))
    )
    return (
        near.join(there, [*keys, "part"])
        .withColumn("cost", distance)
        .where(F.col("cost") <= radius)
        .select("frame_id", "left_id", "right_id", "cost")
    )


# -- one group --------------------------------------------------------------------


def assign(pairs: list[Pair]) -> list[Pair]:
    """As many pairs as can be matched, at the least total cost; of equal ones
    that whose list of right partners, by left id, comes first, a left one
    without partner counting as last. Costs are whole numbers.

    Shortest augmenting paths with potentials. Ties are settled by the costs
    themselves: below each cost stands the place of the right one as a digit of
    a number whose digits are the left ones.
    """
    best: dict[tuple[int, int], int] = {}
    for left, right, cost in pairs:
        best[left, right] = min(cost, best.get((left, right), cost))
    lefts = sorted({left for left, _ in best})
    rights = sorted({right for _, right in best})
    place = {right: i for i, right in enumerate(rights)}
    base, least = len(rights) + 1, min(best.values(), default=0)
    unit = {left: base ** (len(lefts) - 1 - i) for i, left in enumerate(lefts)}
    shift = (base ** len(lefts) * (len(lefts) + 1)).bit_length()
    full = (base - 1) * base ** max(0, len(lefts) - 1)
    costs: dict[int, dict[int, int]] = defaultdict(dict)
    for (left, right), cost in best.items():
        behind = full - (base - 1 - place[right]) * unit[left]
        costs[left][right] = ((cost - least) << shift) + behind
    partner: dict[int, int] = {}  # of a right one
    taken: dict[int, int] = {}  # by a left one
    high_left, high_right = dict.fromkeys(lefts, 0), dict.fromkeys(rights, 0)
    while True:
        free = [left for left in lefts if left not in taken]
        way_left, way_right = dict.fromkeys(free, 0), {}
        came: dict[int, int] = {}
        heap = [(0, left) for left in free]
        done = set()
        while heap:
            way, left = heapq.heappop(heap)
            if left in done:
                continue
            done.add(left)
            for right, cost in costs[left].items():
                if taken.get(left) == right:
                    continue
                there = way + cost + high_left[left] - high_right[right]
                if right not in way_right or there < way_right[right]:
                    way_right[right], came[right] = there, left
                    back = partner.get(right)
                    if back is not None and (back not in way_left or there < way_left[back]):
                        way_left[back] = there  # matched pairs have no reduced cost
                        heapq.heappush(heap, (there, back))
        ends = [(way_right[r] + high_right[r], r) for r in way_right if r not in partner]
        if not ends:
            break
        for left, way in way_left.items():
            high_left[left] += way
        for right, way in way_right.items():
            high_right[right] += way
        right = min(ends)[1]
        while True:
            left = came[right]
            before = taken.get(left)
            partner[right], taken[left] = left, right
            if before is None:
                break
            right = before
    return sorted((left, right, best[left, right]) for left, right in taken.items())


def _parts(pairs: list[Pair]) -> list[list[Pair]]:
    """The connected components of the pairs."""
    above: dict[tuple[int, int], tuple[int, int]] = {}

    def top(node: tuple[int, int]) -> tuple[int, int]:
        while above.setdefault(node, node) != node:
            above[node] = above[above[node]]
            node = above[node]
        return node

    for left, right, _ in pairs:
        above[top((0, left))] = top((1, right))
    held = defaultdict(list)
    for pair in pairs:
        held[top((0, pair[0]))].append(pair)
    return list(held.values())


# -- all frames -------------------------------------------------------------------


def components(pairs: DataFrame) -> DataFrame:
    """(frame_id, left_id, component): the smallest left id that a left one is
    connected with. A round passes the smallest label to all neighbours and
    then follows it to the label of its owner, so long chains shrink fast."""
    pairs = pairs.select("frame_id", "left_id", "right_id").distinct()
    labels = pairs.select("frame_id", "left_id").distinct().withColumn("label", F.col("left_id"))
    labels = stored(labels, "matching-labels")
    while True:
        across = pairs.join(labels, ["frame_id", "left_id"])
        least = across.groupBy("frame_id", "right_id").agg(F.min("label").alias("label"))
        back = pairs.join(least, ["frame_id", "right_id"])
        passed = back.groupBy("frame_id", "left_id").agg(F.min("label").alias("new"))
        owners = labels.select("frame_id", F.col("left_id").alias("new"), F.col("label").alias("far"))
        moved = (
            labels.join(passed, ["frame_id", "left_id"])
            .join(owners, ["frame_id", "new"])
            .select(
                "frame_id",
                "left_id",
                F.least("new", "far").alias("label"),
                (F.least("new", "far") < F.col("label")).alias("moved"),
            )
        )
        moved = stored(moved, "matching-labels")
        labels = moved.drop("moved")
        if not moved.where("moved").take(1):
            return labels.withColumnRenamed("label", "component")


def match(pairs: DataFrame, frame_pairs: int = FRAME_PAIRS) -> DataFrame:
    """(frame_id, left_id, right_id, cost) of the matched ones among the pairs
    (frame_id, left_id, right_id, cost).

    In each frame as many are matched as the pairs allow, at the least total
    cost in millionths; ties go to the smaller right ids by left id. Of repeated
    pairs the cheapest counts; pairs with a null or NaN go.
    """
    kind = pairs.schema["frame_id"].dataType.simpleString()
    known = pairs.where("frame_id IS NOT NULL AND left_id IS NOT NULL AND right_id IS NOT NULL")
    known = stored(known.where("abs(cost) < double('infinity')"), "gated-pairs")
    large = known.groupBy("frame_id").count().where(F.col("count") > frame_pairs)
    large = stored(large.select("frame_id"), "large-frames")
    grouped = known.withColumn("component", F.lit(None).cast("long"))
    if held := large.count():
        few = F.broadcast(large) if held <= BROADCAST_ROWS else large
        inner = known.join(few, "frame_id", "left_semi")
        split = inner.join(components(inner), ["frame_id", "left_id"])
        rest = grouped.join(few, "frame_id", "left_anti")
        grouped = rest.unionByName(split.select(*rest.columns))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        costs = (rows["cost"] * COST_UNITS).round().astype("int64")
        listed = list(zip(rows["left_id"].tolist(), rows["right_id"].tolist(), costs.tolist()))
        found = [pair for part in _parts(listed) for pair in assign(part)]
        return pd.DataFrame(
            {
                "frame_id": [rows["frame_id"].iloc[0]] * len(found),
                "left_id": [left for left, _, _ in found],
                "right_id": [right for _, right, _ in found],
                "cost": [cost / COST_UNITS for _, _, cost in found],
            }
        )

    schema = f"frame_id {kind}, left_id long, right_id long, cost double"
    return grouped.groupBy("frame_id", "component").applyInPandas(solve, schema)
