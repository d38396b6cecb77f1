"""What boxes cover: points inside them, overlaps of each other, suppression.

Candidates come from the tile index, exact tests follow on the candidates.
Everything is column expressions; only the last, small part of suppression runs
in Python.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlark.operators.tiles import (
    BOX,
    BROADCAST_ROWS,
    HOT_ROWS,
    TILE,
    split_hot,
    tile_of,
    tiles_of,
    used_levels,
    with_bounds,
)
from rasterlark.sinks.scratch import scratch_directory

PAIR_LEVEL = 2  # tiles of 4 m for pairs of boxes
LEAST_AREA = 1e-9  # square metres; smaller overlaps are touching edges
FRAME_EDGES = 50_000  # of a frame's overlap graph that one task settles
CENTRE = ("cx", "cy", "cos_yaw", "sin_yaw", "half_length", "half_width")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the scratch folder and reread: lineage ends there."""
    path = scratch_directory(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _centred(boxes: DataFrame) -> DataFrame:
    """Adds the numbers of CENTRE to boxes with bounds."""
    return boxes.withColumns(
        {
            "cx": F.col("x").cast("double"),
            "cy": F.col("y").cast("double"),
            "cos_yaw": F.cos(F.col("yaw").cast("double")),
            "sin_yaw": F.sin(F.col("yaw").cast("double")),
            "half_length": F.col("length").cast("double") / 2,
            "half_width": F.col("width").cast("double") / 2,
        }
    )


# -- points inside boxes ---------------------------------------------------------


def remove_inside(
    points: DataFrame,
    boxes: DataFrame,
    margin: float = 0.0,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The points (frame_id, x, y, ..) that lie in no box of their frame, seen
    from above. `margin` metres more on each side belong to a box.

    A point on an edge is inside. Points with a null or NaN coordinate or
    without frame are in no box and stay, repeated points too. A small index of
    boxes is broadcast and the points are not exchanged; a larger one is joined
    by frame and tile, hot tiles in parts.
    """
    bounded = _centred(with_bounds(boxes, margin=margin))
    index = tiles_of(bounded).select(
        F.col("frame_id").alias("b_frame"),
        *(F.col(c).alias(f"b_{c}") for c in (*TILE, *CENTRE)),
    )
    levels = used_levels(bounded)
    small = index.count() <= broadcast_rows
    inside = F.expr(
        f"abs((p_x - b_cx) * b_cos_yaw + (p_y - b_cy) * b_sin_yaw) <= b_half_length + {margin!r}D "
        f"AND abs((p_y - b_cy) * b_cos_yaw - (p_x - b_cx) * b_sin_yaw) <= b_half_width + {margin!r}D"
    )
    names = points.columns
    for level in levels:
        placed = points.withColumns(
            {"p_x": F.col("x").cast("double"), "p_y": F.col("y").cast("double")}
        ).withColumns(
            {
                "p_frame": F.col("frame_id"),
                "p_tile_x": tile_of("p_x", F.lit(level)),
                "p_tile_y": tile_of("p_y", F.lit(level)),
            }
        )
        of_level = index.where(F.col("b_level") == level)
        on = (
            (F.col("p_frame") == F.col("b_frame"))
            & (F.col("p_tile_x") == F.col("b_tile_x"))
            & (F.col("p_tile_y") == F.col("b_tile_y"))
        )
        if small:
            placed = placed.join(F.broadcast(of_level), on & inside, "left_anti")
        else:
            keys = ["p_frame", "p_tile_x", "p_tile_y"]
            renamed = of_level.withColumnsRenamed(
                {k.replace("p_", "b_"): k for k in keys}
            ).drop("b_level")
            placed, copies = split_hot(placed, renamed, keys, F.struct("p_x", "p_y"), hot_rows)
            copies = copies.withColumnsRenamed({k: f"c_{k}" for k in [*keys, "part"]})
            on = F.lit(True)
            for key in [*keys, "part"]:
                on &= F.col(key) == F.col(f"c_{key}")
            placed = placed.join(copies, on & inside, "left_anti")
        points = placed.select(*names)
    return points


# -- overlaps -------------------------------------------------------------------


def box_pairs(
    boxes: DataFrame,
    base: int = PAIR_LEVEL,
    hot_rows: int = HOT_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of boxes of a frame whose bounding rectangles share a tile, each
    once: frame_id, a and b (id, CENTRE and the columns `carry`), the smaller id
    first.

    A pair is found at the higher of the two levels and in the one tile that is
    the lowest of both boxes along each axis. A box's id is its own in its
    frame; rows of one id make no pair.
    """
    bounded = _centred(with_bounds(boxes.select("frame_id", "id", *BOX, *carry), base))
    levels = used_levels(bounded)
    tiles = tiles_of(bounded, levels or [base]).where("frame_id IS NOT NULL AND id IS NOT NULL")
    side = tiles.select(
        "frame_id",
        *TILE,
        F.struct("id", *CENTRE, *carry).alias("box"),
        F.struct("own_level", "first_x", "first_y").alias("at"),
    )
    keys = ["frame_id", *TILE]
    left, right = split_hot(side, side, keys, F.col("box.id"), hot_rows)
    left = left.withColumnsRenamed({"box": "a", "at": "at_a"})
    right = right.withColumnsRenamed({"box": "b", "at": "at_b"})
    pairs = left.join(right, [*keys, "part"]).where(
        "a.id < b.id AND level = greatest(at_a.own_level, at_b.own_level) "
        "AND tile_x = greatest(at_a.first_x, at_b.first_x) "
        "AND tile_y = greatest(at_a.first_y, at_b.first_y)"
    )
    return pairs.select("frame_id", "a", "b")


def _once(rows: DataFrame, keep: list[str], **values: str) -> DataFrame:
    """The columns `keep` and values, which are worked out once: as an array of one
    element, out of which Spark does not copy them into later filters."""
    made = ", ".join(f"{value} AS {name}" for name, value in values.items())
    return rows.selectExpr(*keep, f"inline_outer(array(struct({made})))")


def with_intersection(pairs: DataFrame) -> DataFrame:
    """Adds `intersection`, the common area of the boxes a and b.

    b is seen from a, whose sides are then the lines x = +-h and y = +-w. Along
    each edge of b the height, cut off at +-w, is summed over the part of the
    edge between x = -h and x = h; forward edges add and backward ones take
    away, which leaves the area of b within a. Every step is a continuous
    function of the boxes, so nothing jumps where edges touch or coincide.
    """
    keep = pairs.columns
    seen = _once(
        pairs,
        keep,
        h="a.half_length",
        w="a.half_width",
        ox="a.cos_yaw * (b.cx - a.cx) + a.sin_yaw * (b.cy - a.cy)",
        oy="a.cos_yaw * (b.cy - a.cy) - a.sin_yaw * (b.cx - a.cx)",
        c="a.cos_yaw * b.cos_yaw + a.sin_yaw * b.sin_yaw",
        s="a.cos_yaw * b.sin_yaw - a.sin_yaw * b.cos_yaw",
    )
    signs = ((1, 1), (-1, 1), (-1, -1), (1, -1))  # counter-clockwise
    places: dict[str, str] = {}
    for k, (i, j) in enumerate(signs):
        places[f"x{k}"] = f"ox + {i}D * c * b.half_length - {j}D * s * b.half_width"
        places[f"y{k}"] = f"oy + {i}D * s * b.half_length + {j}D * c * b.half_width"
    corners = _once(seen, [*keep, "h", "w"], **places)
    edges = ", ".join(
        f"struct(x{k} AS x, y{k} AS y, x{n} - x{k} AS dx, y{n} - y{k} AS dy)"
        for k, n in ((0, 1), (1, 2), (2, 3), (3, 0))
    )

    def clamped(value: str, low: str, high: str) -> str:
        return f"greatest({low}, least({high}, {value}))"

    def share(part: str, whole: str) -> str:
        return clamped(f"coalesce(({part}) / nullif({whole}, 0D), 0D)", "0D", "1D")

    # Arrays of four edges, each stage from the one before: nothing is written
    # out four times in generated code.
    start, end = clamped("e.x", "-h", "h"), clamped("e.x + e.dx", "-h", "h")
    stages = (
        f"struct({start} - {end} AS back, e.y + e.dy * {share(f'{start} - e.x', 'e.dx')} AS p, "
        f"e.y + e.dy * {share(f'{end} - e.x', 'e.dx')} AS q)",
        "struct(e.back AS back, least(e.p, e.q) AS low, greatest(e.p, e.q) AS high)",
        f"struct(e.back AS back, {share('-w - e.low', 'e.high - e.low')} AS under, "
        f"{share('e.high - w', 'e.high - e.low')} AS over, "
        f"({clamped('e.low', '-w', 'w')} + {clamped('e.high', '-w', 'w')}) / 2 AS middle)",
    )
    turned = f"array({edges})"
    for stage in stages:
        turned = f"transform({turned}, e -> {stage})"
    area = (
        f"aggregate({turned}, 0D, (total, e) -> "
        "total + e.back * (w * (e.over - e.under) + (1D - e.under - e.over) * e.middle))"
    )
    return _once(corners, keep, intersection=f"greatest(0D, {area})")


def _overlapping(pairs: DataFrame, least_iou: float) -> DataFrame:
    """The pairs that overlap, with intersection and iou."""
    found = with_intersection(pairs).where(F.col("intersection") > LEAST_AREA)
    areas = "4 * (a.half_length * a.half_width + b.half_length * b.half_width)"
    iou = F.expr(f"intersection / ({areas} - intersection)")
    return found.withColumn("iou", iou).where(F.col("iou") > least_iou)


def box_overlaps(
    boxes: DataFrame, least_iou: float = 0.0, base: int = PAIR_LEVEL, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(frame_id, id_a, id_b, intersection, iou) of the boxes of a frame that
    overlap by more than LEAST_AREA and have an intersection over union above
    `least_iou`; id_a < id_b. Boxes without area overlap nothing."""
    found = _overlapping(box_pairs(boxes, base, hot_rows), least_iou)
    return found.selectExpr("frame_id", "a.id AS id_a", "b.id AS id_b", "intersection", "iou")


# -- suppression ----------------------------------------------------------------


def _settle(edges: pd.DataFrame) -> set[int]:
    """Boxes that fall, of (better, worse) pairs: from the best on, a box that
    has not fallen takes down those worse ones."""
    worse, waiting = defaultdict(list), defaultdict(int)
    for a, b in zip(edges["better"].tolist(), edges["worse"].tolist()):
        worse[a].append(b)
        waiting[b] += 1
    ready = [a for a in worse if not waiting[a]]
    fallen: set[int] = set()
    heapq.heapify(ready)
    while ready:
        a = heapq.heappop(ready)
        for b in worse.get(a, ()):
            if a not in fallen:
                fallen.add(b)
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    return fallen


def suppressed(edges: DataFrame, frame_edges: int = FRAME_EDGES) -> DataFrame:
    """(frame_id, id) of the boxes that fall, of edges (frame_id, better, worse)
    without cycles.

    Frames with few edges are settled each in a task. In the others a round
    takes the boxes without a better neighbour, which stay; their neighbours
    fall, and all edges of those go. A round needs no frame in one place, and a
    frame that has become small is settled as the others.
    """
    kind = edges.schema["frame_id"].dataType.simpleString()

    def in_task(rows: pd.DataFrame) -> pd.DataFrame:
        fallen = sorted(_settle(rows))
        frame = rows["frame_id"].iloc[0]
        return pd.DataFrame({"frame_id": [frame] * len(fallen), "id": fallen})

    result, left = [], edges
    while True:
        # Each round's edges are written once and its joins read them thrice.
        left = stored(left, "overlap-edges")
        large = left.groupBy("frame_id").count().where(F.col("count") > frame_edges)
        large = stored(large.select("frame_id"), "large-frames")
        held = large.count()
        few = F.broadcast(large) if held <= BROADCAST_ROWS else large
        small = left.join(few, "frame_id", "left_anti") if held else left
        result.append(
            small.select("frame_id", "better", "worse")
            .groupBy("frame_id")
            .applyInPandas(in_task, f"frame_id {kind}, id long")
        )
        if not held:
            break
        left = left.join(few, "frame_id", "left_semi")
        beaten = left.select("frame_id", F.col("worse").alias("better")).distinct()
        falls = left.join(beaten, ["frame_id", "better"], "left_anti").select("frame_id", "worse")
        falls = stored(falls.distinct(), "fallen-boxes")
        result.append(falls.select("frame_id", F.col("worse").alias("id")))
        left = left.join(falls, ["frame_id", "worse"], "left_anti").join(
            falls.withColumnRenamed("worse", "better"), ["frame_id", "better"], "left_anti"
        )
    fallen = result[0]
    for more in result[1:]:
        fallen = fallen.unionByName(more)
    return fallen


def suppress(
    boxes: DataFrame,
    score: str = "score",
    least_iou: float = 0.5,
    by_class: bool = True,
    frame_edges: int = FRAME_EDGES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Non-maximum suppression: of the boxes of a frame, and of a class unless
    `by_class` is false, those that no better kept box overlaps by more than
    `least_iou`. Better is the higher score, then the smaller id; a null or NaN
    score is the lowest. Null is a class. All columns are kept."""
    rank = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    ranked = boxes.withColumns(
        {"rank": F.coalesce(rank, F.lit(float("-inf"))), "kind": F.col("class_name")}
    )
    pairs = box_pairs(ranked, hot_rows=hot_rows, carry=("rank", "kind"))
    if by_class:
        pairs = pairs.where("a.kind <=> b.kind")
    ahead = F.col("a.rank") >= F.col("b.rank")  # a has the smaller id
    edges = _overlapping(pairs, least_iou).select(
        "frame_id",
        F.when(ahead, F.col("a.id")).otherwise(F.col("b.id")).cast("long").alias("better"),
        F.when(ahead, F.col("b.id")).otherwise(F.col("a.id")).cast("long").alias("worse"),
    )
    fallen = suppressed(edges, frame_edges)
    return boxes.join(fallen, ["frame_id", "id"], "left_anti").select(*boxes.columns)
