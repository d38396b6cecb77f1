"""A spatial index of oriented boxes: square tiles in levels.

The tiles of level n have edges of 2^n metres. A box belongs to the lowest level
(not below `base`) whose edge covers the extent of its bounding rectangle, so it
lies in at most two tiles along each axis, however large it is. What is looked
up beside a box carries its tile at each level in use, of which tables of
ordinary boxes have one or two. All lookups are equi-joins on frame and tile.

Hot tiles, those with more rows than a task should hold, are cut into parts by
a hash; the other side carries a copy for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_LEVEL = 3  # tiles of 8 m: most boxes are smaller
SMALLEST_LEVEL, HIGHEST_LEVEL = -20, 1024
BROADCAST_ROWS = 200_000  # of a box index, about 20 MB
HOT_ROWS = 20_000  # rows of a tile that one task looks at
MOST_PARTS = 1024  # of a hot tile

# Bounding rectangles grow by this share of their extent, more than rounding
# could move an edge.
SLACK = 1e-9

HALF_X = "(abs(cos(yaw)) * length + abs(sin(yaw)) * width) / 2"
HALF_Y = "(abs(sin(yaw)) * length + abs(cos(yaw)) * width) / 2"
BOX = ("x", "y", "length", "width", "yaw")
TILE = ("level", "tile_x", "tile_y")


def with_bounds(boxes: DataFrame, base: int = BASE_LEVEL, margin: float = 0.0) -> DataFrame:
    """Adds low_x, high_x, low_y, high_y of the bounding rectangle and own_level.
    Boxes with a null, NaN or infinite number or a negative size go: they
    contain nothing."""
    double = {c: F.col(c).cast("double") for c in BOX}
    finite = " AND ".join(f"abs({c}) < double('infinity')" for c in BOX)
    lowest = max(base, SMALLEST_LEVEL)
    return (
        boxes.withColumns(double)
        .where(f"{finite} AND length >= 0 AND width >= 0")
        .withColumns({"half_x": F.expr(f"{HALF_X} + {margin!r}D"), "half_y": F.expr(f"{HALF_Y} + {margin!r}D")})
        .withColumns(
            {
                "half_x": F.expr(f"half_x + {SLACK!r}D * (half_x + abs(x))"),
                "half_y": F.expr(f"half_y + {SLACK!r}D * (half_y + abs(y))"),
            }
        )
        .selectExpr(
            *boxes.columns,
            "x - half_x AS low_x",
            "x + half_x AS high_x",
            "y - half_y AS low_y",
            "y + half_y AS high_y",
            # A box without extent has no logarithm, which greatest skips; the
            # highest level is one tile for all numbers.
            f"int(least({HIGHEST_LEVEL}L, greatest({lowest}L, "
            f"ceil(log2(greatest(half_x, half_y) * {2 + SLACK!r}D))))) AS own_level",
        )
    )


def tile_of(place: str | Column, level: str | Column) -> Column:
    """Number of the tile a coordinate lies in; the largest or smallest BIGINT
    beyond the numbers."""
    place, level = (F.col(v) if isinstance(v, str) else v for v in (place, level))
    return F.floor(place / F.pow(F.lit(2.0), level))


def used_levels(bounded: DataFrame) -> list[int]:
    """Levels in use, at most some hundred numbers whatever the table."""
    return sorted(r.own_level for r in bounded.select("own_level").distinct().collect())


def tiles_of(bounded: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Adds level, tile_x, tile_y and first_x, first_y (the lowest tile of the
    box): a row for each tile a box meets at its own level, or at each of
    `levels` that is not below."""
    level = F.col("own_level")
    if levels is not None:
        upper = F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col("own_level"))
        level = F.explode(upper)
    at = bounded.withColumn("level", level).withColumns(
        {
            "first_x": tile_of("low_x", "level"),
            "first_y": tile_of("low_y", "level"),
            "last_x": tile_of("high_x", "level"),
            "last_y": tile_of("high_y", "level"),
        }
    )
    across = at.withColumn("tile_x", F.explode(F.array_distinct(F.array("first_x", "last_x"))))
    both = across.withColumn("tile_y", F.explode(F.array_distinct(F.array("first_y", "last_y"))))
    return both.drop("last_x", "last_y")


def split_hot(
    many: DataFrame, few: DataFrame, keys: list[str], identity: Column, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `keys`, with a key column `part`: the rows of
    `many` in a hot key are dealt over parts by the hash of `identity`, those of
    `few` are repeated for each part. Rows per key are counted first."""
    counts = many.groupBy(*keys).count().where(F.col("count") > hot_rows)
    wanted = F.least(F.ceil(F.col("count") / hot_rows), F.lit(MOST_PARTS))
    hot = counts.select(*keys, wanted.cast("int").alias("parts"))
    if not hot.take(1):
        return many.withColumn("part", F.lit(0)), few.withColumn("part", F.lit(0))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = many.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, keys, "left")
    copied = few.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, keys, "left")
    return (
        dealt.withColumn("part", F.pmod(F.xxhash64(identity), parts).cast("int")).drop("parts"),
        copied.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"),
    )
