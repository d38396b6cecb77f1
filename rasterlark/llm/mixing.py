"""Mixing of sources to target weights under a token budget.

Weights form a tree of domains, languages and sources. The budget flows down it:
siblings share their parent's part by weight, a node gets at most what its
documents hold in the allowed epochs, and what it leaves goes to its siblings;
only what a whole family cannot take is left to the parent's siblings. A leaf
takes whole epochs of its documents and of the next epoch, in that epoch's
seeded order, the longest prefix that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.llm.common import stored

LEVELS = ("domain", "lang", "source")
LEAF_ROWS = 50_000  # up to so many leaves their table is broadcast
BUCKET_DOCUMENTS = 1000  # of a leaf, whose order is looked at together
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"leaf_{name}"])
    return condition


def allocate(leaves: DataFrame, budget: int, epochs: int) -> DataFrame:
    """Adds `budget`, in tokens, to leaves (domain, lang, source, tokens, weight
    of each level: domain_weight, lang_weight, source_weight).

    Among siblings in rising order of capacity per weight, one is full if its
    capacity is at most its share of what the fuller ones leave; the others
    share the rest by weight, rounded down. Sums are decimals of 38 digits.
    """
    whole = "DECIMAL(38,0)"
    nodes = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast(whole))
    total = Window.partitionBy(F.lit(1))
    nodes = nodes.withColumn(
        "given", F.least(F.lit(budget).cast(whole), F.sum("capacity").over(total).cast(whole))
    )
    for depth, level in enumerate(LEVELS):
        parent = LEVELS[:depth]
        heads = nodes.groupBy(*parent, level).agg(
            F.first("given").alias("given"),
            F.sum("capacity").cast(whole).alias("room"),
            F.max(f"{level}_weight").cast(whole).alias("weight"),
        )
        family = Window.partitionBy(*(parent or [F.lit(1)]))
        ranked = heads.withColumn(
            "nth",
            F.row_number().over(
                family.orderBy(F.col("room").cast("double") / F.col("weight"), F.col(level).asc_nulls_first())
            ),
        )
        before = family.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
        after = family.orderBy("nth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        shared = ranked.withColumn(
            "left_over",
            (F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0))).cast(whole),
        ).withColumn("weights", F.sum("weight").over(after).cast(whole))
        full = F.expr("room * weights <= left_over * weight")
        # The first that is not full fixes the level of all behind it.
        shared = shared.withColumn("full", full).withColumn(
            "at", F.min(F.when(~F.col("full"), F.col("nth"))).over(family)
        )
        level_left = F.max(F.when(F.col("nth") == F.col("at"), F.col("left_over"))).over(family)
        level_weights = F.max(F.when(F.col("nth") == F.col("at"), F.col("weights"))).over(family)
        shared = shared.withColumn("l", level_left).withColumn("w", level_weights)
        given = F.expr(
            "CASE WHEN at IS NULL OR nth < at THEN room "
            "ELSE CAST(least(room, CAST(l * weight div w AS DECIMAL(38,0))) AS DECIMAL(38,0)) END"
        )
        names = (*parent, level)
        part = shared.select(
            *(F.col(n).alias(f"leaf_{n}") for n in names), given.cast(whole).alias("part")
        )
        nodes = nodes.drop("given").join(part, same(nodes, part, names)).drop(
            *(f"leaf_{n}" for n in names)
        )
        nodes = nodes.withColumnRenamed("part", "given")
    return nodes.select(*LEVELS, "tokens", F.col("given").cast("long").alias("budget"))


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in an epoch, as text."""
    return F.md5(
        F.concat(
            F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))
        )
    )


def plan(
    documents: DataFrame,
    weights: dict[str, dict[str, int]] | None = None,
    budget: int | None = None,
    share: float = 1.0,
    epochs: int = 1,
    seed: int = 0,
) -> DataFrame:
    """One row per leaf: leaf_domain, leaf_lang, leaf_source, tokens, budget,
    full_epochs and cut, the last order key taken of the next epoch or null.

    Takes doc_id, domain, lang, source and n_tokens. `weights` maps a level to
    weights of its names, positive integers, 1 if missing; null is a name of its
    own. `budget` is in tokens, by default `share` of all. A document of the next
    epoch is taken if it and all before it fit; documents of one doc_id stand at
    one place and are taken together.
    """
    weights = weights or {}
    for level, names in weights.items():
        if level not in LEVELS or any(w < 1 for w in names.values()):
            raise ValueError("weights are positive and belong to domain, lang or source")
    rows = documents.select(
        "doc_id", *(F.col(c).cast("string").alias(c) for c in LEVELS), "n_tokens"
    )
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")), "mix-leaves")
    totals = leaves.agg(F.sum("tokens"), F.max("documents"), F.count("*")).first()
    total, largest, count = (int(x or 0) for x in totals)
    if budget is None:
        budget = int(total * share)
    weighed = leaves
    for level in LEVELS:
        weight = F.lit(1)
        for name, value in weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, value).otherwise(weight)
        weighed = weighed.withColumn(f"{level}_weight", weight.cast("long"))
    given = allocate(weighed, budget, epochs).select(
        *(F.col(c).alias(f"leaf_{c}") for c in LEVELS),
        "tokens",
        "budget",
        F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0L END").alias("full_epochs"),
        F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0L END").alias("room"),
    )
    given = stored(given, "mix-budgets")
    small = F.broadcast(given) if count <= LEAF_ROWS else given
    keyed = rows.join(small, same(rows, small, LEVELS)).where("room > 0").select(
        *(f"leaf_{c}" for c in LEVELS),
        "room",
        "n_tokens",
        order_key(F.col("doc_id"), F.col("full_epochs"), seed).alias("key"),
    )
    # Buckets of the key's leading digits: only the bucket in which the prefix
    # ends is looked at document by document.
    digits = 1
    while 16**digits * BUCKET_DOCUMENTS < largest and digits < 8:
        digits += 1
    keyed = keyed.withColumn("bucket", F.substring("key", 1, digits))
    leaf = [f"leaf_{c}" for c in LEVELS]
    upto = Window.partitionBy(*leaf).orderBy("bucket")
    ends = (
        keyed.groupBy(*leaf, "room", "bucket")
        .agg(F.sum("n_tokens").alias("n"), F.max("key").alias("last"))
        .withColumn("upto", F.sum("n").over(upto))
    )
    # The last key of the buckets that fit, and the first bucket that does not.
    fits = F.col("upto") <= F.col("room")
    ends = stored(
        ends.groupBy(*leaf, "room").agg(
            F.max(F.when(fits, F.col("last"))).alias("last"),
            F.max(F.when(fits, F.col("upto"))).alias("used"),
            F.min(F.when(~fits, F.col("bucket"))).alias("open"),
        ),
        "mix-ends",
    )
    open_ = ends.select(
        *(F.col(c).alias(f"leaf_{c}") for c in leaf), "open", F.coalesce("used", F.lit(0)).alias("used")
    )
    if count <= LEAF_ROWS:
        open_ = F.broadcast(open_)
    inner = (
        keyed.join(open_, same(keyed, open_, tuple(leaf)) & (F.col("bucket") == F.col("open")))
        .groupBy(*leaf, "room", "used", "key")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("upto", F.col("used") + F.sum("n").over(upto_key(leaf)))
        .where("upto <= room")
        .groupBy(*leaf)
        .agg(F.max("key").alias("inner"))
    )
    inner = inner.select(*(F.col(c).alias(f"leaf_{c}") for c in leaf), "inner")
    cuts = ends.join(inner, same(ends, inner, tuple(leaf)), "left").select(
        *(F.col(c).alias(f"leaf_{c}") for c in leaf), F.greatest("last", "inner").alias("cut")
    )
    return stored(
        given.join(cuts, same(given, cuts, tuple(leaf)), "left").select(
            *leaf, "tokens", "budget", "full_epochs", "cut"
        ),
        "mix-plan",
    )


def upto_key(leaf: list[str]):
    return Window.partitionBy(*leaf).orderBy("key")


def take(documents: DataFrame, leaves: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of `documents` (with doc_id, domain, lang and source) that the plan
    takes, with `copies`, how many times. Nothing but the plan is exchanged."""
    table = leaves.select(*(f"leaf_{c}" for c in LEVELS), "full_epochs", "cut")
    if leaves.count() <= LEAF_ROWS:
        table = F.broadcast(table)
    key = order_key(F.col("doc_id"), F.col("full_epochs"), seed)
    copies = F.col("full_epochs") + F.coalesce((key <= F.col("cut")).cast("long"), F.lit(0))
    return (
        documents.join(table, same(documents, table, LEVELS))
        .withColumn("copies", copies)
        .where("copies > 0")
        .drop(*(f"leaf_{c}" for c in LEVELS), "full_epochs", "cut")
    )
