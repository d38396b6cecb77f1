"""Quality rules: robust outliers among documents of one language and source.

Each document is a vector of transformed text statistics. For every group of
language and source, the minimum covariance determinant estimates centre and
scatter: from several starts, concentration steps take the half of the group
that is nearest to the current estimate, by Mahalanobis distance, and estimate
again until nothing changes; the start whose core has the smallest determinant
wins. Its estimate is made again from all documents that lie within it, and
drawn towards that of all documents the fewer documents the group has. Documents
too far from the final estimate are rejected. All of it is DataFrame
expressions; matrices are columns of the group table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlark.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STARTS = 4
STEPS = 8  # concentration steps at most; they end when nothing changes
PRIOR = 20  # weight, in documents, of the estimate of all documents
GROUP_ROWS = 50_000  # up to so many estimates are broadcast
INSIDE = 0.975  # share of a normal group that the second estimate rests on
REJECT = 0.999  # share of a normal group that is not rejected
#: Feature: expression over the counts, and the deviation that counts as noise.
#: The noise is added to the scatter, because in most groups hardly any central
#: document has a symbol or a repeated line; each feature alone can still reach
#: the cut. Length is no feature: a text is not worse for being long.
FEATURES = {
    "word_length": ("ln(word_chars / n_words)", 0.06),
    "symbols": ("ln(1 + 50 * n_symbols / word_chars)", 0.25),
    "dup_lines": ("ln(1 + n_dup_lines)", 0.5),
    "repeats": ("sqrt(n_repeat_words / n_words)", 0.12),
}
SIZE = len(FEATURES)
ALL = "*"  # name of the group of all documents


def chi_squared_below(x: float, terms: int) -> float:
    """Share of chi-squared with 2 * terms degrees of freedom below x."""
    total, term = 0.0, 1.0
    for k in range(terms):
        total += term
        term *= x / 2 / (k + 1)
    return 1.0 - math.exp(-x / 2) * total


def chi_squared_quantile(share: float, terms: int = SIZE // 2) -> float:
    low, high = 0.0, 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_below(middle, terms) < share else (low, middle)
    return low


def core_factor(share: float) -> float:
    """By how much the scatter of the nearest `share` of a normal sample in four
    dimensions falls short; chi-squared in closed form."""
    return share / chi_squared_below(chi_squared_quantile(share), SIZE // 2 + 1)


CUT = chi_squared_quantile(REJECT)  # squared distance beyond which a document is rejected


def text_statistics(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, `keep`, and counts over the whole text.

    Words are runs of characters other than space and \\t\\n\\v\\f\\r; a null text
    has none. n_repeat_words counts the words in three-word windows that occur
    twice or more in the text, the first included; n_dup_lines the lines with a
    word that equal an earlier line.
    """
    rows = documents.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        *keep,
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    split = rows.withColumn(
        "words", F.filter(F.split("text", SPACE), lambda w: w != "")
    ).withColumn("n_words", F.size("words").cast("long"))
    # Hashes of words, then of windows: a window of other words has the same
    # hash with a chance of 2**-64 for each pair of windows of one text.
    windows = split.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(1), F.col("n_words").cast("int") - 2),
                lambda i: F.xxhash64(
                    F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)
                ),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    counted = windows.select(
        "doc_id",
        "lang",
        "source",
        *keep,
        "n_words",
        "windows",
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(
            F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))
        ).otherwise(0).cast("long").alias("n_dup_lines"),
        (F.size("windows") > F.size(F.array_distinct("windows"))).alias("repeats"),
    )
    # Only texts with a repeated window are sorted.
    ordered = counted.withColumn(
        "ordered",
        F.when(
            F.col("repeats"),
            F.array_sort(
                F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
            ),
        ),
    )
    found = ordered.withColumn(
        "found",
        F.array_sort(
            F.transform(
                F.filter(
                    F.transform(
                        "ordered",
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            F.coalesce(
                                (x["w"] == F.get("ordered", k - 1)["w"])
                                | (x["w"] == F.get("ordered", k + 1)["w"]),
                                (x["w"] == F.get("ordered", k - 1)["w"]),
                                (x["w"] == F.get("ordered", k + 1)["w"]),
                                F.lit(False),
                            ).alias("again"),
                        ),
                    ),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "found", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("found", k + 1) - at, F.lit(3)))
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return found.select(
        "doc_id",
        "lang",
        "source",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
XS = [f"x{i}" for i in range(SIZE)]
MEANS = [f"m{i}" for i in range(SIZE)]
CELLS = [f"c{i}{j}" for i, j in PAIRS]


def distance_sql() -> str:
    """Squared Mahalanobis distance of x0.. from m0.. with the Cholesky factor
    l00, l10, l11, .. of the scatter, by forward substitution."""
    solved: list[str] = []
    for i in range(SIZE):
        rest = "".join(f" - l{i}{j} * {solved[j]}" for j in range(i))
        solved.append(f"((x{i} - m{i}{rest}) / l{i}{i})")
    return " + ".join(f"{y} * {y}" for y in solved)


def _factor(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of c00, c10, c11, .., a column at a time."""
    for j in range(SIZE):
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        estimates = estimates.withColumn(f"l{j}{j}", F.expr(f"sqrt(c{j}{j}{inner})"))
        for i in range(j + 1, SIZE):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            estimates = estimates.withColumn(f"l{i}{j}", F.expr(f"(c{i}{j}{inner}) / l{j}{j}"))
    return estimates


def _with_group(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    if groups <= GROUP_ROWS:
        estimates = F.broadcast(estimates)
    return rows.join(estimates, "group")


def _first_estimates(vectors: DataFrame, groups: int) -> DataFrame:
    """STARTS estimates a group: the medians with the noise for scatter, the
    medians with the spread between the quartiles, and two documents, those with
    the least keys, with the noise. Ranks come from counts of values to a quarter
    of the noise."""
    long = vectors.select(
        "group",
        F.posexplode(F.array(*(F.floor(F.col(x) * 4) for x in XS))).alias("i", "bin"),
    )
    bins = long.groupBy("group", "i", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("group", "i").orderBy("bin")
    ranks = bins.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("group", "i"))
    )

    def rank(i: int, quarters: int):
        reached = (F.col("i") == i) & (4 * F.col("upto") >= quarters * F.col("all"))
        return F.min(F.when(reached, (F.col("bin") + 0.5) / 4))

    ranks = ranks.groupBy("group").agg(
        *(rank(i, 2).alias(f"m{i}") for i in range(SIZE)),
        *((rank(i, 3) - rank(i, 1)).alias(f"spread{i}") for i in range(SIZE)),
    )
    least = vectors.groupBy("group").agg(
        *(
            F.min(F.struct(F.md5(F.concat("key", F.lit(f"/{s}"))).alias("key"), *XS)).alias(f"d{s}")
            for s in (2, 3)
        )
    )

    def start(number, means, spread=None):
        diagonal = ["1D" if spread is None else f"(1 + pow({spread}{i} / 1.349D, 2))" for i in range(SIZE)]
        cells = [f"{diagonal[i] if i == j else '0D'} AS c{i}{j}" for i, j in PAIRS]
        places = ", ".join(f"'{m}', {v}" for m, v in zip(MEANS, means))
        places += "".join(f", '{c.split(' AS ')[1]}', {c.split(' AS ')[0]}" for c in cells)
        return F.expr(f"named_struct('start', {number}, {places})")

    starts = F.array(
        start(0, MEANS),
        start(1, MEANS, "spread"),
        start(2, [f"d2.{x}" for x in XS]),
        start(3, [f"d3.{x}" for x in XS]),
    )
    return _with_group(ranks, least, groups).select("group", F.inline(starts))


def _moments(weight: str) -> list:
    """Weighted sums of what means and scatters are made of."""
    return [
        F.expr(f"sum({weight})").alias("w"),
        *(F.expr(f"sum({weight} * s{i})").alias(f"s{i}") for i in range(SIZE)),
        *(F.expr(f"sum({weight} * q{i}{j})").alias(f"q{i}{j}") for i, j in PAIRS),
    ]


def _estimate(sums: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Means, and scatters that are consistent for a normal sample plus the noise."""
    factor = core_factor(share)
    cells = [
        f"{factor!r}D * (q{i}{j} / w - s{i} / w * (s{j} / w)) + {int(i == j)} AS c{i}{j}"
        for i, j in PAIRS
    ]
    return sums.selectExpr(*keys, *(f"s{i} / w AS m{i}" for i in range(SIZE)), *cells)


def _sums() -> list:
    return [
        *(F.sum(f"x{i}").alias(f"s{i}") for i in range(SIZE)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS),
    ]


def _concentrate(vectors: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One step from every start: mean and scatter of the nearest half.

    Distances are counted in classes of a sixteenth of an octave, with the sums
    of each class, so one pass over the vectors is enough and no group is sorted.
    The class in which the half ends counts with the share that is still needed,
    so a class of equal rows cannot fill the core."""
    classes = (
        _with_group(vectors, _factor(estimates), groups)
        .withColumn("bin", F.expr(f"CAST(floor(log2(0.001 + {distance_sql()}) * 16) AS INT)"))
        .groupBy("group", "start", "bin")
        .agg(F.count("*").alias("n"), *_sums())
    )
    each = Window.partitionBy("group", "start")
    weighed = (
        classes.withColumn("upto", F.sum("n").over(each.orderBy("bin")))
        .withColumn("all", F.sum("n").over(each))
        .withColumn("core", F.expr(f"least(all, (all + {SIZE + 1}) DIV 2)"))
        .withColumn("part", F.expr("greatest(0D, least(1D, (core - upto + n) / n))"))
    )
    sums = weighed.withColumn("w", F.expr("part * n")).groupBy("group", "start").agg(
        F.sum("w").alias("w"), *_moments("part")[1:]
    )
    return _estimate(sums, ["group", "start"], 0.5)


def _settled(before: DataFrame, after: DataFrame) -> bool:
    names = [*MEANS, *CELLS]
    old = before.select("group", "start", *(F.col(n).alias(f"old_{n}") for n in names))
    moved = " OR ".join(f"abs({n} - old_{n}) > 1e-9 * (1 + abs({n}))" for n in names)
    return after.join(old, ["group", "start"]).where(moved).isEmpty()


def minimum_determinant(vectors: DataFrame, groups: int) -> DataFrame:
    """(group, n, m0.., c00, ..) from (group, key, x0..): for each group the core
    estimate of the smallest determinant, made again from all rows within it."""
    estimates = stored(_first_estimates(vectors, groups), "outlier-estimates")
    places = vectors.select("group", *XS)
    for _ in range(STEPS):
        before = estimates
        estimates = stored(_concentrate(places, before, groups * STARTS), "outlier-estimates")
        if _settled(before, estimates):
            break
    # Starts that end in one core differ by rounding only; the first one is taken.
    size = F.round(F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(SIZE))), 6)
    rest = [*MEANS, *(f"l{i}{j}" for i, j in PAIRS)]
    best = (
        _factor(estimates)
        .groupBy("group")
        .agg(F.min(F.struct(size.alias("size"), "start", *rest)).alias("best"))
        .select("group", *(F.col(f"best.{n}") for n in rest))
    )
    inside = f"CASE WHEN {distance_sql()} <= {chi_squared_quantile(INSIDE)!r}D THEN 1 ELSE 0 END"
    marked = _with_group(places, best, groups).select("group", *XS, F.expr(inside).alias("part"))
    sums = marked.selectExpr(
        "group",
        "part",
        *(f"x{i} AS s{i}" for i in range(SIZE)),
        *(f"x{i} * x{j} AS q{i}{j}" for i, j in PAIRS),
    )
    sums = sums.groupBy("group").agg(F.count("*").alias("n"), *_moments("part"))
    return _estimate(sums, ["group", "n"], INSIDE)


def _drawn(estimates: DataFrame) -> DataFrame:
    """Estimates of the groups, mixed with that of all documents: as if PRIOR
    more documents had been like those of all. A group needs more documents than
    there are features to have a scatter of its own."""
    everything = estimates.where(F.col("group") == ALL).first()
    if everything is None:
        return estimates.where("false").drop("n")
    own = f"(greatest(0, n - {SIZE}) / (greatest(0, n - {SIZE}) + {PRIOR}D))"
    gap = {i: f"(m{i} - ({everything[f'm{i}']!r}D))" for i in range(SIZE)}
    means = [f"m{i} - (1 - {own}) * {gap[i]} AS m{i}" for i in range(SIZE)]
    cells = [
        f"{own} * c{i}{j} + (1 - {own}) * ({everything[f'c{i}{j}']!r}D) "
        f"+ {own} * (1 - {own}) * {gap[i]} * {gap[j]} AS c{i}{j}"
        for i, j in PAIRS
    ]
    return estimates.where(F.col("group") != ALL).selectExpr("group", *means, *cells)


def judge(documents: DataFrame) -> DataFrame:
    """Counts of `text_statistics` plus base_failed, group, distance2 and kept.

    base_failed: fewer than MIN_WORDS words, or more than half of them repeat.
    The others are judged by the estimate of their language and source, made of
    the documents that pass and drawn towards that of all; null is a language or
    source of its own. Repeated rows count each.
    """
    counts = stored(text_statistics(documents), "outlier-counts")
    places = [
        F.expr(f"CASE WHEN NOT base_failed THEN {formula} / {noise!r}D END").alias(f"x{i}")
        for i, (formula, noise) in enumerate(FEATURES.values())
    ]
    named = counts.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ).withColumn("group", F.to_json(F.array("lang", "source"), {"ignoreNullFields": "false"}))
    named = named.select("*", *places)
    # Every document counts for its own group and for all.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    vectors = stored(
        named.where("NOT base_failed").select(
            F.explode(F.array(F.lit(ALL), F.col("group"))).alias("group"), key, *XS
        ),
        "outlier-vectors",
    )
    groups = vectors.select("group").distinct().count()
    estimates = stored(minimum_determinant(vectors, groups), "outlier-estimates")
    factors = _factor(_drawn(estimates))
    if groups <= GROUP_ROWS:
        factors = F.broadcast(factors)
    return named.join(factors, "group", "left").select(
        *counts.columns,
        "base_failed",
        "group",
        F.expr(distance_sql()).alias("distance2"),
        F.expr(f"NOT base_failed AND coalesce({distance_sql()} <= {CUT!r}D, true)").alias("kept"),
    )
