"""URL filters by association rules.

Labelled URLs become baskets of tokens; frequent-pattern growth finds token
combinations, and those that imply the bad label with enough support and
confidence, while no part of them does, are rules. A rule is indexed under its rarest token, so a URL is
compared only with rules that share it. Listed host and path rules go first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlark.llm.common import stored

BAD = "label:bad"
INDEX_ROWS = 50_000  # up to this many rules the index is broadcast


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels of the host, segments of the
    path, the ending of the last one, names in the query, the fragment. Digits
    become #, so numbered pages share tokens."""
    scheme = F.regexp_extract(url, r"(?s)\A(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)\z", 1)
    ending = F.regexp_extract(path, r"\.([^./]+)\z", 1)

    def named(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(prefix), v))

    def digits(value: Column) -> Column:
        return F.regexp_replace(value, "[0-9]+", "#")

    names = F.transform(F.split(query, "&"), lambda v: F.regexp_extract(v, r"(?s)\A([^=]*)", 1))
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), scheme)),
        named("host:", F.split(host, r"\.")),
        named("path:", F.split(digits(path), "/")),
        F.array(F.concat(F.lit("end:"), digits(ending))),
        named("query:", names),
        F.array(F.concat(F.lit("part:"), digits(fragment))),
    )
    return F.array_distinct(F.filter(tokens, lambda t: ~t.endswith(":") & t.isNotNull()))


def mine_rules(
    baskets: DataFrame,
    min_support: float = 0.001,
    min_count: int = 20,
    min_confidence: float = 0.6,
    copies: bool = True,
) -> DataFrame:
    """(rule_id, antecedent, index_token, confidence, count) from (tokens, bad).

    With `copies` every row counts; else equal baskets of one label count once.
    Support is the share of baskets with tokens and label, at least `min_count`
    of them. Rules are the least combinations that pass: what holds all tokens of
    a combination that passes is blocked by it already. Tokens that occur in the
    same baskets are mined as one, since combinations of them have equal counts,
    and each of them stands in for the others in a rule of its own: pages of one
    template that share any number of tokens add no combinations.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = baskets.where("size(tokens) > 0").select(
        F.array_sort("tokens").alias("tokens"), "bad"
    )
    if not copies:
        baskets = baskets.distinct()
    baskets = baskets.withColumn("basket", F.monotonically_increasing_id())
    baskets = stored(baskets, "url-baskets")
    schema = (
        "rule_id string, antecedent array<string>, index_token string, "
        "confidence double, count long"
    )
    total = baskets.count()
    spark = baskets.sparkSession
    if not total:
        return spark.createDataFrame([], schema)
    least = max(min_count, -int(-min_support * total // 1))
    tokens = baskets.select("basket", F.explode("tokens").alias("token"), "bad")
    # Two 64-bit hashes of the set of baskets tell whether two sets are equal.
    counts = tokens.groupBy("token").agg(
        F.count("*").alias("n"),
        F.sum(F.col("bad").cast("long")).alias("n_bad"),
        F.bit_xor(F.xxhash64("basket")).alias("set1"),
        F.bit_xor(F.xxhash64("basket", F.lit("second"))).alias("set2"),
    )
    # A token needs the support with the label: so does every rule with it.
    counts = stored(counts.where(F.col("n_bad") >= least), "url-tokens")
    same = ["n", "n_bad", "set1", "set2"]
    first = counts.groupBy(*same).agg(F.min("token").alias("first"))
    counts = stored(counts.join(first, same).select("token", "n", "first"), "url-tokens")
    frequent = F.broadcast(counts) if counts.count() <= INDEX_ROWS else counts
    items = (
        tokens.join(frequent.where("token = first").select("token"), "token")
        .groupBy("basket", "bad")
        .agg(F.collect_set("token").alias("items"))
        .select(
            F.when(F.col("bad"), F.array_append("items", F.lit(BAD)))
            .otherwise(F.col("items"))
            .alias("items")
        )
    )
    items = stored(items, "url-items")
    mined = items.count()
    if not mined:
        return spark.createDataFrame([], schema)
    growth = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / mined, minConfidence=0.0)
    patterns = stored(growth.fit(items).freqItemsets, "url-patterns")
    key = F.concat_ws("\n", F.array_sort("items"))
    bad = patterns.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("count")
    )
    bad = bad.withColumn("rule_id", key)
    plain = patterns.where(~F.array_contains("items", BAD)).select(
        key.alias("rule_id"), F.col("freq").alias("all")
    )
    passing = stored(
        bad.join(plain, "rule_id")
        .withColumn("confidence", F.col("count") / F.col("all"))
        .where(F.col("confidence") >= min_confidence),
        "url-passing",
    )
    rules = _stand_ins(_least(passing), counts)
    index = (
        rules.select("rule_id", F.explode("items").alias("token"))
        .join(counts, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("n", "token")).getField("token").alias("index_token"))
    )
    return rules.join(index, "rule_id").select(
        "rule_id", F.col("items").alias("antecedent"), "index_token", "confidence", "count"
    )


def _least(passing: DataFrame) -> DataFrame:
    """The combinations of which no part passes. Level by level, a combination
    goes if one with a token less passes or has gone itself."""
    longest = passing.agg(F.max(F.size("items"))).first()[0] or 0
    kept = passing.where("size(items) = 1")
    blocked = kept.select("rule_id")
    for size in range(2, longest + 1):
        level = passing.where(F.size("items") == size)
        parts = level.select(
            F.col("rule_id").alias("whole"),
            F.explode(
                F.transform("items", lambda t: F.concat_ws("\n", F.array_remove("items", t)))
            ).alias("rule_id"),
        )
        above = stored(
            parts.join(blocked, "rule_id").select(F.col("whole").alias("rule_id")).distinct(),
            "url-blocked",
        )
        fresh = level.join(above, "rule_id", "left_anti")
        kept = kept.unionByName(fresh)
        blocked = above.unionByName(fresh.select("rule_id"))
    return kept


def _stand_ins(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Each rule once for each choice of tokens of the same baskets."""
    classes = stored(
        counts.groupBy("first").agg(F.array_sort(F.collect_set("token")).alias("members")),
        "url-classes",
    )
    longest = rules.agg(F.max(F.size("items"))).first()[0] or 0
    for place in range(longest):
        rules = (
            rules.withColumn("first", F.get("items", F.lit(place)))
            .join(classes, "first", "left")
            .withColumn("member", F.explode_outer("members"))
            .withColumn(
                "items",
                F.when(
                    F.col("member").isNotNull(),
                    F.transform(
                        "items", lambda t, i: F.when(i == place, F.col("member")).otherwise(t)
                    ),
                ).otherwise(F.col("items")),
            )
            .drop("first", "members", "member")
        )
    rules = rules.withColumn("items", F.array_sort("items"))
    return stored(rules.withColumn("rule_id", F.concat_ws("\n", "items")), "url-least-rules")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: list[HostRule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) per page.

    The longest listed rule that fits decides, else `block` if a mined rule's
    tokens are all in the URL, else `allow`. mined_rule is the fitting one of
    highest confidence, then the first by name. A null URL, or one without ://,
    has empty host and path and no tokens. Repeated rows stay repeated.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for item in sorted(listed, key=lambda r: (len(r.name), r.name)):
        fits = (F.col("host") == item.host) | F.col("host").endswith("." + item.host)
        fits = fits & F.col("path").startswith(item.path)
        rule = F.when(fits, item.name).otherwise(rule)
        verdict = F.when(fits, item.verdict).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    rows = rows.withColumn("key", F.xxhash64(F.col("page_id").cast("string"), "url"))

    open_ = rows.where("listed IS NULL AND instr(url, '://') > 0").select(
        "key", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    )
    rules = stored(rules, "url-rules")
    if rules.count() <= INDEX_ROWS:
        rules = F.broadcast(rules)
    fitting = (
        open_.select("key", "tokens", F.explode("tokens").alias("index_token"))
        .join(rules, "index_token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("key")
        .agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule_id")).alias("best"))
        .select("key", F.col("best.rule_id").alias("mined_rule"), (-F.col("best.c")).alias("confidence"))
    )
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return rows.join(fitting, "key", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("listed", method).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"),
        F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"),
    )
