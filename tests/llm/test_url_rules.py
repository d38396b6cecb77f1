from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rasterlark.llm import url_rules
from rasterlark.llm.queries import LISTED, op6_url_rules

PAGE = "page_id long, url string, html string, host string, rule string, key string"


def pages(spark, urls):
    rows = [(i, u, None, None, None, None) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, PAGE)


NO_RULES = (
    "rule_id string, antecedent array<string>, index_token string, confidence double, count long"
)


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("http://b.org/fr/?q=://x.net/", "b.org", "/fr/", "org/fr/", "allow"),
        ("nothing", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.net/x\ny#", "É.net", "/x\ny", "net/", "block"),
        ("://?", "", "", None, "allow"),
    ],
)
def test_listed_rules(spark, url, host, path, rule, verdict):
    none = spark.createDataFrame([], NO_RULES)
    row = url_rules.judge_urls(pages(spark, [url]), none, LISTED).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_tokens(spark):
    url = F.col("url")
    frame = pages(spark, ["https://m.Shop.de/a/12/b.html?x=1&y=2&x=3#top", None, "://"])
    tokens = url_rules.url_tokens(url, url_rules.host_of(url), url_rules.path_of(url))
    found = [r.t for r in frame.select(tokens.alias("t")).collect()]
    assert found[0] == ["scheme:https", "host:m", "host:shop", "host:de", "path:a", "path:#",
                        "path:b.html", "end:html", "query:x", "query:y", "part:top"]
    assert found[2] == []


def mined_by_hand(baskets, least, confidence, copies):
    rules = {}
    distinct = [(tuple(sorted(t)), b) for t, b in baskets if t]
    if not copies:
        distinct = set(distinct)
    for size in range(1, 5):
        counts = {}
        for tokens, bad in distinct:
            for chosen in combinations(tokens, size):
                n, m = counts.get(chosen, (0, 0))
                counts[chosen] = (n + 1, m + bad)
        for chosen, (n, m) in counts.items():
            if m >= least and m / n >= confidence:
                rules[chosen] = (m, m / n)
    return {
        chosen: found for chosen, found in rules.items()
        if not any(set(part) < set(chosen) for part in rules)
    }


@pytest.mark.parametrize("copies", [False, True])
def test_mined_rules_are_the_least_of_all_combinations(spark, copies):
    baskets = []
    for i in range(60):
        tokens = [f"a{i % 2}", f"b{i % 3}", f"c{i % 5}", f"u{i}"]
        baskets.append((tokens[: 3 + (i % 4 > 0)], i % 6 == 0 or i % 10 == 3))
    baskets += [baskets[0]] * 50 + [([], True)]
    frame = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(
        frame, min_support=0.0, min_count=3, min_confidence=0.8, copies=copies
    )
    found = {tuple(r.antecedent): (r["count"], r.confidence) for r in rules.collect()}
    expected = mined_by_hand(baskets, 3, 0.8, copies)
    assert max(map(len, expected)) > 1 and found == expected


def test_pages_of_one_template_add_no_combinations(spark):
    """Thirty tokens shared, half of the baskets bad: 2**30 combinations, all of
    the same counts. Two more tokens, also always together, make it a rule."""
    shared = [f"t{i:02}" for i in range(30)]
    baskets = [(shared, i % 2 == 0) for i in range(40)]
    baskets += [([*shared, "x", "y"], True)] * 20 + [(["x", "y"], False)] * 40
    frame = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(frame, min_support=0.0, min_count=20, min_confidence=0.9)
    found = {tuple(r.antecedent): (r["count"], r.confidence) for r in rules.collect()}
    assert found == {(t, z): (20, 1.0) for t in shared for z in "xy"}


def test_sql_of_the_same_rules_where_labels_depend_on_urls(spark, tmp_path):
    import duckdb

    from rasterlark.llm.oracle import all_oracles

    urls, bad = [], []
    for i in range(1500):
        site, part, odd = f"s{i % 6}", "abcde"[i % 5], "?promo=1" if i % 7 == 0 else ""
        urls.append(f"http://{site}.de/{part}/{i}{odd}")
        bad.append(int((i % 6 == 1 and i % 5 == 2) or (i % 7 == 0 and i % 6 in (3, 4)) or i % 90 == 8))
    urls += ["http://s1.de/c/9", "http://s3.net/b/?promo=2", None, "none", "http://s1.de/c/9"]
    pages(spark, urls).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, b, 1) for i, b in enumerate(bad)]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')"
        )
    key = lambda r: tuple((x is not None, x) for x in r)
    found = sorted(map(tuple, op6_url_rules(spark, str(tmp_path)).collect()), key=key)
    expected = sorted(connection.sql(all_oracles()["op6_url_rules"]).fetchall(), key=key)
    assert found == expected
    assert len({r[5] for r in found if r[5]}) == 3


def test_mined_rules_decide_where_no_listed_rule_fits(spark):
    rules = spark.createDataFrame(
        [("r1", ["host:spam", "path:x"], "host:spam", 0.9, 9), ("r2", ["path:x"], "path:x", 0.7, 30)],
        NO_RULES,
    )
    urls = ["http://spam.com/x/", "http://ok.com/x/", "http://spam.com/y", "http://spam.net/x/", None]
    found = [
        (r.verdict, r.mined_rule)
        for r in url_rules.judge_urls(pages(spark, urls * 2), rules, LISTED).orderBy("page_id").collect()
    ]
    expected = [("block", "r1"), ("block", "r2"), ("allow", None), ("block", None), ("allow", None)]
    assert found == expected * 2


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], "tokens array<string>, bad boolean")
    assert url_rules.mine_rules(empty).count() == 0
    few = spark.createDataFrame([(["a"], True)], "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(few)
    assert rules.count() == 0
    assert url_rules.judge_urls(pages(spark, []), rules, LISTED).count() == 0


def test_numbered_pages_of_one_template_count_each(spark, tmp_path):
    urls = [f"http://spam.de/en/{i}" for i in range(3001)]
    urls += [f"http://good.de/a/{i}" for i in range(3000)] + ["http://spam.de/en/99999"]
    pages(spark, urls).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, int(i < 3000), 1) for i in range(6001)]  # the last page has no label
    frame = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.page_id: r for r in op6_url_rules(spark, str(tmp_path)).collect()}
    assert found[6001].verdict == "block" and found[6001].confidence == 3000 / 3001
    assert all((r.verdict == "block") == (i < 3001 or i == 6001) for i, r in found.items())


def test_all_tokens_of_a_wide_basket_count(spark):
    wide = [f"t{i:02}" for i in range(20)]
    baskets = [(wide, True)] + [([t], True) for t in wide for _ in range(4)]
    baskets += [(["t00"], True)] * 5 + [(["t00"], False)] * 2
    frame = spark.createDataFrame(baskets, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(frame, min_support=0.0, min_count=5, copies=True)
    found = {tuple(r.antecedent): (r["count"], r.confidence) for r in rules.collect()}
    assert found == {("t00",): (10, 10 / 12)} | {(t,): (5, 1.0) for t in wide[1:]}
