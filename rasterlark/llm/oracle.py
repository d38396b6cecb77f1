"""SQL for DuckDB that recomputes registered queries.

Queries whose operator tokenizes, hashes, sorts suffixes or estimates by
iteration over texts have none; tests compare those with brute force.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM sound q JOIN sound c
    ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM pairs WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


# -- robust outliers ----------------------------------------------------------

FEATURES = [
    "ln(word_chars / n_words) / 0.06",
    "ln(1 + 50 * n_symbols / word_chars) / 0.25",
    "ln(1 + n_dup_lines) / 0.5",
    "sqrt(n_repeat_words / n_words) / 0.12",
]
COUNTS = f"""
rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text
  FROM documents
), words AS (
  SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM rows_)
), windows AS (
  SELECT r, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), starts AS (
  SELECT r, i FROM windows WHERE w2 IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY r, word, w1, w2) > 1
), repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM starts, (VALUES (0), (1), (2)) AS t(k) GROUP BY r
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows_)
  WHERE regexp_matches(line, '{WORD}')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), sizes AS (
  SELECT r, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY r
), counts AS (
  SELECT d.doc_id, d.lang, d.source,
    coalesce(s.n, 0) AS n_words,
    CAST(coalesce(s.chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words,
    coalesce(s.n, 0) < 50 OR 100 * coalesce(p.n, 0) > 50 * coalesce(s.n, 0) AS base_failed
  FROM rows_ d LEFT JOIN sizes s USING (r) LEFT JOIN dups l USING (r)
    LEFT JOIN repeated p USING (r)
)"""


def outlier_sql(
    half: float, most: float, inside: float, cut: float, steps: int = 8, prior: int = 20
) -> str:
    """`half` and `most` make the scatters of the core and of the rows `inside`
    consistent. The scatter is inverted here by elimination on the rows of the
    group table, its determinant is the product of the pivots, the distance is a
    quadratic form with the inverse, and cores are summed up from rows."""
    n = len(FEATURES)
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    xs = ", ".join(f"x{i}" for i in range(n))
    means = ", ".join(f"m{i}" for i in range(n))
    name = "coalesce('=' || lang, '') || chr(1) || coalesce('=' || source, '')"
    parts = [
        COUNTS,
        f"named AS MATERIALIZED (SELECT *, {name} AS own FROM counts)",
        f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS v, * FROM (
    SELECT unnest(['*', own]) AS grp, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
      {", ".join(f"{f} AS x{i}" for i, f in enumerate(FEATURES))}
    FROM named WHERE NOT base_failed)
)""",
    ]
    for i in range(n):
        ranks = ", ".join(
            f"min(CASE WHEN 4 * upto >= {q} * all_ THEN (bin + 0.5) / 4 END) AS r{i}_{q}"
            for q in (1, 2, 3)
        )
        parts.append(
            f"""rank{i} AS (
  SELECT grp, {ranks} FROM (
    SELECT grp, bin, sum(count(*)) OVER (PARTITION BY grp ORDER BY bin) AS upto,
      sum(count(*)) OVER (PARTITION BY grp) AS all_
    FROM (SELECT grp, floor(x{i} * 4) AS bin FROM vectors) GROUP BY grp, bin)
  GROUP BY grp
)"""
        )
    parts.append(
        "ranks AS MATERIALIZED (SELECT * FROM rank0"
        + "".join(f" JOIN rank{i} USING (grp)" for i in range(1, n))
        + ")"
    )
    unit = ", ".join(f"{float(i == j)} AS c{i}{j}" for i, j in pairs)
    wide = ", ".join(
        f"1 + pow((r{i}_3 - r{i}_1) / 1.349, 2) AS c{i}{j}" if i == j else f"0.0 AS c{i}{j}"
        for i, j in pairs
    )
    medians = ", ".join(f"r{i}_2 AS m{i}" for i in range(n))
    fields = ", ".join(f"'x{i}': x{i}" for i in range(n))
    starts = [
        f"SELECT grp, 0 AS s, {medians}, {unit} FROM ranks",
        f"SELECT grp, 1, {medians}, {wide} FROM ranks",
    ]
    for s in (2, 3):
        starts.append(
            f"SELECT grp, {s}, {', '.join(f'd.x{i}' for i in range(n))}, {unit} FROM ("
            f"SELECT grp, min({{'k': md5(key || '/{s}'), {fields}}}) AS d FROM vectors GROUP BY grp)"
        )
    parts.append("e0 AS MATERIALIZED (" + " UNION ALL ".join(starts) + ")")

    def inverse(target: str, source: str, keys: str) -> None:
        """Adds v_ij, the inverse, and det, by elimination: a CTE for each pivot."""
        cell = {(i, j): f"c{max(i, j)}{min(i, j)}" for i in range(n) for j in range(n)}
        columns = [f"{cell[i, j]} AS a{i}{j}" for i in range(n) for j in range(n)]
        columns += [f"{float(i == j)} AS v{i}{j}" for i in range(n) for j in range(n)]
        parts.append(
            f"{target}_0 AS MATERIALIZED (SELECT {keys}, {means}, 0.0 AS det, "
            f"{', '.join(columns)} FROM {source})"
        )
        for p in range(n):
            new = []
            for kind in "av":
                for i in range(n):
                    for j in range(n):
                        row = f"{kind}{p}{j} / a{p}{p}"
                        value = row if i == p else f"{kind}{i}{j} - a{i}{p} * {row}"
                        new.append(f"{value} AS {kind}{i}{j}")
            parts.append(
                f"{target}_{p + 1} AS MATERIALIZED (SELECT {keys}, {means}, "
                f"det + ln(a{p}{p}) AS det, {', '.join(new)} FROM {target}_{p})"
            )

    form = " + ".join(
        f"v{i}{j} * (x{i} - m{i}) * (x{j} - m{j})" for i in range(n) for j in range(n)
    )

    def moments(factor: float) -> str:
        of = [f"sum(w * x{i}) / sum(w) AS m{i}" for i in range(n)]
        of += [
            f"{factor!r} * (sum(w * x{i} * x{j}) / sum(w) - sum(w * x{i}) / sum(w) "
            f"* (sum(w * x{j}) / sum(w))) + {int(i == j)} AS c{i}{j}"
            for i, j in pairs
        ]
        return ", ".join(of)

    for step in range(steps):
        inverse(f"i{step}", f"e{step}", "grp, s")
        parts.append(
            f"""b{step} AS MATERIALIZED (
  SELECT grp, s, {xs}, floor(log2(0.001 + {form}) * 16) AS bin
  FROM vectors JOIN i{step}_{n} USING (grp)
), t{step} AS MATERIALIZED (
  SELECT grp, s, bin,
    greatest(0.0, least(1.0, (least(all_, (all_ + {n + 1}) // 2) - upto + n) / n)) AS w
  FROM (SELECT grp, s, bin, count(*) AS n,
      sum(count(*)) OVER (PARTITION BY grp, s ORDER BY bin) AS upto,
      sum(count(*)) OVER (PARTITION BY grp, s) AS all_
    FROM b{step} GROUP BY grp, s, bin)
), e{step + 1} AS MATERIALIZED (
  SELECT grp, s, {moments(half)} FROM b{step} JOIN t{step} USING (grp, s, bin) GROUP BY grp, s
)"""
        )
    inverse("core", f"e{steps}", "grp, s")
    parts.append(
        f"""best AS MATERIALIZED (
  SELECT * FROM core_{n}
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(det, 6), s) = 1
), near AS MATERIALIZED (
  SELECT grp, {xs}, CASE WHEN {form} <= {inside!r} THEN 1 ELSE 0 END AS w
  FROM vectors JOIN best USING (grp)
), again AS MATERIALIZED (
  SELECT grp, count(*) AS n, greatest(0, count(*) - {n}) AS free, {moments(most)}
  FROM near GROUP BY grp
), drawn AS MATERIALIZED (
  SELECT g.grp, g.free / (g.free + {float(prior)}) AS k,
    {", ".join(f"k * g.m{i} + (1 - k) * a.m{i} AS m{i}" for i in range(n))},
    {", ".join(
        f"k * g.c{i}{j} + (1 - k) * a.c{i}{j} + k * (1 - k) * (g.m{i} - a.m{i}) * (g.m{j} - a.m{j})"
        f" AS c{i}{j}" for i, j in pairs)}
  FROM again g JOIN again a ON a.grp = '*' WHERE g.grp <> '*'
)"""
    )
    inverse("final", "drawn", "grp")
    last = ", ".join(
        f"CASE WHEN NOT base_failed THEN {f} END AS x{i}" for i, f in enumerate(FEATURES)
    )
    parts.append(f"judged AS (SELECT *, own AS grp, {last} FROM named)")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({form} <= {cut!r}, true) AS kept
FROM judged LEFT JOIN final_{n} USING (grp)"""
    )


# -- association rules --------------------------------------------------------

URL_TOKENS = r"""
split AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), tokens AS (
  SELECT page_id, url, list_distinct(list_filter(list_concat(
    ['scheme:' || regexp_extract(url, '(?s)^(.*?)://', 1)],
    list_transform(string_split(host, '.'), lambda x: 'host:' || x),
    list_transform(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: 'path:' || x),
    ['end:' || regexp_replace(regexp_extract(path, '\.([^./]+)$', 1), '[0-9]+', '#', 'g')],
    list_transform(string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&'),
      lambda x: 'query:' || regexp_extract(x, '(?s)^([^=]*)', 1)),
    ['part:' || regexp_replace(regexp_extract(url, '(?s)#(.*)$', 1), '[0-9]+', '#', 'g')]
  ), lambda x: x IS NOT NULL AND NOT ends_with(x, ':'))) AS tokens
  FROM split WHERE instr(url, '://') > 0
)"""

URL_RULES = f"""
WITH RECURSIVE {URL_TOKENS}, marks AS (
  SELECT doc_id AS page_id, bool_or(coalesce(toxic = 1 OR quality = 0, false)) AS bad
  FROM labels GROUP BY doc_id
), baskets AS (
  SELECT list_sort(tokens) AS tokens, bad FROM tokens JOIN marks USING (page_id)
  WHERE len(tokens) > 0
), numbered AS (SELECT row_number() OVER () AS b, * FROM baskets
), least AS (SELECT greatest(20, ceil(0.001 * count(*))) AS n FROM numbered
), single AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest(tokens) AS token, bad FROM numbered)
  GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT n FROM least)
), items AS (
  SELECT b, bad, token FROM (SELECT b, bad, unnest(tokens) AS token FROM numbered)
    JOIN single USING (token)
), sets AS (
  SELECT b, bad, [token] AS ante, token AS last FROM items
  UNION ALL
  SELECT s.b, s.bad, list_append(s.ante, i.token), i.token
  FROM sets s JOIN items i ON s.b = i.b AND i.token > s.last
), passing AS (
  SELECT ante, count(*) FILTER (bad) / count(*) AS confidence FROM sets GROUP BY ante
  HAVING count(*) FILTER (bad) >= (SELECT n FROM least)
    AND count(*) FILTER (bad) / count(*) >= 0.6
), rules AS (
  SELECT * FROM passing p WHERE NOT EXISTS (
    SELECT 1 FROM passing s WHERE len(s.ante) < len(p.ante) AND list_has_all(p.ante, s.ante))
), fitting AS (
  SELECT page_id, url, min({{'c': -confidence, 'rule': array_to_string(ante, chr(10))}}) AS best
  FROM tokens JOIN rules ON list_has_all(tokens, ante) GROUP BY page_id, url
), listed AS (
  SELECT page_id, url, host, path, rule, verdict FROM split JOIN (VALUES
    ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, verdict)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    CROSS JOIN LATERAL (SELECT h || p AS rule)
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule) DESC) = 1
)
SELECT s.page_id, s.host, s.path, l.rule,
  coalesce(l.verdict, CASE WHEN f.best IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN l.rule IS NULL THEN f.best.rule END AS mined_rule,
  CASE WHEN l.rule IS NULL THEN -f.best.c END AS confidence
FROM split s
  LEFT JOIN listed l ON s.page_id = l.page_id AND s.url IS NOT DISTINCT FROM l.url
  LEFT JOIN fitting f ON s.page_id = f.page_id AND s.url = f.url
"""


# -- hierarchical budgets -----------------------------------------------------


def budget_sql() -> str:
    """Weights as in the query; twice the words of a source at most."""
    weight = {
        "domain": "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 "
        "WHEN 'domain2' THEN 2 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END",
        "source": "CASE source WHEN 'src0' THEN 2 ELSE 1 END",
    }
    parts = [
        f"""d AS (
  SELECT doc_id, 'domain' || CAST(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '')
      AS BIGINT) % 4 AS VARCHAR) AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS capacity
  FROM d GROUP BY ALL
), nodes0 AS (
  SELECT *, least(sum(tokens) OVER (), sum(capacity) OVER ()) AS given FROM leaves
)"""
    ]
    levels = ["domain", "lang", "source"]
    for depth, level in enumerate(levels):
        names = ", ".join(levels[: depth + 1])
        family = f"PARTITION BY {', '.join(levels[:depth])}" if depth else ""
        match = " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in levels[: depth + 1])
        parts.append(
            f"""ranked{depth} AS (
  SELECT {names}, any_value(given) AS given, sum(capacity) AS room, {weight[level]} AS weight
  FROM nodes{depth} GROUP BY {names}
), ordered{depth} AS (
  SELECT *, row_number() OVER ({family} ORDER BY CAST(room AS DOUBLE) / weight,
    {level} NULLS FIRST) AS nth FROM ranked{depth}
), left{depth} AS (
  SELECT *, given - coalesce(sum(room) OVER ({family} ORDER BY nth
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER ({family} ORDER BY nth
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM ordered{depth}
), level{depth} AS (
  SELECT *, min(nth) FILTER (room * weights > rest * weight) OVER ({family}) AS halt
  FROM left{depth}
), part{depth} AS (
  SELECT *, CASE WHEN halt IS NULL OR nth < halt THEN room ELSE least(room,
    max(rest) FILTER (nth = halt) OVER ({family}) * weight
      // max(weights) FILTER (nth = halt) OVER ({family})) END AS part
  FROM level{depth}
), nodes{depth + 1} AS (
  SELECT n.* EXCLUDE (given), p.part AS given FROM nodes{depth} n JOIN part{depth} p ON {match}
)"""
        )
    match = " AND ".join(f"d.{x} IS NOT DISTINCT FROM n.{x}" for x in levels)
    parts.append(
        f"""keyed AS (
  SELECT d.*, n.given // n.tokens AS full_epochs, n.given % n.tokens AS room,
    md5('7:' || CAST(CAST(n.given // n.tokens AS BIGINT) AS VARCHAR) || ':'
      || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM d JOIN nodes3 n ON {match} WHERE n.tokens > 0
), taken AS (
  SELECT *, CAST(full_epochs + CASE WHEN room > 0 AND sum(n_tokens) OVER (
    PARTITION BY domain, lang, source ORDER BY key) <= room THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM keyed
)"""
    )
    return (
        "WITH " + ",\n".join(parts) + """
SELECT doc_id, domain, lang, source, n_tokens, copies FROM taken WHERE copies > 0"""
    )


# -- vector codes -------------------------------------------------------------------
# Distances from inner products: whole numbers below 2**53 are exact as DOUBLE.


def code_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    def nearest(name: str, book: str) -> str:
        return f"""{name} AS MATERIALIZED (
  SELECT a.r, a.p, min({{'d': a.n2 - 2 * list_inner_product(a.v, b.v) + b.n2, 'e': b.e}}) AS best
  FROM parts a JOIN {book} b ON a.p = b.p GROUP BY a.r, a.p
)"""

    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
  SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS v
  FROM kept, range({parts}) AS t(p)
), parts AS MATERIALIZED (
  SELECT *, list_inner_product(v, v) AS n2 FROM cut
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v, n2 FROM parts WHERE r <= {entries})"""
    ]
    for i in range(rounds):
        steps += [
            nearest(f"near{i}", f"book{i}"),
            f"""sums{i} AS (
  SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (
    SELECT n.p, n.best.e AS e, generate_subscripts(a.v, 1) AS i, unnest(a.v)::BIGINT AS c
    FROM near{i} n JOIN parts a ON a.r = n.r AND a.p = n.p)
  GROUP BY p, e, i
), mean{i} AS (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM sums{i} GROUP BY p, e
), book{i + 1} AS MATERIALIZED (
  SELECT *, list_inner_product(v, v) AS n2 FROM (
    SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e)
)""",
        ]
    steps += [
        nearest("last", f"book{rounds}"),
        f"""coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM last GROUP BY r
), hashed AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (
    SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM book{rounds})
)""",
    ]
    return (
        "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       h AS codebooks_sha256
FROM kept JOIN coded USING (r), hashed"""
    )


def all_oracles() -> dict[str, str]:
    from rasterlark.llm import outliers

    return {
        "op1_exact_top_k": TOP_K,
        "op4_robust_outliers": outlier_sql(
            half=outliers.core_factor(0.5),
            most=outliers.core_factor(outliers.INSIDE),
            inside=outliers.chi_squared_quantile(outliers.INSIDE),
            cut=outliers.CUT,
        ),
        "op6_url_rules": URL_RULES,
        "op8_hierarchical_budget": budget_sql(),
        "op13_vector_codes": code_sql(),
    }
