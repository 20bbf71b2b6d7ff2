"""SQL of infilling, quality rules and centroid clusters, for DuckDB."""

from __future__ import annotations

from marlstone.llm import infill, rules

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def infill_sql() -> str:
    hold = " OR ".join(f"contains(text, '{m}')" for m in infill.MARKERS)
    number = lambda i: f"CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
n AS (SELECT *, CAST(length(text) AS BIGINT) AS n, {', '.join(map(number, range(4)))} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR {hold} OR h3 % 100 >= {infill.PLAIN} THEN 'plain' WHEN h4 % 100 < {infill.SPM} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
s AS (SELECT *, string_split_regex(output, '<[PSM]>') AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END) AS restored_sha256 FROM s"""


def rules_sql() -> str:
    """The rounds of the fit one after the other, each from the probabilities of the one before, with a row a pattern and rule."""
    m = len(rules.RULES)
    vote = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END" for _, good, bad in rules.RULES)
    vote = vote.replace("13 * n_words / 2", "6.5 * n_words").replace("n_words / 50", "n_words / 50.0").replace("n_words / 4", "n_words / 4.0")
    accuracy = lambda way, mass: f"({rules.RIGHT} + sum(CASE WHEN v = {way} THEN {mass} ELSE 0e0 END)) / ({rules.RIGHT + rules.WRONG} + sum(CASE WHEN v <> 0 THEN {mass} ELSE 0e0 END))"
    steps = [f"m0 AS MATERIALIZED (SELECT j, {rules.START[0]}e0 AS good, {rules.START[1]}e0 AS bad, 0.5e0 AS prior FROM range(1, {m + 1}) t(j))"]
    odds = "ln(any_value(prior) / (1 - any_value(prior))) + sum(CASE v WHEN 1 THEN ln(good / (1 - bad)) WHEN -1 THEN ln((1 - good) / bad) ELSE 0e0 END)"
    for r in range(rules.ROUNDS):
        steps.append(f"e{r} AS MATERIALIZED (SELECT votes, any_value(n) AS n, 1 / (1 + exp(-({odds}))) AS p FROM q JOIN m{r} USING (j) GROUP BY votes)")
        share = f"(SELECT (1 + coalesce(sum(n * p), 0)) / (2 + coalesce(sum(n), 0)) FROM e{r})"
        steps.append(f"m{r + 1} AS MATERIALIZED (SELECT j, {accuracy(1, 'q.n * p')} AS good, {accuracy(-1, 'q.n * (1 - p)')} AS bad, {share} AS prior FROM q JOIN e{r} USING (votes) GROUP BY j)")
    steps.append(f"post AS (SELECT votes, 1 / (1 + exp(-({odds}))) AS p FROM q JOIN m{rules.ROUNDS} USING (j) GROUP BY votes)")
    chain = ",\n".join(steps)
    g = rules.GRAM
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {g - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {g - 2}, 1))) t(i)),
again AS (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT g.r, unnest(range(i, i + {g})) AS p FROM g JOIN again USING (r, g)) GROUP BY r),
s AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '{rules.LETTER}'))) AS n_lettered,
  CAST(length(regexp_replace(text, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{rules.SYMBOL}')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(regexp_extract_all(text, '{rules.LETTER}')) AS n_letters, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[.!?]')) AS n_ends FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{vote}] AS votes FROM s),
pat AS (SELECT votes, CAST(count_if(NOT base_failed) AS DOUBLE) AS n FROM b GROUP BY votes),
q AS MATERIALIZED (SELECT votes, n, unnest(votes) AS v, generate_subscripts(votes, 1) AS j FROM pat),
{chain}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior FROM b JOIN post USING (votes)"""


def centroids_sql(width: int = 64, scale: int = 256, clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for r in range(rounds + 1):
        pairs = f"SELECT x.r, c.c, list_sum(list_transform(list_zip(x.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM x CROSS JOIN c{r} c"
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, CAST(min(d) AS BIGINT) AS d FROM ({pairs}) GROUP BY r)")
        if r < rounds:
            means = f"SELECT c, list(m ORDER BY j) AS v FROM (SELECT a.c, j, CAST(floor(sum(e) / count(*)) AS BIGINT) AS m FROM (SELECT r, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM x) JOIN a{r} a USING (r) GROUP BY a.c, j) GROUP BY c"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN ({means}) n USING (c))")
    chain = ",\n".join(steps)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {width}),
x AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor({scale} * x) AS BIGINT)) AS v FROM k WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT {clusters})),
{chain}
SELECT vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM x JOIN a{rounds} a USING (r) JOIN c{rounds} f ON f.c = a.c"""


SQL = {"op11_infill": infill_sql(), "op12_quality_rules": rules_sql(), "op13_centroids": centroids_sql()}
