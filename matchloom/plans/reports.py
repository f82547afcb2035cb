"""Reports, checks and splits of the matching pipeline as SQL, written once for Spark and DuckDB like those of `relational`."""

from __future__ import annotations

from matchloom.plans.relational import SPARK, Dialect, query


def _grams(d: Dialect, x: str) -> str:
    """Distinct 3-grams of a string; a shorter one is its own."""
    if d is SPARK:
        return f"array_distinct(transform(sequence(1, greatest(length({x}) - 2, 1)), i -> substring({x}, i, 3)))"
    return f"list_distinct([substring({x}, i, 3) FOR i IN range(1, greatest(length({x}) - 2, 1) + 1)])"


def _union(d: Dialect, x: str, y: str) -> str:
    return f"array_union({x}, {y})" if d is SPARK else f"list_distinct(list_concat({x}, {y}))"


def _jaccard(d: Dialect, x: str, y: str) -> str:
    return f"{d.size}({d.intersect}({x}, {y})) / CAST({d.size}({_union(d, x, y)}) AS DOUBLE)"


_PAIRS = "FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c"

# Text
query("clean_addr", lambda d: "SELECT entity_id, trim(" + d.re("replace(lower(business_address), '&', ' and ')", "[^a-z0-9]+", " ") + ") AS cleaned FROM biz", True)
query("strip_raw_name", lambda d: "SELECT p_partkey, trim(" + d.re("lower(p_name)", "[ \t]+", " ") + ") AS raw_name FROM part")
query("text_views", "SELECT entity_id, core_name AS name, trim(concat_ws(' ', core_name, state)) AS name_city, trim(concat_ws(' ', core_name, replace(business_address, ',', ''))) AS name_addr FROM biz", True)
query("ce_text", "SELECT entity_id, concat(coalesce(core_name, ''), ' | ', coalesce(business_address, ''), ' | ', coalesce(country, '')) AS text FROM biz", True)
query("numbers", lambda d: f"SELECT entity_id, {d.join}({'array_sort(array_distinct(transform(regexp_extract_all(business_address, \'[0-9]+\', 0), x -> ' + d.re('x', '^0+([0-9])', '$1') + ')))' if d is SPARK else 'list_sort(list_distinct(list_transform(regexp_extract_all(business_address, \'[0-9]+\'), lambda x: ' + d.re('x', '^0+([0-9])', chr(92) + '1') + ')))'}, ',') AS numbers FROM biz", True)
query("script_flags", lambda d: "SELECT lang, " + ", ".join(f"avg(CASE WHEN {'text RLIKE' if d is SPARK else 'regexp_matches(text,'} '[{chr(92) * (2 if d is SPARK else 1)}p{{{'Is' if d is SPARK else ''}{s}}}]'{'' if d is SPARK else ')'} THEN 1.0e0 ELSE 0.0e0 END) AS {s.lower()}" for s in ("Latin", "Devanagari", "Tamil", "Cyrillic")) + " FROM documents GROUP BY 1")
query("rarest_token", lambda d: f""", x AS (SELECT entity_id, country, {d.tokens('core_name')} AS ts FROM biz), e AS (SELECT entity_id, country, t FROM x, {d.each('ts', 't')}),
  f AS (SELECT country, t, count(*) AS df FROM e GROUP BY 1, 2)
SELECT entity_id, t AS token, df FROM (SELECT e.entity_id, e.t, f.df, row_number() OVER (PARTITION BY e.entity_id ORDER BY f.df, e.t) AS r FROM e JOIN f ON e.country = f.country AND e.t = f.t) z WHERE r = 1""", True)
# Similarities of true pairs
query("sim_eq", f"SELECT q, c, CASE WHEN a.state > '' AND b.state > '' THEN CASE WHEN a.state = b.state THEN 1 ELSE 0 END END AS same_state {_PAIRS}", True)
query("sim_c3_jaccard", lambda d: f"SELECT q, c, {_jaccard(d, 'x', 'y')} AS j FROM (SELECT q, c, {_grams(d, _padded('a'))} AS x, {_grams(d, _padded('b'))} AS y {_PAIRS} WHERE a.core_name <> '' AND b.core_name <> '') z", True)
query("sim_jaccard3_unpadded", lambda d: f"SELECT q, c, 100 * {_jaccard(d, 'x', 'y')} AS j FROM (SELECT q, c, {_grams(d, 'a.core_name')} AS x, {_grams(d, 'b.core_name')} AS y {_PAIRS} WHERE length(a.core_name) >= 3 AND length(b.core_name) >= 3) z", True)


def _padded(side: str) -> str:
    return f"concat(' ', {side}.core_name, ' ')"


# Joins and sets
query("append_new_pairs", """WITH old AS (SELECT o_custkey AS s1, o_orderkey AS cand, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F'), found AS (SELECT o_custkey AS s1, o_orderkey AS cand, o_totalprice AS score FROM orders WHERE o_totalprice > 100000),
  best AS (SELECT s1, max(score) AS best FROM old GROUP BY 1)
SELECT old.s1, cand, score, best FROM old JOIN best ON old.s1 = best.s1
UNION ALL SELECT f.s1, f.cand, f.score, best FROM found f LEFT JOIN best ON f.s1 = best.s1 WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.s1 = f.s1 AND old.cand = f.cand)""")
query("disjoint_assert", "SELECT count(*) AS shared FROM (SELECT entity_id FROM biz WHERE doc_id % 3 = 0 INTERSECT SELECT entity_id FROM biz WHERE doc_id % 3 <> 0) x", True)
query("fill_states", """, c AS (SELECT country, substring(core_name, 1, 4) AS city, state, count(*) AS n FROM biz WHERE state IS NOT NULL GROUP BY 1, 2, 3),
  m AS (SELECT country, city, state FROM (SELECT *, sum(n) OVER (PARTITION BY country, city) AS total, row_number() OVER (PARTITION BY country, city ORDER BY n DESC, state) AS r FROM c) z WHERE r = 1 AND n >= 0.5 * total)
SELECT entity_id, coalesce(b.state, m.state) AS state, CASE WHEN b.state IS NOT NULL THEN 'own' WHEN m.state IS NOT NULL THEN 'city' ELSE 'none' END AS state_src FROM biz b LEFT JOIN m ON b.country = m.country AND substring(b.core_name, 1, 4) = m.city""", True)
# Checks of lists
query("check_candidates", "SELECT count(*) AS pairs, count(*) - count(DISTINCT concat(CAST(q AS STRING), '-', CAST(c AS STRING))) AS repeats, max(n) AS longest FROM (SELECT q, c, count(*) OVER (PARTITION BY q) AS n FROM truth) x", True)
query("merge_pieces", "SELECT l_orderkey AS piece, count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AS complete FROM lineitem GROUP BY 1")
query("changed_share", """WITH f AS (SELECT o_custkey AS s1, o_orderkey AS cand FROM orders), g AS (SELECT o_custkey AS s1, o_orderkey AS cand FROM orders WHERE o_orderstatus <> 'P'),
  d AS (SELECT DISTINCT s1 FROM (SELECT s1, cand FROM f EXCEPT SELECT s1, cand FROM g) x)
SELECT avg(CASE WHEN d.s1 IS NULL THEN 0.0e0 ELSE 1.0e0 END) AS changed FROM (SELECT DISTINCT s1 FROM f) a LEFT JOIN d ON a.s1 = d.s1""")
# Reports
query("noise_rates", lambda d: f"""SELECT country, avg(CASE WHEN x = y THEN 1.0e0 ELSE 0.0e0 END) AS identical, avg(CASE WHEN x <> y AND {d.size}({d.intersect}(s, t)) = {d.size}(s) AND {d.size}(s) = {d.size}(t) THEN 1.0e0 ELSE 0.0e0 END) AS reordered,
  avg(CASE WHEN x <> y AND levenshtein(x, y) <= 2 THEN 1.0e0 ELSE 0.0e0 END) AS typo, avg(CASE WHEN {d.size}({d.intersect}(s, t)) = 0 THEN 1.0e0 ELSE 0.0e0 END) AS no_word
FROM (SELECT a.country, a.core_name AS x, b.core_name AS y, {d.tokens('a.core_name')} AS s, {d.tokens('b.core_name')} AS t {_PAIRS}) z GROUP BY 1""", True)
query("train_test_drift", lambda d: f""", x AS (SELECT country, doc_id % 3 = 0 AS s1, {d.tokens('core_name')} AS ts FROM biz), f AS (SELECT country, s1, t, count(*) AS n FROM x, {d.each('ts', 't')} GROUP BY 1, 2, 3),
  top AS (SELECT country, s1, t FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY n DESC, t) AS r FROM f) z WHERE r <= 200), g AS (SELECT country, t, count(*) AS sides FROM top GROUP BY 1, 2)
SELECT country, avg(CASE WHEN sides = 2 THEN 1.0e0 ELSE 0.0e0 END) AS jaccard, count(*) AS tokens FROM g GROUP BY 1""", True)
query("bucket_stats", """, b AS (SELECT country, coalesce(state, '~none') AS bucket, count(*) AS n FROM biz GROUP BY 1, 2)
SELECT country, bucket, n, n / CAST(total AS DOUBLE) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY country) AS total, row_number() OVER (PARTITION BY country ORDER BY n DESC, bucket) AS r FROM b) z WHERE r <= 5""", True)
query("list_sizes", "SELECT c_mktsegment, avg(n) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS median, percentile_disc(0.95) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS p95, max(n) AS longest, avg(CASE WHEN n = 0 THEN 1.0e0 ELSE 0.0e0 END) AS empty FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) x GROUP BY 1")
_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS part, avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS missing, percentile_disc(0.1) WITHIN GROUP (ORDER BY {c}) AS p10, percentile_disc(0.5) WITHIN GROUP (ORDER BY {c}) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY {c}) AS p90 FROM lineitem GROUP BY l_returnflag" for c in _COLUMNS)
query("profile", _PROFILE)
query("shift_table", f"WITH p AS ({_PROFILE}) SELECT a.feature, a.median AS before, b.median AS after, abs(a.missing - b.missing) > 0.1 AS missing_shift, b.median < a.p10 OR b.median > a.p90 AS median_shift, b.p90 < a.median OR b.p10 > a.median AS range_shift FROM p a JOIN p b ON a.feature = b.feature WHERE a.part = 'A' AND b.part = 'N'")
query("agreement_report", f"SELECT coalesce(a.country, 'ALL') AS country, count(*) AS pairs, avg(CASE WHEN a.state = b.state THEN 1.0e0 ELSE 0.0e0 END) AS same_state, avg(CASE WHEN a.core_name = b.core_name THEN 1.0e0 ELSE 0.0e0 END) AS same_name {_PAIRS} GROUP BY ROLLUP (a.country)", True)
query("train_test_flags", """, m AS (SELECT country, avg(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN state IS NULL THEN 1.0e0 ELSE 0.0e0 END END) AS a, avg(CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN state IS NULL THEN 1.0e0 ELSE 0.0e0 END END) AS b FROM biz GROUP BY 1)
SELECT country, a AS query_side, b AS pool_side, abs(a - b) > 0.1 AS differs FROM m""", True)
query("error_groups", "SELECT l_shipmonth, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS n, avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS r FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) x GROUP BY 1")
query("stress_methods", "SELECT methods, quality, avg(n_chars) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY CAST(n_chars AS DOUBLE)) AS median, count(*) AS n FROM (SELECT CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%http%' THEN 1 ELSE 0 END + CASE WHEN text LIKE '%#%' THEN 1 ELSE 0 END AS methods, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x GROUP BY 1, 2")
query("group_recall", f"SELECT a.country, avg(CASE WHEN a.state IS NULL OR b.state IS NULL THEN CASE WHEN a.core_name = b.core_name THEN 1.0e0 ELSE 0.0e0 END END) AS stateless, avg(CASE WHEN a.state <> b.state THEN CASE WHEN a.core_name = b.core_name THEN 1.0e0 ELSE 0.0e0 END END) AS moved, avg(CASE WHEN b.doc_id % 3 = 2 THEN CASE WHEN a.core_name = b.core_name THEN 1.0e0 ELSE 0.0e0 END END) AS third_source {_PAIRS} GROUP BY 1", True)
query("matches_per_s1", "SELECT country, avg(n) AS mean, " + ", ".join(f"avg(CASE WHEN n {op} {k} THEN 1.0e0 ELSE 0.0e0 END) AS n{k}" for k, op in ((0, "="), (1, "="), (2, "="), (3, "="), (4, ">="))) + " FROM (SELECT b.doc_id, b.country, count(t.c) AS n FROM biz b LEFT JOIN truth t ON t.q = b.doc_id WHERE b.doc_id % 3 = 0 GROUP BY 1, 2) x GROUP BY 1", True)
# Splits and samples, by hashes that both engines share
query("fold_of", lambda d: f"SELECT entity_id, {_hash(d)} % 5 AS fold, {_hash(d)} % 1000 < 100 AS early_stop FROM biz", True)
query("stratified_split", """, m AS (SELECT b.entity_id, b.country, least(count(t.c), 4) AS bucket FROM biz b LEFT JOIN truth t ON t.q = b.doc_id WHERE b.doc_id % 3 = 0 GROUP BY 1, 2),
  h AS (SELECT *, substring(md5(entity_id), 1, 2) AS s FROM m), k AS (SELECT country, bucket, s, sum(count(*)) OVER (PARTITION BY country, bucket ORDER BY s) - count(*) AS before FROM h GROUP BY 1, 2, 3)
SELECT entity_id, CAST((k.before + row_number() OVER (PARTITION BY h.country, h.bucket, h.s ORDER BY md5(entity_id), entity_id) - 1) % 5 AS BIGINT) AS fold FROM h JOIN k ON h.country IS NOT DISTINCT FROM k.country AND h.bucket = k.bucket AND h.s = k.s""", True)
query("sample_s1_lists", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS STRING)), c_custkey LIMIT 100)")
query("pseudo_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.095 THEN 1 ELSE 0 END AS label FROM lineitem WHERE l_discount >= 0.095 OR l_discount <= 0.005")


def _hash(d: Dialect) -> str:
    digits = "substring(md5(entity_id), 1, 6)"
    return f"CAST(conv({digits}, 16, 10) AS BIGINT)" if d is SPARK else f"CAST(concat('0x', {digits}) AS BIGINT)"
