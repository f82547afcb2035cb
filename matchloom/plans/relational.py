"""Relational operators of the matching pipeline as SQL over whole tables, written once for Spark and DuckDB.

Where the two dialects differ (tokens, unnesting, patterns) the text comes from a Dialect. Records are a view of the documents
table: source by id, name from the first line, address from what follows, country by language, state by source.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations", "benchmark")


class Dialect(NamedTuple):
    """What Spark and DuckDB spell differently."""

    re: Callable[[str, str, str], str]
    tokens: Callable[[str], str]
    each: Callable[[str, str], str]
    size: str
    join: str
    intersect: str
    union: str


SPARK = Dialect(
    lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}')", lambda x: f"array_distinct(filter(split({x}, ' '), t -> t <> ''))", lambda a, n: f"LATERAL explode({a}) AS {n}_({n})",
    "size", "array_join", "array_intersect", "array_union",
)
DUCK = Dialect(
    lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')", lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))", lambda a, n: f"unnest({a}) AS {n}_({n})",
    "len", "array_to_string", "list_intersect", "list_union",
)


def records(d: Dialect) -> str:
    """biz: one business-like record a document; truth: pairs of one language with equal first 80 characters and lengths within a tenth, one owner a candidate. Copies are counted once before the join."""
    core = "trim(" + d.re("lower(substring(split_part(text, chr(10), 1), 1, 60))", "[^a-z0-9]+", " ") + ")"
    return f"""biz AS (
  SELECT doc_id, 'S' || CAST(doc_id % 3 + 1 AS STRING) || '-' || CAST(doc_id AS STRING) AS entity_id, {core} AS core_name,
    substring(text, 61, 140) AS business_address, substring(text, 1, 80) AS head, n_chars,
    CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'de' THEN 'Germany' WHEN 'es' THEN 'Spain' END AS country,
    CASE WHEN doc_id % 10 <> 0 THEN source END AS state FROM documents),
owners AS (
  SELECT p.country, p.head, p.n_chars, min(s.doc_id) AS q FROM (SELECT DISTINCT country, head, n_chars FROM biz WHERE doc_id % 3 <> 0) p
  JOIN (SELECT country, head, n_chars, min(doc_id) AS doc_id FROM biz WHERE doc_id % 3 = 0 GROUP BY 1, 2, 3) s ON s.country = p.country AND s.head = p.head
  WHERE abs(s.n_chars - p.n_chars) * 10 <= greatest(s.n_chars, p.n_chars) GROUP BY 1, 2, 3),
truth AS (
  SELECT o.q, b.doc_id AS c FROM biz b JOIN owners o ON b.country = o.country AND b.head = o.head AND b.n_chars = o.n_chars WHERE b.doc_id % 3 <> 0)"""


_MAKERS: dict[str, Callable[[Dialect], str]] = {}


def query(name: str, body: str | Callable[[Dialect], str], with_records: bool = False) -> None:
    make = body if callable(body) else (lambda d: body)
    _MAKERS[name] = (lambda d: f"WITH {records(d)}\n{make(d)}") if with_records else make


# Scans and projections
query("scan_parquet_project", "SELECT o_orderkey, o_totalprice FROM orders")
query("scan_lazy_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
query("records_view", "SELECT entity_id, core_name, country, state FROM biz", True)
query("country_key", "SELECT doc_id, lower(trim(coalesce(lang, ''))) AS ckey FROM documents")
query("clean_name", lambda d: "SELECT p_partkey, trim(" + d.re("replace(lower(p_name), '&', ' and ')", "[^a-z0-9]+", " ") + ") AS cleaned FROM part")
query("number_suffix", lambda d: "SELECT c_custkey, " + d.re(d.re("c_name", "[^0-9]+", ""), "^0+([0-9])", "$1" if d is SPARK else r"\1") + " AS num FROM customer")
query("id_parity", lambda d: "SELECT s_suppkey, CAST(" + d.re("s_name", "[^0-9]+", "") + " AS BIGINT) % 2 AS half FROM supplier")
query("source_prefix", "SELECT substring(entity_id, 1, 2) AS side, count(*) AS n FROM biz GROUP BY 1", True)
query("truth_pairs", "SELECT q, c FROM truth", True)
# Joins
query("join_inner_eq", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
query("join_left_eq", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
query("join_right", "SELECT t.c, b.entity_id FROM truth t RIGHT JOIN biz b ON t.q = b.doc_id WHERE b.doc_id % 3 = 0", True)
query("join_full", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_c, coalesce(b.n, 0) AS n_s FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
query("join_self_list", "SELECT a.l_orderkey, a.l_linenumber, max(b.l_quantity) AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2")
query("join_token", lambda d: f""", x AS (SELECT doc_id, country, {d.tokens('core_name')} AS ts FROM biz), e AS (SELECT doc_id, country, t FROM x, {d.each('ts', 't')}),
  rare AS (SELECT country, t FROM e WHERE length(t) >= 3 GROUP BY 1, 2 HAVING count(*) <= 20), y AS (SELECT e.* FROM e JOIN rare r ON e.country = r.country AND e.t = r.t)
SELECT a.doc_id AS s1, b.doc_id AS cand, count(*) AS shared FROM y a JOIN y b ON a.country = b.country AND a.t = b.t WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0 GROUP BY 1, 2""", True)
query("join_bucket_or_null", """, q AS (SELECT doc_id, country, state FROM biz WHERE doc_id % 3 = 0), p AS (SELECT country, state, count(*) AS n FROM biz WHERE doc_id % 3 <> 0 GROUP BY 1, 2), hit AS (
  SELECT q.doc_id AS s1, p.n FROM q JOIN p ON q.country = p.country AND q.state = p.state
  UNION ALL SELECT q.doc_id, p.n FROM q JOIN p ON q.country = p.country WHERE p.state IS NULL AND q.state IS NOT NULL
  UNION ALL SELECT q.doc_id, p.n FROM q JOIN (SELECT country, sum(n) AS n FROM p GROUP BY 1) p ON q.country = p.country WHERE q.state IS NULL)
SELECT s1, CAST(sum(n) AS BIGINT) AS n FROM hit GROUP BY 1""", True)
query("join_lookup_map", "SELECT n_name, CASE r_name WHEN 'EUROPE' THEN 'eu' WHEN 'ASIA' THEN 'as' ELSE 'other' END AS area FROM nation JOIN region ON n_regionkey = r_regionkey")
query("swap_lists", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_nationkey = 1")
# Aggregations
query("agg_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
query("agg_rates", "SELECT lang, avg(CASE WHEN text LIKE '%@%' THEN 1.0e0 ELSE 0.0e0 END) AS mail, avg(CASE WHEN n_chars < 200 THEN 1.0e0 ELSE 0.0e0 END) AS short FROM documents GROUP BY 1")
query("agg_quantiles", "SELECT o_orderpriority, percentile_disc(0.05) WITHIN GROUP (ORDER BY o_totalprice) AS p5, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY o_totalprice) AS p95 FROM orders GROUP BY 1")
query("agg_all_rollup", "SELECT coalesce(lang, 'ALL') AS lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY ROLLUP (lang)")
query("agg_conditional", "SELECT l_shipmode_key, count(*) FILTER (WHERE l_quantity < 10) AS few, count(*) FILTER (WHERE l_tax = 0) AS untaxed FROM (SELECT *, l_suppkey % 5 AS l_shipmode_key FROM lineitem) x GROUP BY 1")
query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
query("agg_first_by", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r = 1")
query("agg_last_nonnull", "SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS last_user FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL) x GROUP BY 1 HAVING count(*) = count(DISTINCT turn)")
query("agg_list", lambda d: f"SELECT s1, {d.join}({'transform(array_sort(collect_list(named_struct(\'a\', -t, \'b\', k))), x -> cast(x.b as string))' if d is SPARK else 'list(k ORDER BY t DESC, k)'}, ',') AS ids FROM (SELECT o_custkey AS s1, o_orderkey AS k, o_totalprice AS t FROM orders) x GROUP BY 1")
query("agg_top2", "SELECT user_id, max(value) AS first, max(CASE WHEN r = 2 THEN value END) AS second FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events WHERE value IS NOT NULL) x GROUP BY 1")
query("agg_bools", "SELECT conv_id, bool_or(role = 'system') AS any_system, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY 1")
query("token_df", lambda d: f", x AS (SELECT country, {d.tokens('core_name')} AS ts FROM biz) SELECT country, t, count(*) AS df FROM x, {d.each('ts', 't')} GROUP BY 1, 2", True)
query("token_idf", lambda d: f", x AS (SELECT country, {d.tokens('core_name')} AS ts FROM biz), n AS (SELECT country, count(*) AS n FROM biz GROUP BY 1), f AS (SELECT country, t, count(*) AS df FROM x, {d.each('ts', 't')} GROUP BY 1, 2) SELECT f.country, t, round(ln((n + 1) / CAST(df + 1 AS DOUBLE)), 9) AS w FROM f JOIN n ON f.country = n.country", True)
query("name_counts", "SELECT country, core_name, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_s1, count(*) FILTER (WHERE doc_id % 3 <> 0) AS n_pool FROM biz GROUP BY 1, 2", True)
query("state_maps", """, c AS (SELECT country, substring(core_name, 1, 4) AS city, state, count(*) AS n FROM biz WHERE state IS NOT NULL GROUP BY 1, 2, 3),
  r AS (SELECT *, sum(n) OVER (PARTITION BY country, city) AS total, row_number() OVER (PARTITION BY country, city ORDER BY n DESC, state) AS k FROM c)
SELECT country, city, state, CAST(total AS BIGINT) AS total FROM r WHERE k = 1 AND total >= 3 AND n >= 0.5 * total""", True)
query("partition_cost", "SELECT country, CAST(sum(a * b) AS BIGINT) AS pairs, max(a * b) AS largest FROM (SELECT country, state, count(*) FILTER (WHERE doc_id % 3 = 0) AS a, count(*) FILTER (WHERE doc_id % 3 <> 0) AS b FROM biz GROUP BY 1, 2) x GROUP BY 1", True)
query("key_agreement", "SELECT a.country, avg(CASE WHEN a.state = b.state THEN 1.0e0 ELSE 0.0e0 END) AS same_state, avg(CASE WHEN a.core_name = b.core_name THEN 1.0e0 ELSE 0.0e0 END) AS same_name FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c GROUP BY 1", True)
query("match_structure", "SELECT least(n, 4) AS matches, count(*) AS s1s FROM (SELECT b.doc_id, count(t.c) AS n FROM biz b LEFT JOIN truth t ON t.q = b.doc_id WHERE b.doc_id % 3 = 0 GROUP BY 1) x GROUP BY 1", True)
query("frequent_names", "SELECT country, core_name, n FROM (SELECT country, core_name, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, core_name) AS r FROM biz GROUP BY 1, 2) x WHERE r <= 30", True)
query("baseline_empty", "SELECT avg(CASE WHEN n = 0 THEN 1.0e0 ELSE 0.0e0 END) AS f05 FROM (SELECT b.doc_id, count(t.c) AS n FROM biz b LEFT JOIN truth t ON t.q = b.doc_id WHERE b.doc_id % 3 = 0 GROUP BY 1) x", True)
query("auc_rank", """, v AS (SELECT n_chars, CAST(floor(n_chars / 256) AS BIGINT) AS b, count(*) AS n, sum(quality) AS pos FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2),
  w AS (SELECT b, sum(sum(n)) OVER (ORDER BY b) - sum(n) AS before FROM v GROUP BY b),
  r AS (SELECT v.*, w.before + sum(n) OVER (PARTITION BY v.b ORDER BY n_chars) - n + (n + 1) / 2.0e0 AS avg_rank FROM v JOIN w ON v.b = w.b),
  t AS (SELECT CAST(sum(pos) AS DOUBLE) AS n1, CAST(sum(n - pos) AS DOUBLE) AS n0, sum(pos * avg_rank) AS ranks FROM r)
SELECT (ranks - n1 * (n1 + 1) / 2.0e0) / (n1 * n0) AS auc FROM t""".replace(", v AS", "WITH v AS", 1))
query("calibration", "SELECT CAST(floor(l_discount * 100) AS BIGINT) AS bin, round(avg(l_discount), 9) AS mean_p, avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END) AS rate FROM lineitem GROUP BY 1")
query("error_bands", "SELECT CASE WHEN l_discount < 0.02 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS band, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
query("pivot_wide", "SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, min(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1")
query("pairs_evaluated", "SELECT country, CAST(sum(CASE WHEN state IS NULL THEN pool ELSE own + open END) AS BIGINT) AS comparisons FROM (SELECT q.country, q.state, (SELECT count(*) FROM biz p WHERE p.doc_id % 3 <> 0 AND p.country = q.country) AS pool, (SELECT count(*) FROM biz p WHERE p.doc_id % 3 <> 0 AND p.country = q.country AND p.state = q.state) AS own, (SELECT count(*) FROM biz p WHERE p.doc_id % 3 <> 0 AND p.country = q.country AND p.state IS NULL) AS open FROM biz q WHERE q.doc_id % 3 = 0) x GROUP BY 1", True)
query("token_diffs", lambda d: f"""SELECT side, t, count(*) AS n FROM (
  SELECT 'only_s1' AS side, t FROM (SELECT {d.tokens('a.core_name')} AS x, {d.tokens('b.core_name')} AS y FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c) z, {d.each('x', 't')} WHERE NOT {'array_contains' if d is SPARK else 'list_contains'}(y, t)
  UNION ALL SELECT 'only_match' AS side, t FROM (SELECT {d.tokens('a.core_name')} AS x, {d.tokens('b.core_name')} AS y FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c) z, {d.each('y', 't')} WHERE NOT {'array_contains' if d is SPARK else 'list_contains'}(x, t)) w GROUP BY 1, 2""", True)
# Windows
query("win_rank_ordinal", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
query("win_rank_average", """WITH v AS (SELECT event_type, value, CAST(floor(value) AS BIGINT) AS b, count(*) AS n FROM events GROUP BY 1, 2, 3),
  w AS (SELECT event_type, b, sum(sum(n)) OVER (PARTITION BY event_type ORDER BY b NULLS FIRST) - sum(n) AS before FROM v GROUP BY event_type, b),
  r AS (SELECT v.event_type, v.value, w.before + sum(n) OVER (PARTITION BY v.event_type, v.b ORDER BY v.value) - n + (n + 1) / 2.0e0 AS r FROM v JOIN w ON v.event_type IS NOT DISTINCT FROM w.event_type AND v.b IS NOT DISTINCT FROM w.b)
SELECT e.event_id, r.r FROM events e JOIN r ON e.event_type IS NOT DISTINCT FROM r.event_type AND e.value IS NOT DISTINCT FROM r.value""")
query("win_totals", "SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey) AS best, count(*) OVER (PARTITION BY l_orderkey) AS size, count(CASE WHEN l_discount > 0.05 THEN 1 END) OVER (PARTITION BY l_orderkey) AS n05 FROM lineitem")
query("win_gap_to_best", "SELECT o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 6) AS gap FROM orders")
query("win_lead", "SELECT o_orderkey, coalesce(round(o_totalprice - lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 6), 1.0e0) AS lead FROM orders")
query("win_best_other", "SELECT o_orderkey, CASE WHEN r = 1 THEN second ELSE first END AS other FROM (SELECT o_orderkey, row_number() OVER w AS r, first_value(o_totalprice) OVER w AS first, lead(o_totalprice) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) x")
query("win_dup_in_list", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) - 1 AS dups FROM lineitem")
query("win_random_fold", """WITH h AS (SELECT doc_id, lang, md5(CAST(doc_id AS STRING)) AS h FROM documents), g AS (SELECT doc_id, lang, h, substring(h, 1, 2) AS b FROM h),
  c AS (SELECT lang, b, sum(count(*)) OVER (PARTITION BY lang ORDER BY b) - count(*) AS before FROM g GROUP BY lang, b)
SELECT g.doc_id, CAST((c.before + row_number() OVER (PARTITION BY g.lang, g.b ORDER BY g.h, g.doc_id) - 1) % 5 AS BIGINT) AS fold FROM g JOIN c ON g.lang IS NOT DISTINCT FROM c.lang AND g.b = c.b""")
query("win_shuffle_limit", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS r FROM documents) x WHERE r <= 5")
# Sorts and sets
query("sort_multi", "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars DESC NULLS LAST, doc_id")
query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
query("topn_per_group", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) x WHERE r <= 10")
query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
query("sym_diff", "(SELECT p_partkey AS k FROM part WHERE p_size < 20 EXCEPT SELECT p_partkey FROM part WHERE p_size > 10) UNION ALL (SELECT p_partkey FROM part WHERE p_size > 10 EXCEPT SELECT p_partkey FROM part WHERE p_size < 20)")
query("equal_sets_assert", "SELECT count(*) AS missing FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) x")
query("sample_structured", ", keep AS (SELECT doc_id FROM biz WHERE doc_id % 3 = 0 AND substring(md5(CAST(doc_id AS STRING)), 1, 1) < '4') SELECT doc_id FROM keep UNION SELECT c FROM truth WHERE q IN (SELECT doc_id FROM keep)", True)
query("pareto", """WITH v AS (SELECT n_chars, CAST(floor(n_chars / 256) AS BIGINT) AS b, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2),
  w AS (SELECT b, max(max(doc_id)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v GROUP BY b)
SELECT n_chars, doc_id FROM (SELECT v.n_chars, v.doc_id, greatest(coalesce(w.before, -1), coalesce(max(v.doc_id) OVER (PARTITION BY v.b ORDER BY v.n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS m FROM v JOIN w ON v.b = w.b) x WHERE doc_id > m""")
query("sim_levenshtein", "SELECT q, c, CAST(levenshtein(a.core_name, b.core_name) AS BIGINT) AS d FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c", True)
query("sim_tok_jaccard", lambda d: f"SELECT q, c, {d.size}({d.intersect}(x, y)) / CAST({d.size}({'array_union(x, y)' if d is SPARK else 'list_distinct(list_concat(x, y))'}) AS DOUBLE) AS j FROM (SELECT q, c, {d.tokens('a.core_name')} AS x, {d.tokens('b.core_name')} AS y FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c) z WHERE {d.size}(x) > 0 AND {d.size}(y) > 0", True)


def run_sql(make: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = make(SPARK)
        for t in TABLES:
            if t in sql:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run_sql(make) for name, make in _MAKERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: make(DUCK) for name, make in _MAKERS.items()}
