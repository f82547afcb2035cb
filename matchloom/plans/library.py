"""Queries that call the library's functions where SQL in both engines would only show that the engines agree.

They take the place of the SQL queries of the same names; the DuckDB twins stay, or are given here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators import blocking, candidates, eda, models, reports, selection
from matchloom.plans import matching, relational
from matchloom.session import scratch, table, written
from matchloom.sources import files, lists

_hits, _records, _s1s, _truth = matching._hits, matching._records, matching._s1s, matching._truth


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_hits(spark, sf_dir).withColumnRenamed("score", "p"), "scored")


# Text
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clean(F.col("p_name"), True).alias("cleaned"))


def clean_addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("entity_id", text.clean(F.col("business_address"), False).alias("cleaned"))


def clean_text_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the 25 nations, cleaned on the driver as tables and settings are."""
    names = [(r["n_nationkey"], text.clean_text(f"{r['n_name']} & Co. d'Été", True)) for r in table(spark, sf_dir, "nation").collect()]
    return spark.createDataFrame(names, "n_nationkey int, cleaned string")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("entity_id", F.array_join(F.array_sort(text.number_tokens(F.col("business_address"))), ",").alias("numbers"))


def strip_raw_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.raw_name(F.col("p_name")).alias("raw_name"))


def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = text.text_views(F.col("core_name"), F.col("state"), F.col("business_address"))
    return _records(spark, sf_dir).select("entity_id", *[c.alias(k) for k, c in views.items()])


def ce_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("entity_id", text.ce_text(F.col("core_name"), F.col("business_address"), F.col("country")).alias("text"))


def eda_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents."""
    out = text.normal(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


def eda_translit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents."""
    out = text.plain_ascii(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("n"))


# Keys of whole documents: the first line is the name and all the rest the address
def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rest = F.when(F.instr(body, "\n") > 0, F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), chr(10)) + 1)")).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("country"), F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string")).alias("src"), F.substring_index(body, "\n", 1).alias("name"), rest.alias("addr")
    )


def eda_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.regions(_whole(spark, sf_dir))


def eda_add_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.add_keys(_whole(spark, sf_dir))


def _true_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return _truth(spark, sf_dir).select(number("s1").alias("s1"), number("cand").alias("cand"))


def eda_key_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.key_agreement(_true_docs(spark, sf_dir), written(eda.add_keys(_whole(spark, sf_dir)), "keys"))


def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.frequent_names(_whole(spark, sf_dir))


def agg_last_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn of each conversation; of a turn that repeats, the greatest text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("last_user"))
    return eda.last_in_order(turns, "conv_id", "last_user", "turn")


# States, folds and lists
def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumn("city", F.substring("core_name", 1, 4)).withColumn("dept", F.lit(None).cast("string"))


def state_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record view has few records a city: lower bars than the operator's own."""
    return blocking.state_maps(_places(spark, sf_dir), "city", 3, 0.5).withColumnRenamed("map_state", "state")


def fill_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.fill_states(_places(spark, sf_dir), 0, 0.5).select("entity_id", "state", "state_src")


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.bucket_stats(blocking.fill_states(_places(spark, sf_dir), 0, 0.5))
    return out.withColumn("share", F.round("share", 9))


def fold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("entity_id")
    return _records(spark, sf_dir).select("entity_id", models.fold_of(key, 5).cast("long").alias("fold"), (models.fold_of(key, 1000) < 100).alias("early_stop"))


def slice_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.slices(_records(spark, sf_dir).select("entity_id"), "entity_id", 7)


def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pseudo_labels(table(spark, sf_dir, "lineitem"), "l_discount", 0.095, 0.005).select("l_orderkey", "l_linenumber", "label")


def swap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("s1"), F.col("o_orderkey").cast("long").alias("cand"))
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.col("c_custkey").cast("long").alias("s1"))
    return candidates.swap_lists(old, ids.withColumn("cand", -F.col("s1")), ids).toDF("o_custkey", "o_orderkey")


def append_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    pairs = lambda rows: rows.select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("cand"), F.col("o_totalprice").alias("score"))
    return candidates.append_new(pairs(orders.where("o_orderstatus = 'F'")), pairs(orders.where("o_totalprice > 100000")))


def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.keep_first(_scored(spark, sf_dir), ["cand"], F.desc("p"), F.col("s1")).select("s1", "cand", "p")


def equal_sets_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines of odd parts: in both directions."""
    lines, orders = table(spark, sf_dir, "lineitem").where("l_partkey % 2 = 1").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return selection.set_differences(lines, orders)


def disjoint_assert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of open and of finished orders."""
    of = lambda status: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return of("O").intersect(of("F")).agg(F.count(F.lit(1)).alias("shared"))


def search_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search in four pieces of the queries, united: the rows of a whole search."""
    texts, (s1, pool) = matching._texts(spark, sf_dir), matching._sides()
    pieces = [blocking.search_forward(texts, s1 & (models.fold_of(F.col("id"), 4) == i), pool, 5, max_df=0.2).withColumn("piece", F.lit(i)) for i in range(4)]
    return reduce(DataFrame.unionByName, pieces)


def concat_parts_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three part tables, made one."""
    orders, parts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), []
    for k in range(3):
        parts.append(scratch(spark, f"orders-{k}"))
        orders.where(F.pmod("o_orderkey", F.lit(3)) == k).write.parquet(parts[-1])
    return files.concat_parts(spark, parts, scratch(spark, "orders"))


def read_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and types of the orders, from a footer."""
    return spark.createDataFrame(list(files.schema(spark, f"{sf_dir}/orders.parquet").items()), "name string, type string")


# Validation: lists with every fault
_FAULTY = """base AS (SELECT doc_id % 30 AS m, concat('S1-', CAST(doc_id AS STRING)) AS s1, concat('S2-', CAST(doc_id + 1 AS STRING)) AS a, concat('S3-', CAST(doc_id + 2 AS STRING)) AS b FROM documents WHERE doc_id % 3 = 0),
lists AS (SELECT s1, CASE m WHEN 3 THEN concat(a, ',', a) WHEN 6 THEN concat(a, ',', s1) WHEN 9 THEN 'X9-1' WHEN 12 THEN 'S2-99999999' ELSE concat(a, ',', b) END AS ids FROM base WHERE m <> 15
  UNION ALL SELECT s1, a FROM base WHERE m = 0 UNION ALL SELECT 'S1-99999999', '')"""
_LINES = """lines AS (SELECT concat(s1, CASE m WHEN 24 THEN ' ' ELSE chr(9) END, CASE m WHEN 21 THEN concat('"', a, '"') WHEN 27 THEN concat(a, ', ', b) ELSE concat(a, ',', b) END, CASE m WHEN 18 THEN concat(chr(9), 'x') ELSE '' END) AS line FROM base)"""


def _faulty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(f"WITH {_FAULTY}, {_LINES} SELECT * FROM {name}")


def validate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _records(spark, sf_dir).select(F.col("entity_id").alias("cand")).where(~F.col("cand").startswith("S1-"))
    return lists.validate(_faulty(spark, sf_dir, "lists"), _s1s(spark, sf_dir).select("s1"), pool)


def validate_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file with faulty lines, written and read back as raw lines."""
    path = scratch(spark, "faulty")
    _faulty(spark, sf_dir, "lines").toDF("\t".join(lists.MATCHES)).write.csv(path, sep="\u0001", header=True, quote="")
    return lists.validate_lines(lists.raw_lines(spark, path))


# Reports on the search's output
def _chosen(scored: DataFrame) -> DataFrame:
    return selection.select(scored, 0.5, 0.3)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.calibration(_scored(spark, sf_dir), _truth(spark, sf_dir))
    return out.select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


def error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return reports.error_bands(scored, _chosen(scored), _truth(spark, sf_dir))


def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return reports.error_groups(scored, _chosen(scored), _truth(spark, sf_dir), _records(spark, sf_dir))


def group_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_recall(_hits(spark, sf_dir), _truth(spark, sf_dir), _records(spark, sf_dir))


def stress_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward search, reverse search and rare tokens."""
    methods = {"forward": _hits, "reverse": matching.reverse_search, "rare": matching.rare_token_search}
    found = reduce(DataFrame.unionByName, [fn(spark, sf_dir).select(F.lit(k).alias("method"), "s1", "cand") for k, fn in methods.items()])
    return reports.stress_methods(written(found, "methods"), _truth(spark, sf_dir), _records(spark, sf_dir))


def pruned_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold and list length of the grid."""
    out = candidates.pruned_stats(_scored(spark, sf_dir), _truth(spark, sf_dir), _s1s(spark, sf_dir))
    return out.select("tau", "cap", "n", "hits", F.round("avg_size", 9).alias("avg_size"), F.round("recall", 9).alias("recall"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_name, clean_addr, clean_text_scalar, numbers, strip_raw_name, text_views, ce_text, eda_norm, eda_translit, eda_regions, eda_add_keys, eda_key_agreement, frequent_names, agg_last_nonnull,
        state_maps, fill_states, bucket_stats, fold_of, slice_by_hash, pseudo_labels, swap_lists, append_new_pairs, dedupe_keep_first, equal_sets_assert, disjoint_assert, search_piece, concat_parts_sink, read_schema,
        validate_lists, validate_file, calibration, error_bands, error_groups, group_recall, stress_methods, pruned_grid,
    )
}

_S, _CHOSEN = matching._SEARCH, matching._CHOSEN
_T = ", t AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c)"
_NORMAL = r"trim(regexp_replace(replace(lower(strip_accents({})), '&', ' and '), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_WHOLE = f"""recs AS (SELECT doc_id AS id, coalesce(lang, '') AS country, 'S' || (doc_id % 3 + 1) AS src, split_part(coalesce(text, ''), chr(10), 1) AS name,
  CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE '' END AS addr FROM documents),
cells AS (SELECT id, country, src, i = len(l) AS last, {_NORMAL.format('l[i]')} AS c FROM (SELECT *, string_split(addr, ',') AS l, unnest(range(1, len(string_split(addr, ',')) + 1)) AS i FROM recs)),
regions AS (SELECT country, c, n_last, n_all FROM (SELECT country, c, sum(last::INT)::BIGINT AS n_last, count(*) AS n_all FROM cells WHERE src = 'S1' AND c <> '' GROUP BY 1, 2) x
  JOIN (SELECT country, count(*) AS n_s1 FROM recs WHERE src = 'S1' GROUP BY 1) y USING (country) WHERE n_last >= 0.001 * n_s1 AND n_last >= 0.6 * n_all)"""
_KEYS = _WHOLE + f""", found AS (SELECT * FROM cells c WHERE c.c <> '' AND NOT regexp_matches(c.c, '[0-9]') AND NOT EXISTS (SELECT 1 FROM regions r WHERE r.country = c.country AND r.c = c.c)),
city AS (SELECT id, c AS city_key FROM (SELECT id, found.c, row_number() OVER (PARTITION BY id ORDER BY cf DESC, found.c) AS r FROM found JOIN (SELECT country, c, count(*) AS cf FROM found GROUP BY 1, 2) f ON f.country = found.country AND f.c = found.c) WHERE r = 1),
named AS (SELECT id, country, {_NORMAL.format('name')} AS name, {_NORMAL.format('addr')} AS addr FROM recs),
tok AS (SELECT id, country, unnest(string_split(name, ' ')) AS t FROM named),
rare AS (SELECT id, t AS rare_tok FROM (SELECT tok.id, tok.t, row_number() OVER (PARTITION BY tok.id ORDER BY tf, tok.t) AS r FROM tok JOIN (SELECT country, t, count(*) AS tf FROM tok GROUP BY 1, 2) f ON f.country = tok.country AND f.t = tok.t WHERE tok.t <> '') WHERE r = 1),
keys AS (SELECT named.id, city_key, list_filter(string_split(regexp_replace(addr, '^\\S+\\s*', ''), ' '), lambda x: regexp_full_match(x, '[0-9]{{5,6}}'))[-1] AS postcode, nullif(split_part(name, ' ', 1), '') AS first_tok, rare_tok FROM named LEFT JOIN city ON city.id = named.id LEFT JOIN rare ON rare.id = named.id)"""
_ERRORS = _S + _CHOSEN + _T + """, errs AS (SELECT s1, cand, 'wrong' AS kind FROM chosen c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s1 = c.s1 AND t.cand = c.cand)
  UNION ALL SELECT s1, cand, 'missed' FROM t WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE t.s1 = c.s1 AND t.cand = c.cand)),
e AS (SELECT errs.*, hits.score AS p FROM errs LEFT JOIN hits ON hits.s1 = errs.s1 AND hits.cand = errs.cand)"""
_FILLED = f"""WITH {relational.records(relational.DUCK)}, c AS (SELECT country, substring(core_name, 1, 4) AS city, state, count(*) AS n FROM biz WHERE state IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT country, city, state FROM (SELECT *, sum(n) OVER (PARTITION BY country, city) AS total, row_number() OVER (PARTITION BY country, city ORDER BY n DESC, state) AS r FROM c) z WHERE r = 1 AND n >= 0.5 * total),
filled AS (SELECT entity_id, b.country, coalesce(b.state, m.state) AS state, CASE WHEN b.state IS NOT NULL THEN 'own' WHEN m.state IS NOT NULL THEN 'city' ELSE 'none' END AS src FROM biz b LEFT JOIN m ON b.country = m.country AND substring(b.core_name, 1, 4) = m.city)"""
_MD5 = "CAST(concat('0x', substring(md5({}), 1, 6)) AS BIGINT)"
_ASCII = "replace(replace(replace(replace(strip_accents({}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '’', '''')"

ORACLES: dict[str, str] = {
    "clean_text_scalar": "SELECT n_nationkey, replace(lower(n_name), '_', ' ') || ' and co dete' AS cleaned FROM nation",
    "eda_norm": f"SELECT doc_id, md5(x) AS digest, length(x) AS n FROM (SELECT doc_id, {_NORMAL.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS x FROM documents)",
    "eda_translit": f"SELECT doc_id, md5(x) AS digest, length(x) AS n FROM (SELECT doc_id, trim(regexp_replace(replace(lower({_ASCII.format('coalesce(text, ' + chr(39) * 2 + ')')}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS x FROM documents)",
    "eda_regions": f"WITH {_WHOLE} SELECT * FROM regions",
    "eda_add_keys": f"WITH {_KEYS} SELECT * FROM keys",
    "eda_key_agreement": f"""WITH {relational.records(relational.DUCK)}, {_KEYS}, b AS (SELECT x.*, y.city_key AS c2, y.postcode AS p2, y.first_tok AS f2, y.rare_tok AS r2 FROM truth JOIN keys x ON x.id = truth.q JOIN keys y ON y.id = truth.c),
f AS (SELECT unnest([{{'key': 'city_key', 'same': coalesce(city_key = c2, false), 'missing': (city_key IS NULL OR c2 IS NULL)}}, {{'key': 'postcode', 'same': coalesce(postcode = p2, false), 'missing': (postcode IS NULL OR p2 IS NULL)}}, {{'key': 'first_tok', 'same': coalesce(first_tok = f2, false), 'missing': (first_tok IS NULL OR f2 IS NULL)}}, {{'key': 'rare_tok', 'same': coalesce(rare_tok = r2, false), 'missing': (rare_tok IS NULL OR r2 IS NULL)}},
  {{'key': 'none', 'same': NOT (coalesce(city_key = c2, false) OR coalesce(postcode = p2, false) OR coalesce(first_tok = f2, false) OR coalesce(rare_tok = r2, false)), 'missing': false}}]) AS x FROM b)
SELECT x.key AS key, count(*) AS pairs, count(*) FILTER (WHERE x.same) AS same, count(*) FILTER (WHERE x.missing) AS missing FROM f GROUP BY 1""",
    "frequent_names": f"WITH {_WHOLE} SELECT country, name, count(*) AS n, count(DISTINCT addr) AS addresses FROM (SELECT country, {_NORMAL.format('name')} AS name, {_NORMAL.format('addr')} AS addr FROM recs) WHERE name <> '' GROUP BY 1, 2 HAVING count(*) >= 2",
    "agg_last_nonnull": "SELECT k.conv_id, last_user FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN (SELECT conv_id, text AS last_user FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations WHERE role = 'user' AND text IS NOT NULL) WHERE r = 1) x ON x.conv_id = k.conv_id",
    "bucket_stats": _FILLED + ", p AS (SELECT country, src, state, count(*) FILTER (WHERE entity_id LIKE 'S1-%') AS q, count(*) FILTER (WHERE entity_id NOT LIKE 'S1-%') AS p FROM filled GROUP BY 1, 2, 3), g AS (SELECT country, src AS provenance, count(DISTINCT state) AS buckets, sum(q)::BIGINT AS queries, sum(p)::BIGINT AS pool, sum(q * p)::BIGINT AS pairs FROM p GROUP BY 1, 2) SELECT *, round(pairs / nullif(sum(pairs) OVER (PARTITION BY country), 0), 9) AS share FROM g",
    "slice_by_hash": f"WITH {relational.records(relational.DUCK)} SELECT entity_id, ({_MD5.format('entity_id')} % 7)::INT AS slice FROM biz",
    "dedupe_keep_first": _S + " SELECT s1, cand, score AS p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS r FROM hits) WHERE r = 1",
    "equal_sets_assert": "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_partkey % 2 = 1), b AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS missing, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS extra",
    "disjoint_assert": "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "search_piece": _S + f" SELECT s1, cand, score, rank, ({_MD5.format('s1')} % 4)::INT AS piece FROM hits",
    "concat_parts_sink": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "read_schema": "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type FROM (DESCRIBE SELECT * FROM orders)",
    "validate_lists": f"""WITH {_FAULTY}, flat AS (SELECT s1, x AS cand FROM (SELECT s1, unnest(string_split(ids, ',')) AS x FROM lists) WHERE x <> ''), every AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS e FROM documents)
SELECT 'duplicate_rows' AS finding, count(*) AS n FROM (SELECT s1 FROM lists GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT s1, cand FROM flat GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'self_ids', count(*) FROM flat WHERE cand LIKE 'S1-%'
UNION ALL SELECT 'wrong_prefix', count(*) FROM flat WHERE NOT regexp_matches(cand, '^S[123]-')
UNION ALL SELECT 'unknown_ids', count(*) FROM flat WHERE cand NOT IN (SELECT e FROM every WHERE e NOT LIKE 'S1-%')
UNION ALL SELECT 'missing_s1', count(*) FROM every WHERE e LIKE 'S1-%' AND e NOT IN (SELECT s1 FROM lists)
UNION ALL SELECT 'extra_s1', count(*) FROM lists WHERE s1 NOT IN (SELECT e FROM every WHERE e LIKE 'S1-%')""",
    "validate_file": f"""WITH {_FAULTY}, {_LINES}, c AS (SELECT line, string_split(line, chr(9)) AS l FROM lines)
SELECT 'header' AS finding, 0::BIGINT AS n UNION ALL SELECT 'columns', count(*) FROM c WHERE len(l) <> 2 UNION ALL SELECT 'quoted', count(*) FROM c WHERE contains(line, chr(34))
UNION ALL SELECT 'blanks', count(*) FROM c WHERE len(list_filter(l, lambda x: x <> trim(x) OR contains(x, ' ,') OR contains(x, ', '))) > 0""",
    "calibration": _S + _T + " SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 9) AS mean_p, round(avg(CASE WHEN t.s1 IS NULL THEN 0.0 ELSE 1.0 END), 9) AS rate FROM hits LEFT JOIN t ON t.s1 = hits.s1 AND t.cand = hits.cand GROUP BY 1",
    "error_bands": _ERRORS + " SELECT kind, CASE WHEN p IS NULL THEN 'none' WHEN p < 0.5 THEN 'low' WHEN p < 0.8 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM e GROUP BY 1, 2",
    "error_groups": _ERRORS + " SELECT a.country, kind, a.core_name = b.core_name AS same_name, a.state = b.state AS same_state, count(*) AS n FROM e JOIN biz a ON a.entity_id = e.s1 JOIN biz b ON b.entity_id = e.cand GROUP BY 1, 2, 3, 4",
    "group_recall": _S + _T + """, x AS (SELECT a.country, h.s1 IS NOT NULL AS f, list_filter(['all', CASE WHEN a.state IS NULL OR b.state IS NULL THEN 'stateless' END, CASE WHEN a.state <> b.state THEN 'moved' END, CASE WHEN t.cand LIKE 'S3-%' THEN 'third' END], lambda g: g IS NOT NULL) AS g
  FROM t JOIN biz a ON a.entity_id = t.s1 JOIN biz b ON b.entity_id = t.cand LEFT JOIN hits h ON h.s1 = t.s1 AND h.cand = t.cand)
SELECT country, grp, count(*) AS pairs, count(*) FILTER (WHERE f) AS found FROM (SELECT country, f, unnest(g) AS grp FROM x) GROUP BY 1, 2""",
    "stress_methods": _S + _T + f""", x AS (SELECT entity_id AS id, country, unnest({relational.DUCK.tokens('core_name')}) AS t FROM biz), rt AS (SELECT country, t FROM x GROUP BY 1, 2 HAVING count(*) <= 20 AND len(t) >= 3), y AS (SELECT x.* FROM x JOIN rt USING (country, t)),
s AS (SELECT a.id AS s1, b.id AS cand, count(*) AS score FROM y a JOIN y b ON a.country = b.country AND a.t = b.t WHERE a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%' GROUP BY 1, 2),
meth AS (SELECT 'forward' AS method, s1, cand FROM hits UNION ALL SELECT 'reverse', s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS r FROM score WHERE score > 0) WHERE r <= 3
  UNION ALL SELECT 'rare', s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS r FROM s) WHERE r <= 10),
tp AS (SELECT t.s1, t.cand, CASE WHEN a.core_name = b.core_name THEN 'equal' WHEN list_has_any(string_split(a.core_name, ' '), string_split(b.core_name, ' ')) THEN 'word' ELSE 'none' END AS grp FROM t JOIN biz a ON a.entity_id = t.s1 JOIN biz b ON b.entity_id = t.cand),
g AS (SELECT method, grp, pairs FROM (SELECT DISTINCT method FROM meth), (SELECT grp, count(*) AS pairs FROM tp GROUP BY 1))
SELECT g.method, g.grp, g.pairs, count(m.s1) AS found FROM g LEFT JOIN tp ON tp.grp = g.grp LEFT JOIN meth m ON m.method = g.method AND m.s1 = tp.s1 AND m.cand = tp.cand GROUP BY 1, 2, 3""",
    "pruned_grid": _S + _T + f""", r AS (SELECT h.score AS p, row_number() OVER (PARTITION BY h.s1 ORDER BY h.score DESC, h.cand) AS place, t.s1 IS NOT NULL AS hit FROM hits h LEFT JOIN t ON t.s1 = h.s1 AND t.cand = h.cand),
grid AS (SELECT tau::DOUBLE AS tau, cap::INT AS cap FROM (VALUES {', '.join(f'({x})' for x in candidates.PRUNE_TAUS)}) a(tau), (VALUES {', '.join(f'({x or "NULL"})' for x in candidates.PRUNE_CAPS)}) b(cap))
SELECT tau, cap, count(r.p) AS n, count(*) FILTER (WHERE hit) AS hits, round(count(r.p) / (SELECT count(*) FROM biz WHERE entity_id LIKE 'S1-%'), 9) AS avg_size, round(count(*) FILTER (WHERE hit) / (SELECT count(*) FROM t), 9) AS recall
FROM grid LEFT JOIN r ON r.p >= tau AND (cap IS NULL OR place <= cap) GROUP BY 1, 2""",
}
