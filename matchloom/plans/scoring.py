"""Queries of scoring, selection protocols, reports and files over the record view, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import number_tokens, transliterate
from matchloom.operators import candidates, effectiveness, features, models, normalise, pair_extra, selection
from matchloom.plans import matching, relational
from matchloom.plans.matching import _hits, _records, _s1s, _scored, _truth, _wide
from matchloom.session import scratch, table, written
from matchloom.sources import files, lists

#: Least sure score in the driver's tables, whose search scores stand in for probabilities.
_TAUS, _MARGINS = [0.4, 0.5, 0.6, 0.7, 0.8], [0.1, 0.3, 1.0]


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("s1", "cand", F.col("score").alias("s_p1"))


# Features
def list_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_extra.list_features(_p1(spark, sf_dir)).withColumn("s_gap", F.round("s_gap", 6))


def rival_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_extra.rival_features(written(_p1(spark, sf_dir), "scored")).withColumn("x_lead", F.round("x_lead", 6))


def _plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("entity_id", "country", "state", "core_name", F.col("core_name").alias("nolegal"), F.col("core_name").alias("full_name"), F.lit("").alias("legal"), F.col("business_address").alias("addr_norm"), number_tokens(F.coalesce("business_address", F.lit(""))).alias("numbers"))


def word_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word features of all true pairs."""
    records = _plain_records(spark, sf_dir)
    pairs = features.joined(_truth(spark, sf_dir), records, ["country", "nolegal"])
    out = pair_extra.word_difference(pairs, pair_extra.extra_counts(records)[0])
    return out.select("s1", "cand", "b1_n_diff", "b1_n_desc_diff", "b1_n_other_diff", F.round("b1_idf_diff", 6).alias("b1_idf_diff"), F.round("b1_idf_diff_max", 6).alias("b1_idf_diff_max"))


def extra_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All b features of the pairs that the search finds."""
    records = written(features.prepare(matching.normalised_records(spark, sf_dir)).select("entity_id", *pair_extra.RECORD), "records")
    return pair_extra.extra_features(written(_hits(spark, sf_dir).select("s1", "cand"), "pairs"), records)


def set_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_extra.set_features(written(_p1(spark, sf_dir), "scored"), _plain_records(spark, sf_dir))


def count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, distinct words and distinct names of each country, and its most frequent word's count."""
    total, df, names = features.count_stats(_records(spark, sf_dir))
    words = df.groupBy("country").agg(F.count(F.lit(1)).alias("words"), F.max("df").alias("top_df"))
    return total.join(words, "country").join(names.groupBy("country").agg(F.count(F.lit(1)).alias("names"), F.sum("n_s1").alias("n_s1")), "country")


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by how many share their name in their country and state."""
    return pair_extra.extra_counts(_plain_records(spark, sf_dir))[1].select("country", "state", "core_name", "n_name")


# Selection
def select_tau2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bar for pairs whose texts are of one state and whose queries are even: stand-ins for look-alikes."""
    r = _records(spark, sf_dir)
    scored = _scored(spark, sf_dir).join(r.select(F.col("entity_id").alias("s1"), F.col("state").alias("qs")), "s1").join(r.select(F.col("entity_id").alias("cand"), F.col("state").alias("ps")), "cand")
    scored = scored.withColumns({"s_sim_name": F.coalesce(F.col("qs") == F.col("ps"), F.lit(False)).cast("double"), "s_num_eq": 1 - selection.half()})
    return selection.select(scored, 0.6, 0.3, tau2=0.3).select("s1", "cand", "p")


def select_unseen_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).join(_s1s(spark, sf_dir), "s1")
    return selection.select_unseen(scored, 0.5, 0.3, 0.1, ["US", "France"]).select("s1", "cand", "p")


def per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.select(_scored(spark, sf_dir), 0.5, 0.3)
    out = selection.f05_table(chosen, _truth(spark, sf_dir), _s1s(spark, sf_dir))
    return out.select("s1", "tp", "n_pred", "n_true", F.round("f05", 9).alias("f05"))


def tune_report_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.tune_and_report(written(_scored(spark, sf_dir), "scored"), _truth(spark, sf_dir), _s1s(spark, sf_dir).select("s1"), _TAUS, _MARGINS)
    return out.select("tau", "margin", F.round("f05_tune", 9).alias("f05_tune"), F.round("f05_report", 9).alias("f05_report"))


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 496 candidate rules in one pass over the wide list."""
    out = candidates.grid_stats(written(_wide(spark, sf_dir), "wide"), _truth(spark, sf_dir), _s1s(spark, sf_dir), candidates.settings())
    return out.select("config", "n", "hits", F.round("avg_size", 9).alias("avg_size"), F.round("recall", 9).alias("recall"))


def search_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for one query in four: the same rows as in a whole search."""
    s1, pool = matching._sides()
    return matching.blocking.search_forward(matching._texts(spark, sf_dir), s1 & (selection.half("id") == 0), pool, 5, max_df=0.2)


# Scores
def ce_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.sieve(_hits(spark, sf_dir).select("s1", "cand", "score"), "score")


def ce_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search scores mixed with their squares where they are not sure."""
    p = F.col("score")
    return _hits(spark, sf_dir).select("s1", "cand", F.round(models.ce_blend(p, p * p, 0.65), 9).alias("p"))


def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank of quality scores by length and by id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 97 / 97.0).alias("a"), (F.col("vec_id") % 89 / 89.0).alias("b"))
    return models.blend(rows, "a", "b", "rank").select("vec_id", F.round("p", 9).alias("p"))


def ce_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold on even queries for each weight of the second score, with its value there."""
    scored = written(_hits(spark, sf_dir).select("s1", "cand", "score"), "scored").where(selection.half() == 0)
    truth, s1s = _truth(spark, sf_dir).where(selection.half() == 0), _s1s(spark, sf_dir).where(selection.half() == 0).select("s1")
    weights = F.inline(F.array(*[F.struct(F.lit(w).alias("w")) for w in (0.0, 0.5, 1.0)]))
    p = F.col("score")
    rows = scored.select("*", weights).withColumn("p", F.round(models.ce_blend(p, p * p, F.col("w")), 9))
    # A weight is part of the ids, so that one tuning serves all.
    key = lambda c: F.concat_ws("@", c, F.col("w").cast("string")).alias(c)
    every = lambda df, *cs: df.select("*", weights).select("w", *[key(c) for c in cs])
    tuned = selection.tune_by(rows.select("w", key("s1"), key("cand"), "p"), every(truth, "s1", "cand").drop("w"), every(s1s, "s1"), _TAUS, [0.3], "w")
    best = tuned.groupBy("w").agg(F.min(F.struct((-F.round("f05", 9)).alias("f"), "tau")).alias("b"))
    return best.select("w", F.col("b.tau").alias("tau"), (-F.col("b.f")).alias("f05"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _truth(spark, sf_dir).withColumn("y", F.lit(1))
    rows = written(_hits(spark, sf_dir).select("s1", "cand").join(truth, ["s1", "cand"], "left").fillna(0, ["y"]), "rows")
    return candidates.training_sample(rows, "y", 500).select("s1", "cand", "y")


def pruner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees over the wide list, trained on even queries with the rest of them held out to stop early, scoring all rows."""
    truth = _truth(spark, sf_dir).withColumn("y", F.lit(1))
    wide = written(_wide(spark, sf_dir).join(truth, ["s1", "cand"], "left").fillna(0, ["y"]), "wide")
    columns = [*[f"{c}_{m}" for m in candidates.FORWARD for c in ("score", "rank")], "score_reverse", "rank_reverse", "score_rare", "rank_rare", "order"]
    rows = candidates.training_sample(wide.where(selection.half() == 0), "y", 100_000).withColumn("stop", models.fold_of(F.col("s1"), 10) == 0)
    model = models.train(rows, columns, "y", rounds=10, depth=4, held_out="stop")
    return models.predict(model, wide.select("s1", "cand", *columns), columns, "p_keep").select("s1", "cand", "p_keep")


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second score of the pairs that the sieve lets through, learned from the texts of even queries' pairs."""
    r = _records(spark, sf_dir).select("entity_id", F.concat_ws(" | ", "core_name", F.coalesce("business_address", F.lit("")), F.coalesce("country", F.lit(""))).alias("text"))
    rows = candidates.sieve(_hits(spark, sf_dir).select("s1", "cand", "score"), "score").join(_truth(spark, sf_dir).withColumn("y", F.lit(1)), ["s1", "cand"], "left").fillna(0, ["y"])
    rows = written(rows.join(r.toDF("s1", "text_1"), "s1").join(r.toDF("cand", "text_2"), "cand"), "texts")
    return models.TextScorer().fit(rows.where(selection.half() == 0), "y").score(rows).select("s1", "cand", "p_ce")


# Reports
def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, pool and truth, written once as all are read several times."""
    r = written(_records(spark, sf_dir).where("core_name <> ''").select(F.col("entity_id").alias("id"), "country", F.col("core_name").alias("text")), "records")
    return r.where(F.col("id").startswith("S1-")), r.where(~F.col("id").startswith("S1-")), written(_truth(spark, sf_dir), "truth")


def effectiveness_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of both similarities of names: true pairs against the hardest others."""
    rows = written(effectiveness.compare(*_names(spark, sf_dir), max_df=0.2), "compared")
    one = lambda c: effectiveness.auc(rows, ["country"], c, "is_true").select("country", F.col("auc").alias(f"auc_{c}"))
    return one("tsr").join(one("jac3"), "country")


def eda_similarity_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effectiveness.summary(effectiveness.compare(*_names(spark, sf_dir), max_df=0.2))


def eda_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effectiveness.hardest(*_names(spark, sf_dir), max_df=0.2)


def _alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select("entity_id", "country", "business_address")
    pairs = _truth(spark, sf_dir).join(r.toDF("s1", "country", "addr_1"), "s1").join(r.drop("country").toDF("cand", "addr_2"), "cand")
    return pairs.select(F.concat_ws("|", "s1", "cand").alias("pair_id"), "country", "addr_1", "addr_2")


def learn_state_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.learn_state_aliases(written(_alias_pairs(spark, sf_dir), "pairs"))


def alias_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(_alias_pairs(spark, sf_dir), "pairs")
    return normalise.alias_diagnostics(pairs, written(normalise.learn_state_aliases(pairs), "aliases"))


def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", transliterate(F.split("text", "\n")[0]).alias("head"))


def transliterated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; transliterated has first lines only, as its DuckDB twin."""
    return table(spark, sf_dir, "documents").select("doc_id", transliterate(F.col("text")).alias("text"))


def legal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with a legal form behind, taken apart."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("Pvt. Ltd.", "L.L.C.", "SARL", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    country = F.element_at(F.array(*[F.lit(x) for x in ("India", "US", "France", "US")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Zorbex "), F.col("p_partkey").cast("string"), F.lit("  "), form).alias("business_name"), country.alias("country"))
    return normalise.names(rows).select("p_partkey", "full_name", "core_name", "legal")


# Files
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, written as TSV and read back as strings."""
    path = scratch(spark, "customers")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    lists.write_tsv(rows, path)
    return lists.read_tsv(spark, path, rows.columns)


def write_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both result files, written, checked and read back side by side."""
    path, found = scratch(spark, "results"), written(_scored(spark, sf_dir), "scored")
    s1s = _s1s(spark, sf_dir)
    lists.write_results(selection.select(found, 0.5, 0.3), found, s1s, path, "p")
    one = lambda kind, header: lists.read_tsv(spark, f"{path}/{kind}", list(header))
    return one("matches", lists.MATCHES).join(one("candidates", lists.CANDIDATES), "source1_entity_id")


def read_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the orders, from a footer."""
    return spark.createDataFrame(list(files.schema(spark, f"{sf_dir}/orders.parquet").items()), "name string, type string").select("name")


def find_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that holds the regions, found by name."""
    path = files.find(spark, sf_dir, "region.parquet")
    return spark.read.parquet(path).select("r_regionkey", "r_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        list_features, rival_features, word_difference, extra_features, set_features, count_stats, country_counts, select_tau2, select_unseen_shift, per_entity, tune_report_protocol,
        config_grid, search_piece, ce_sieve, ce_blend, blend, ce_grid, training_rows, pruner_scores, text_scores, effectiveness_auc, eda_similarity_dist, eda_hard_negatives,
        learn_state_aliases, alias_diagnostics, transliterated, transliterated_text, legal_names, scan_tsv, write_submission, read_schema, find_file,
    )
}

_S = matching._SEARCH
_DUCK = relational.DUCK
_BIZ = f"WITH {relational.records(_DUCK)}"
_T = ", t AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM truth JOIN biz a ON a.doc_id = q JOIN biz b ON b.doc_id = c)"
_F05 = "CASE WHEN nt = 0 AND np = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END::DOUBLE"
_EVEN = "CAST(regexp_extract({}, '[0-9]+$') AS BIGINT) % 2"


def _macro(scored: str, grid: str, keys: str) -> str:
    """Macro F0.5 of every setting of a grid (tau, margin, ...) over scored (s1, cand, p, and what else keys has) on both halves."""
    k = [c for c in keys.split(", ")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    return f"""{_T}, grid AS ({grid}), one AS (SELECT * FROM (SELECT h.s1, h.cand, h.p, {', '.join('g.' + c for c in k)}, {_EVEN.format('h.s1')} AS half, row_number() OVER (PARTITION BY {', '.join('g.' + c for c in k)}, {_EVEN.format('h.s1')}, h.cand ORDER BY h.p DESC, h.s1) AS o FROM ({scored}) h, grid g WHERE h.p >= g.tau{' AND h.w = g.w' if 'w' in k else ''}) WHERE o = 1),
kept AS (SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY {keys}, s1) AS best FROM one) WHERE p >= best - margin),
k AS (SELECT {', '.join('kept.' + c for c in k)}, kept.s1, count(t.cand) AS tp, count(*) AS np FROM kept LEFT JOIN t ON t.s1 = kept.s1 AND t.cand = kept.cand GROUP BY ALL),
wanted AS (SELECT s1, count(*) AS nt FROM t GROUP BY 1),
f AS (SELECT {', '.join('g.' + c for c in k)}, {_EVEN.format('b.entity_id')} AS half, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM biz b CROSS JOIN grid g LEFT JOIN k ON k.s1 = b.entity_id AND {on('k', 'g')} LEFT JOIN wanted ON wanted.s1 = b.entity_id WHERE b.entity_id LIKE 'S1-%'),
m AS (SELECT {keys}, half, round(avg({_F05}), 9) AS f05 FROM f GROUP BY ALL)"""


_PAIRS = " FROM (VALUES (0.4), (0.5), (0.6), (0.7), (0.8)) x(tau), (VALUES (0.1), (0.3), (1.0)) y(margin)"
_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(pair_extra.DESCRIPTORS))

ORACLES: dict[str, str] = {
    "list_features": _S + " SELECT s1, cand, score AS s_p1, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS s_rank, round(max(score) OVER (PARTITION BY s1) - score, 6) AS s_gap, count(*) FILTER (WHERE score > 0.5) OVER (PARTITION BY s1) AS s_n05, count(*) FILTER (WHERE score > 0.9) OVER (PARTITION BY s1) AS s_n09 FROM hits",
    "rival_features": _S + " SELECT a.s1, a.cand, a.score AS s_p1, coalesce(max(b.score), 0) AS x_p_other, count(*) FILTER (WHERE b.score > 0.5) AS x_n_other05, round(a.score - coalesce(max(b.score), 0), 6) AS x_lead FROM hits a LEFT JOIN hits b ON a.cand = b.cand AND a.s1 <> b.s1 GROUP BY 1, 2, 3",
    "word_difference": f"""{_BIZ}{_T}, x AS (SELECT entity_id AS id, country, {_DUCK.tokens('core_name')} AS ts FROM biz), n AS (SELECT country, count(*) AS n FROM biz GROUP BY 1),
idf AS (SELECT country, w, ln(n / df) AS idf FROM (SELECT country, w, count(*) AS df FROM (SELECT country, unnest(ts) AS w FROM x) GROUP BY 1, 2) JOIN n USING (country)),
d AS (SELECT t.s1, t.cand, a.country, list_concat(list_filter(a.ts, lambda z: NOT list_contains(b.ts, z)), list_filter(b.ts, lambda z: NOT list_contains(a.ts, z))) AS diff FROM t JOIN x a ON a.id = t.s1 JOIN x b ON b.id = t.cand),
o AS (SELECT *, list_filter(diff, lambda z: NOT list_contains([{_WORDS}], z)) AS other FROM d),
e AS (SELECT s1, cand, sum(idf) AS s, max(idf) AS m FROM (SELECT s1, cand, country, unnest(other) AS w FROM o) JOIN idf USING (country, w) GROUP BY 1, 2)
SELECT o.s1, o.cand, len(diff)::DOUBLE AS b1_n_diff, (len(diff) - len(other))::DOUBLE AS b1_n_desc_diff, len(other)::DOUBLE AS b1_n_other_diff, round(coalesce(s, 0), 6) AS b1_idf_diff, round(coalesce(m, 0), 6) AS b1_idf_diff_max FROM o LEFT JOIN e ON e.s1 = o.s1 AND e.cand = o.cand""",
    "count_stats": f"""{_BIZ}, w AS (SELECT country, t, count(*) AS df FROM (SELECT country, unnest({_DUCK.tokens('core_name')}) AS t FROM biz) GROUP BY 1, 2)
SELECT b.country, b.n, w.words, w.top_df, b.names, b.n_s1 FROM (SELECT country, count(*) AS n, count(DISTINCT core_name) AS names, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_s1 FROM biz GROUP BY 1) b JOIN (SELECT country, count(*) AS words, max(df) AS top_df FROM w GROUP BY 1) w ON w.country = b.country""",
    "country_counts": f"{_BIZ} SELECT coalesce(country, '') AS country, coalesce(state, '') AS state, core_name, count(*) AS n_name FROM biz WHERE core_name <> '' GROUP BY 1, 2, 3",
    "select_tau2": _S + f""", bar AS (SELECT h.s1, h.cand, h.score FROM hits h JOIN biz a ON a.entity_id = h.s1 JOIN biz b ON b.entity_id = h.cand WHERE h.score >= 0.6 OR (h.score >= 0.3 AND a.state = b.state AND {_EVEN.format('h.s1')} = 0)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS r FROM bar) WHERE r = 1)
SELECT s1, cand, score AS p FROM (SELECT *, max(score) OVER (PARTITION BY s1) AS best FROM one) WHERE score >= best - 0.3""",
    "select_unseen_shift": _S + """, bar AS (SELECT h.* FROM hits h JOIN biz b ON b.entity_id = h.s1 WHERE h.score >= CASE WHEN b.country IN ('US', 'France') THEN 0.5 ELSE 0.6 END),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) AS r FROM bar) WHERE r = 1)
SELECT s1, cand, score AS p FROM (SELECT *, max(score) OVER (PARTITION BY s1) AS best FROM one) WHERE score >= best - 0.3""",
    "per_entity": _S + matching._CHOSEN + _T + f""", k AS (SELECT c.s1, count(t.cand) AS tp, count(*) AS np FROM chosen c LEFT JOIN t ON t.s1 = c.s1 AND t.cand = c.cand GROUP BY 1), w AS (SELECT s1, count(*) AS nt FROM t GROUP BY 1),
e AS (SELECT entity_id AS s1, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM biz LEFT JOIN k ON k.s1 = entity_id LEFT JOIN w ON w.s1 = entity_id WHERE entity_id LIKE 'S1-%')
SELECT s1, tp, np AS n_pred, nt AS n_true, round({_F05}, 9) AS f05 FROM e""",
    "tune_report_protocol": _S + _macro("SELECT s1, cand, score AS p FROM hits", f"SELECT tau::DOUBLE AS tau, margin::DOUBLE AS margin{_PAIRS}", "tau, margin") + ", best AS (SELECT * FROM m WHERE half = 0 ORDER BY f05 DESC, tau, margin LIMIT 1) SELECT best.tau, best.margin, best.f05 AS f05_tune, m.f05 AS f05_report FROM best JOIN m ON m.half = 1 AND m.tau = best.tau AND m.margin = best.margin",
    "ce_grid": _S + _macro(
        "SELECT s1, cand, w, round(CASE WHEN score > 0.02 AND score < 0.98 THEN (1 - w) * score + w * score * score ELSE score END, 9) AS p FROM hits, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(w)",
        f"SELECT w, tau::DOUBLE AS tau, margin::DOUBLE AS margin{_PAIRS}, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) z(w) WHERE margin = 0.3", "w, tau, margin",
    ) + " SELECT w, tau, f05 FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY f05 DESC, tau) AS r FROM m WHERE half = 0) WHERE r = 1",
    "search_piece": _S + f" SELECT s1, cand, score, rank FROM hits WHERE {_EVEN.format('s1')} = 0",
    "ce_sieve": _S + " SELECT s1, cand, score FROM (SELECT *, rank() OVER (PARTITION BY s1 ORDER BY score DESC) + (count(*) OVER (PARTITION BY s1, score) - 1) / 2.0 AS r FROM (SELECT s1, cand, score FROM hits)) WHERE r <= 3 OR score >= 0.4",
    "ce_blend": _S + " SELECT s1, cand, round(CASE WHEN score > 0.02 AND score < 0.98 THEN 0.35 * score + 0.65 * (score * score) ELSE score END, 9) AS p FROM hits",
    "blend": "WITH x AS (SELECT vec_id, vec_id % 97 AS a, vec_id % 89 AS b, count(*) OVER () AS n FROM embeddings) SELECT vec_id, round((rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 + rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / (2.0 * n), 9) AS p FROM x",
    "training_rows": _S + _T + """, r AS (SELECT h.s1, h.cand, CASE WHEN t.s1 IS NULL THEN 0 ELSE 1 END AS y FROM hits h LEFT JOIN t ON t.s1 = h.s1 AND t.cand = h.cand), c AS (SELECT count(*) AS n, sum(y) AS pos FROM r)
SELECT s1, cand, y FROM r, c WHERE y = 1 OR n <= 500 OR CAST(concat('0x', substring(md5(concat(s1, '|', cand)), 1, 8)) AS BIGINT) < floor(greatest(500 - pos, 0) / (n - pos) * 4294967296)""",
    "legal_names": "SELECT p_partkey, concat('zorbex ', p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' pvt ltd' WHEN 1 THEN ' llc' WHEN 2 THEN ' sarl' ELSE '' END) AS full_name, concat('zorbex ', p_partkey) AS core_name, CASE p_partkey % 4 WHEN 0 THEN 'pvt ltd' WHEN 1 THEN 'llc' WHEN 2 THEN 'sarl' ELSE '' END AS legal FROM part",
    "transliterated": "SELECT doc_id, replace(replace(replace(strip_accents(coalesce(string_split(text, chr(10))[1], '')), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS head FROM documents",
    "scan_tsv": "SELECT CAST(c_custkey AS STRING) AS c_custkey, coalesce(c_name, '') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment FROM customer",
    "write_submission": _S + matching._CHOSEN + ", c AS (SELECT s1, string_agg(cand, ',' ORDER BY score DESC, cand) AS ids FROM hits GROUP BY 1), m AS (SELECT s1, string_agg(cand, ',' ORDER BY score DESC, cand) AS ids FROM chosen GROUP BY 1) SELECT entity_id AS source1_entity_id, coalesce(m.ids, '') AS matched_entity_ids, coalesce(c.ids, '') AS candidate_entity_ids FROM biz LEFT JOIN m ON m.s1 = entity_id LEFT JOIN c ON c.s1 = entity_id WHERE entity_id LIKE 'S1-%'",
    "read_schema": "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM orders)",
    "find_file": "SELECT r_regionkey, r_name FROM region",
}
