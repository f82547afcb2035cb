"""Pair features: similarities of names and addresses, rare words, numbers, blocking and list context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions import rules, similarity
from matchloom.functions.text import by_country, country_key, grams3, jaccard, lookup, same, tokens
from matchloom.session import written

METHODS = ("name", "name_city", "name_addr", "reverse", "rare")
SCORED, FORWARD = METHODS[:4], METHODS[:3]
RARE_DF, RARE_LEN = 20, 3
#: Features whose value is held against the best other member of the list.
CONTEXT = ("f_name_core_tsr", "f_name_core_ratio", "f_name_idf_jacc", "f_addr_tsr", "f_addr_c3_jacc", "f_num_jacc")


def prepare(records: DataFrame) -> DataFrame:
    """Adds nolegal (full_name without legal words anywhere; core_name if nothing is left) and legal_any (sorted canonical legal words)."""
    key = country_key(F.col("country"))
    table = lambda c: {k: v for k, v in rules.LEGAL.get(c, rules.LEGAL[""]).items() if k not in rules.LEGAL_TRAILING_ONLY}
    words = F.filter(F.split("full_name", " "), lambda t: t != "")
    rest = by_country(key, lambda c: F.array_join(F.filter(words, lambda t: lookup(table(c), t).isNull()), " "))
    legal = by_country(key, lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda t: lookup(table(c), t)), lambda t: t.isNotNull()))), " "))
    return records.withColumn("nolegal", F.when(rest == "", F.col("core_name")).otherwise(rest)).withColumn("legal_any", legal)


def count_stats(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(country, n); (country, t, df) of core-name tokens; (country, core_name, n_s1, n_pool)."""
    total = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = records.select("country", F.explode(tokens(F.col("core_name"))).alias("t")).groupBy("country", "t").agg(F.count(F.lit(1)).alias("df"))
    s1 = F.col("entity_id").startswith("S1-").cast("long")
    return total, df, records.groupBy("country", "core_name").agg(F.sum(s1).alias("n_s1"), F.sum(1 - s1).alias("n_pool"))


def joined(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with q_<column> of the query and p_<column> of the candidate."""
    side = lambda on, mark: records.select(F.col("entity_id").alias(on), *[F.col(c).alias(f"{mark}_{c}") for c in columns])
    return pairs.join(side("s1", "q"), "s1").join(side("cand", "p"), "cand")


def name_features(df: DataFrame) -> DataFrame:
    """Six similarities of three forms of the name, first and last words, one-sided words, length and containment."""
    out = {}
    for form, column in (("full", "full_name"), ("core", "core_name"), ("nolegal", "nolegal")):
        a, b = F.col(f"q_{column}"), F.col(f"p_{column}")
        for name, udf in (("ratio", similarity.sim_ratio), ("tsr", similarity.sim_token_set), ("tsort", similarity.sim_token_sort), ("jw", similarity.sim_jaro_winkler)):
            out[f"f_name_{form}_{name}"] = udf(a, b)
        out[f"f_name_{form}_tok_jacc"], out[f"f_name_{form}_c3_jacc"] = jaccard(tokens(a), tokens(b)), jaccard(grams3(a), grams3(b))
    a, b = F.col("q_core_name"), F.col("p_core_name")
    x, y = tokens(a), tokens(b)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    out |= {
        "f_name_core_partial": similarity.sim_partial(a, b), "f_name_first_eq": (F.try_element_at(x, F.lit(1)) == F.try_element_at(y, F.lit(1))).cast("double"),
        "f_name_last_eq": (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))).cast("double"), "f_name_only_s1": F.size(F.array_except(x, y)).cast("double"),
        "f_name_only_cand": F.size(F.array_except(y, x)).cast("double"), "f_name_len_diff": F.abs(F.length(a) - F.length(b)).cast("double"),
        "f_name_contains": (F.contains(pad(a), pad(b)) | F.contains(pad(b), pad(a))).cast("double"),
    }
    return df.withColumns(out)


def idf_features(df: DataFrame, total: DataFrame, frequency: DataFrame) -> DataFrame:
    """Weighted overlap of core-name words, w = ln((n + 1) / (df + 1)), and rare words. One row a pair and word, joined to frequencies and summed."""
    x, y = tokens(F.col("q_core_name")), tokens(F.col("p_core_name"))
    each = df.select("s1", "cand", F.col("q_country").alias("country"), x.alias("x"), y.alias("y"), F.explode_outer(F.array_union(x, y)).alias("t"))
    each = each.join(frequency, ["country", "t"], "left").join(total, "country", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w, top = F.log((F.col("n") + 1) / (F.col("df") + 1)), F.log(F.first("n") + 1)
    each = each.withColumns({"w": w, "inx": F.array_contains("x", F.col("t")), "iny": F.array_contains("y", F.col("t")), "rare": (F.col("df") <= RARE_DF) & (F.length("t") >= RARE_LEN)})
    both, total_w = F.sum(F.when(F.col("inx") & F.col("iny"), F.col("w")).otherwise(0.0)), F.sum("w")
    n = lambda c: F.count_if(c).cast("double")
    per = each.groupBy("s1", "cand").agg(
        F.when(total_w > 0, both / total_w).otherwise(1.0).alias("f_name_idf_jacc"), F.coalesce(F.max(F.when(F.col("inx") != F.col("iny"), F.col("w"))) / top, F.lit(0.0)).alias("f_name_idf_max_diff"),
        n(F.col("rare") & F.col("inx") & F.col("iny")).alias("f_rare_shared"), n(F.col("rare") & F.col("inx") & ~F.col("iny")).alias("f_rare_only_s1"),
        n(F.col("rare") & ~F.col("inx") & F.col("iny")).alias("f_rare_only_cand"), F.coalesce(F.max(F.when(F.col("rare") & F.col("inx") & F.col("iny"), F.col("w"))) / top, F.lit(0.0)).alias("f_rare_shared_idf"),
    )
    return df.join(per, ["s1", "cand"])


def other_features(df: DataFrame) -> DataFrame:
    """Legal forms, addresses, places and numbers."""
    out = {}
    for column in ("legal", "legal_any"):
        a, b = F.col(f"q_{column}"), F.col(f"p_{column}")
        out |= {f"f_{column}_both_missing": ((a == "") & (b == "")).cast("double"), f"f_{column}_one_missing": ((a == "") != (b == "")).cast("double"), f"f_{column}_same": same(a, b)}
    out["f_legal_tok_jacc"] = jaccard(tokens(F.col("q_legal")), tokens(F.col("p_legal")))
    a, b = (F.trim(F.regexp_replace(F.replace(F.col(f"{s}_addr_norm"), F.lit(","), F.lit(" ")), " +", " ")) for s in "qp")
    out |= {"f_addr_missing": ((a == "") | (b == "")).cast("double"), "f_addr_tok_jacc": jaccard(tokens(a), tokens(b)), "f_addr_c3_jacc": jaccard(grams3(a), grams3(b))}
    for name, udf in (("ratio", similarity.sim_ratio), ("tsr", similarity.sim_token_set), ("tsort", similarity.sim_token_sort), ("partial", similarity.sim_partial)):
        out[f"f_addr_{name}"] = udf(a, b)
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    inside = lambda city, addr: F.when((F.col(city) != "") & (addr != ""), F.contains(pad(addr), pad(F.col(city))))
    out |= {
        "f_city_same": same(F.col("q_city"), F.col("p_city")), "f_city_ratio": similarity.sim_ratio(F.col("q_city"), F.col("p_city")), "f_state_agree": same(F.col("q_state"), F.col("p_state")),
        "f_city_in_addr": F.greatest(inside("q_city", b).cast("double"), inside("p_city", a).cast("double")),
    }
    x, y = F.col("q_numbers"), F.col("p_numbers")
    ready = lambda c: F.when((F.size(x) > 0) & (F.size(y) > 0), c.cast("double"))
    out |= {
        "f_num_n_s1": F.size(x).cast("double"), "f_num_n_cand": F.size(y).cast("double"), "f_num_shared": ready(F.size(F.array_intersect(x, y))), "f_num_only_s1": ready(F.size(F.array_except(x, y))),
        "f_num_only_cand": ready(F.size(F.array_except(y, x))), "f_num_jacc": jaccard(x, y), "f_num_first_eq": ready(F.get(x, F.lit(0)) == F.get(y, F.lit(0))),
        "f_num_last_eq": ready(F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))),
    }
    return df.withColumns(out)


def frequency_features(df: DataFrame, names: DataFrame) -> DataFrame:
    """Logarithms of how often the names occur in their country."""
    side = lambda mark: names.toDF("q_country", f"{mark}_core_name", f"_{mark}_s1", f"_{mark}_pool")
    out = df.join(side("q"), ["q_country", "q_core_name"], "left").join(side("p"), ["q_country", "p_core_name"], "left")
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)))
    return out.withColumns({"f_freq_s1_name_in_s1": log("_q_s1"), "f_freq_s1_name_in_pool": log("_q_pool"), "f_freq_cand_name_in_pool": log("_p_pool")}).drop("_q_s1", "_q_pool", "_p_s1", "_p_pool")


def best_other(value: str, by: str) -> Column:
    """The largest value among the other members of the group; null for a single one."""
    group = Window.partitionBy(by)
    best, ties = F.max(value).over(group), F.count(F.col(value)).over(Window.partitionBy(by, value))
    second = F.max(F.when(F.col(value) < F.col(f"_top_{value}"), F.col(value))).over(group)
    return F.when(F.col(value).isNull() | (F.col(value) < best), best).when(ties > 1, best).otherwise(second)


def with_best_other(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    df = df.withColumn(f"_top_{value}", F.max(value).over(Window.partitionBy(by)))
    return df.withColumn(name, best_other(value, by)).drop(f"_top_{value}")


def context_features(df: DataFrame) -> DataFrame:
    """Values less the best of the other members of the list, and names that repeat in it."""
    for c in CONTEXT:
        df = with_best_other(df, c, "s1", "_o").withColumn(c.replace("f_", "f_ctx_", 1), F.col(c) - F.col("_o")).drop("_o")
    exact = F.count_if(F.col("f_name_core_tsr") >= 1.0).over(Window.partitionBy("s1"))
    return df.withColumns({"f_ctx_same_name_in_list": (F.count(F.lit(1)).over(Window.partitionBy("s1", "p_core_name")) - 1).cast("double"), "f_ctx_n_name_exact": exact.cast("double")})


def blocking_features(df: DataFrame) -> DataFrame:
    """Scores, ranks and gaps of the searches, the pruner's score and place in the list."""
    lists = Window.partitionBy("s1")
    out = {f"f_score_{m}": F.col(f"score_{m}").cast("double") for m in SCORED} | {f"f_rank_{m}": F.col(f"rank_{m}").cast("double") for m in SCORED}
    out |= {f"f_gap_{m}": F.max(f"score_{m}").over(lists) - F.col(f"score_{m}") for m in FORWARD} | {"f_gap_reverse": F.col("best_reverse") - F.col("score_reverse")}
    out |= {
        "f_n_methods": reduce(lambda a, b: a + b, [F.col(f"rank_{m}").isNotNull().cast("int") for m in METHODS]).cast("double"), "f_p_u50": F.col("p_u50").cast("double"),
        "f_p_gap": F.max("p_u50").over(lists) - F.col("p_u50"), "f_list_rank": F.row_number().over(lists.orderBy(F.desc("p_u50"), "cand")).cast("double"),
        "f_list_size": F.count(F.lit(1)).over(lists).cast("double"), "f_cand_is_s3": F.col("cand").startswith("S3-").cast("double"),
    }
    return df.withColumns(out)


def cross_features(df: DataFrame) -> DataFrame:
    """The same candidate under other queries: best p1, how many above one half, and the lead over the best."""
    df = with_best_other(df, "p1", "cand", "x_p_other").fillna(0.0, ["x_p_other"])
    n = F.count_if(F.col("p1") > 0.5).over(Window.partitionBy("cand")) - (F.col("p1") > 0.5).cast("int")
    return df.withColumn("x_n_other05", n.cast("double")).withColumn("x_lead", F.col("p1") - F.col("x_p_other"))


def set_features(df: DataFrame) -> DataFrame:
    """Stage-1 scores within the list: rank, gap to the best and confident members."""
    lists = Window.partitionBy("s1")
    return df.withColumns({"s_p1": F.col("p1"), "s_rank": F.row_number().over(lists.orderBy(F.desc("p1"), "cand")).cast("double"), "s_gap": F.max("p1").over(lists) - F.col("p1"), "s_n05": F.count_if(F.col("p1") > 0.5).over(lists).cast("double"), "s_n09": F.count_if(F.col("p1") > 0.9).over(lists).cast("double")})


RECORD = ["country", "full_name", "core_name", "nolegal", "legal", "legal_any", "addr_norm", "city", "state", "numbers"]


def build(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The 86 features of (s1, cand) pairs with blocking columns, as floats; null is missing.

    Records feed five branches and pairs three, so both are written once: neither the rules of normalisation nor the searches
    are run again, and their expressions are not folded into each other.
    """
    records = written(prepare(records).select("entity_id", *RECORD), "records")
    total, frequency, names = count_stats(records)
    # Dealt evenly over all tasks: similarities cost far more than a pair's bytes suggest, so neither lists nor sizes should place them.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The written table's files are small and would be read by few tasks: pairs are dealt after that.
    df = written(joined(blocking_features(pairs), records, RECORD), "pairs").repartition(parts, "s1", "cand")
    df = context_features(other_features(frequency_features(idf_features(name_features(df), total, frequency), names)))
    return df.select("s1", "cand", *[F.col(c).cast("float").alias(c) for c in df.columns if c.startswith("f_")])
