"""Reports on scored candidates, chosen pairs and search methods, against true pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the score bands.
BANDS = (("low", 0.5), ("mid", 0.8))


def _marked(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with `hit`: whether they are true."""
    true = truth.select("s1", "cand").distinct().withColumn("_t", F.lit(True))
    return pairs.join(true, ["s1", "cand"], "left").withColumn("hit", F.coalesce("_t", F.lit(False))).drop("_t")


def calibration(scored: DataFrame, truth: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) of (s1, cand, p): in each of `bins` equal ranges of the score its mean, and the share of pairs that are true. A score of 1 is in the last bin."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return _marked(scored, truth).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("hit").cast("double")).alias("rate"))


def band(p: Column) -> Column:
    """Name of a score's band; 'none' for null."""
    out = F.when(p.isNull(), "none")
    for name, top in BANDS:
        out = out.when(p < top, name)
    return out.otherwise("high")


def errors(scored: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, cand, p, kind): chosen pairs that are not true ('wrong'), and true pairs that were not chosen ('missed'; p is null for those that are not even candidates)."""
    scores, true = scored.select("s1", "cand", "p"), truth.select("s1", "cand").distinct()
    wrong = chosen.select("s1", "cand").join(true, ["s1", "cand"], "left_anti").withColumn("kind", F.lit("wrong"))
    missed = true.join(chosen, ["s1", "cand"], "left_anti").withColumn("kind", F.lit("missed"))
    return wrong.unionByName(missed).join(scores, ["s1", "cand"], "left").select("s1", "cand", "p", "kind")


def error_bands(scored: DataFrame, chosen: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, band, n) of errors(): by the score that a pair has."""
    return errors(scored, chosen, truth).groupBy("kind", band(F.col("p")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _with_records(pairs: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    for side, key in (("1", "s1"), ("2", "cand")):
        pairs = pairs.join(records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in columns]), key)
    return pairs


def error_groups(scored: DataFrame, chosen: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """(country, kind, same_name, same_state, n) of errors(): decoys are wrong pairs of equal names; same_state is null where a side has none."""
    rows = _with_records(errors(scored, chosen, truth), records, ("country", "state", "core_name"))
    groups = [F.col("country_1").alias("country"), "kind", (F.col("core_name_1") == F.col("core_name_2")).alias("same_name"), (F.col("state_1") == F.col("state_2")).alias("same_state")]
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def group_recall(found: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """(country, grp, pairs, found): true pairs, and those among the candidates, of all pairs, of those with a side without state ('stateless'), of different states ('moved') and with a candidate of the third source ('third')."""
    pairs = _with_records(truth.select("s1", "cand").distinct(), records, ("country", "state"))
    pairs = pairs.join(found.select("s1", "cand").distinct().withColumn("f", F.lit(1)), ["s1", "cand"], "left")
    groups = {"all": F.lit(True), "stateless": F.col("state_1").isNull() | F.col("state_2").isNull(), "moved": F.col("state_1") != F.col("state_2"), "third": F.col("cand").startswith("S3-")}
    flat = pairs.select(F.col("country_1").alias("country"), "f", F.explode(F.array(*[F.when(c, F.lit(g)) for g, c in groups.items()])).alias("grp")).where("grp is not null")
    return flat.groupBy("country", "grp").agg(F.count(F.lit(1)).alias("pairs"), F.count("f").alias("found"))


def stress_methods(methods: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """(method, grp, pairs, found): recall of each search of (method, s1, cand) on easy and hard true pairs: equal names, names that share a word, and names that share none."""
    pairs = _with_records(truth.select("s1", "cand").distinct(), records, ("core_name",))
    words = [F.split(f"core_name_{k}", " ") for k in (1, 2)]
    group = F.when(F.col("core_name_1") == F.col("core_name_2"), "equal").when(F.arrays_overlap(*words), "word").otherwise("none")
    pairs = pairs.select("s1", "cand", group.alias("grp"))
    every = methods.select("method").distinct()
    totals = pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs")).withColumn("k", F.lit(0)).join(every.withColumn("k", F.lit(0)), "k").drop("k")  # three groups
    hits = methods.select("method", "s1", "cand").distinct().join(pairs, ["s1", "cand"]).groupBy("method", "grp").agg(F.count(F.lit(1)).alias("found"))
    return totals.join(hits, ["method", "grp"], "left").select("method", "grp", "pairs", F.coalesce("found", F.lit(0)).alias("found"))


def bucket_stats(records: DataFrame) -> DataFrame:
    """(country, provenance, buckets, queries, pool, pairs, share): records and comparisons by where a record's state comes from (state_src), and their share of a country's comparisons."""
    per = records.groupBy("country", "state_src", "state").agg(F.sum(F.col("entity_id").startswith("S1-").cast("long")).alias("q"), F.sum((~F.col("entity_id").startswith("S1-")).cast("long")).alias("p"))
    out = per.groupBy("country", F.col("state_src").alias("provenance")).agg(F.count_distinct("state").alias("buckets"), F.sum("q").alias("queries"), F.sum("p").alias("pool"), F.sum(F.col("q") * F.col("p")).alias("pairs"))
    total = out.groupBy("country").agg(F.sum("pairs").alias("all_pairs"))
    return out.join(total.withColumnRenamed("country", "c"), out["country"].eqNullSafe(F.col("c"))).select("country", "provenance", "buckets", "queries", "pool", "pairs", (F.col("pairs") / F.nullif(F.col("all_pairs"), F.lit(0))).alias("share"))
