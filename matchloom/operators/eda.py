"""Keys of raw records for looking at data: regions learnt from addresses, cities, postcodes and tokens of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions.text import normal

#: A part of addresses is a region if it ends so large a share of a country's queries, and so large a share of its own occurrences.
REGION_SHARE, REGION_LAST = 0.001, 0.6


def parts(recs: DataFrame) -> DataFrame:
    """(id, country, src, last, c) of (id, country, src, addr): normal parts between commas that aren't empty; last: whether a part ends its address."""
    cells = recs.select("id", "country", "src", F.size(F.split("addr", ",")).alias("n"), F.posexplode(F.split("addr", ",")).alias("pos", "c"))
    return cells.select("id", "country", "src", (F.col("pos") == F.col("n") - 1).alias("last"), normal(F.col("c")).alias("c")).where("c <> ''")


def regions(recs: DataFrame) -> DataFrame:
    """(country, c, n_last, n_all): parts that are regions, by the addresses of S1."""
    s1 = recs.where("src = 'S1'")
    total = s1.groupBy("country").agg(F.count(F.lit(1)).alias("n_s1"))
    counts = parts(s1).groupBy("country", "c").agg(F.sum(F.col("last").cast("long")).alias("n_last"), F.count(F.lit(1)).alias("n_all")).join(total, "country")
    return counts.where((F.col("n_last") >= REGION_SHARE * F.col("n_s1")) & (F.col("n_last") >= REGION_LAST * F.col("n_all"))).select("country", "c", "n_last", "n_all")


def add_keys(recs: DataFrame) -> DataFrame:
    """(id, city_key, postcode, first_tok, rare_tok) of (id, country, src, name, addr), ids unique.

    city_key: of the parts without digits that are no regions the most frequent in the country; postcode: the last token of
    5 or 6 digits that does not begin the address; rare_tok: the name's token that the country's names have least
    often. Ties go to the first by name; what a record does not have is null.
    """
    found = parts(recs).join(regions(recs).select("country", "c"), ["country", "c"], "left_anti").where(~F.col("c").rlike(r"\d"))
    often = found.groupBy("country", "c").agg(F.count(F.lit(1)).alias("cf"))
    city = found.join(often, ["country", "c"]).groupBy("id").agg(F.min(F.struct((-F.col("cf")).alias("cf"), "c"))["c"].alias("city_key"))
    name, addr = normal(F.coalesce("name", F.lit(""))), normal(F.coalesce("addr", F.lit("")))
    tokens = recs.select("id", "country", F.explode(F.split(name, " ")).alias("t")).where("t <> ''")
    tf = tokens.groupBy("country", "t").agg(F.count(F.lit(1)).alias("tf"))
    rare = tokens.join(tf, ["country", "t"]).groupBy("id").agg(F.min(F.struct("tf", "t"))["t"].alias("rare_tok"))
    codes = F.regexp_extract_all(F.regexp_replace(addr, r"^\S+\s*", ""), F.lit(r"(?<!\S)(\d{5,6})(?!\S)"), F.lit(1))
    own = recs.select("id", F.when(F.size(codes) > 0, F.element_at(codes, -1)).alias("postcode"), F.nullif(F.element_at(F.split(name, " "), 1), F.lit("")).alias("first_tok"))
    return own.join(city, "id", "left").join(rare, "id", "left").select("id", "city_key", "postcode", "first_tok", "rare_tok")


def _side(keys: DataFrame, side: str) -> DataFrame:
    return keys.toDF(*[f"{c}_{side}" for c in keys.columns])


def key_agreement(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, pairs, same, missing) of true pairs (s1, cand): how many agree on each key, and how many lack it on a side; `none` counts those that agree on no key."""
    both = pairs.join(_side(keys, "1"), F.col("s1") == F.col("id_1")).join(_side(keys, "2"), F.col("cand") == F.col("id_2"))
    names = ("city_key", "postcode", "first_tok", "rare_tok")
    same = {k: F.coalesce(F.col(f"{k}_1") == F.col(f"{k}_2"), F.lit(False)) for k in names}
    lacking = {k: F.col(f"{k}_1").isNull() | F.col(f"{k}_2").isNull() for k in names}
    cells = [F.struct(F.lit(k).alias("key"), same[k].alias("same"), lacking[k].alias("missing")) for k in names]
    cells.append(F.struct(F.lit("none").alias("key"), (~F.greatest(*same.values())).alias("same"), F.lit(False).alias("missing")))
    flat = both.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return flat.groupBy("key").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("same").cast("long")).alias("same"), F.sum(F.col("missing").cast("long")).alias("missing"))


def frequent_names(recs: DataFrame, least: int = 2) -> DataFrame:
    """(country, name, n, addresses): names that at least `least` records of a country have, and how many different addresses those have."""
    rows = recs.select("country", normal(F.coalesce("name", F.lit(""))).alias("name"), normal(F.coalesce("addr", F.lit(""))).alias("addr"))
    return rows.where("name <> ''").groupBy("country", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("addr").alias("addresses")).where(F.col("n") >= least)


def last_in_order(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value): each key's last value that is not null, by `order` and then by the value itself; null for a key without any."""
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], F.desc(value))))
    return df.select(key).distinct().join(ranked.where("_r = 1").select(key, value), key, "left")
