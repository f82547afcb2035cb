"""How well a name tells true pairs from the hardest other ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions import similarity
from matchloom.functions.text import jaccard
from matchloom.operators import blocking
from matchloom.session import written

#: Candidates of a query that compete for the hardest, besides as many as it has true ones.
DEPTH = 25
#: True ones of a query that the first search has room for; a further one has room for so many times more.
ROOM, STEP = 1, 16
#: Texts of a tile that answers. Each tile sends a whole list of candidates for each query, so they are large.
POOL_TILE = 32768


def plain_grams(c: Column) -> Column:
    """Distinct character 3-grams without padding; a shorter text is its own."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))))


def similarities(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds tsr (token sets) and jac3 (3-grams), 0 to 100; 0 where a text is empty."""
    jac = F.coalesce(jaccard(plain_grams(F.col(a)), plain_grams(F.col(b))), F.lit(0.0))
    return pairs.withColumns({"tsr": 100 * F.coalesce(similarity.sim_token_set(a, b), F.lit(0.0)), "jac3": 100 * jac})


def hardest(queries: DataFrame, pool: DataFrame, truth: DataFrame, depth: int = DEPTH, max_df: float = blocking.MAX_DF) -> DataFrame:
    """(country, s1, cand, a, b): for each query the most similar record that is no match, by token sets, then ratio, then id.

    Candidates come from the n-gram search, `depth` and as many as there are true ones a query; tables are (id, country, text), truth (s1, cand).
    Queries with many true ones are searched for apart, so that the others' lists need not be as long as theirs.
    """
    n_true = truth.distinct().groupBy(F.col("s1").alias("id")).agg(F.count(F.lit(1)).alias("n_true"))
    asked = queries.select("id", "country", "text", F.lit(True).alias("q")).join(n_true, "id", "left").fillna(0, ["n_true"])
    both = asked.unionByName(pool.select("id", "country", "text", F.lit(False).alias("q"), F.lit(0).cast("long").alias("n_true"))).withColumn("bucket", F.lit("all"))
    both = written(both, "names")
    found, low, room, most = [], -1, ROOM, both.agg(F.max("n_true")).first()[0] or 0
    while low < most:
        mine = F.col("q") & (F.col("n_true") > low) & (F.col("n_true") <= room)
        if not both.where(mine).isEmpty():
            found.append(blocking.search_forward(both, mine, ~F.col("q"), depth + min(room, most), max_df=max_df, other_tile=POOL_TILE))
        low, room = room, room * STEP
    hits = reduce(DataFrame.unionByName, found) if found else blocking.search_forward(both, F.lit(False), ~F.col("q"), depth, max_df=max_df)
    wrong = hits.select("s1", "cand", "rank").join(truth, ["s1", "cand"], "left_anti")
    # By query last, as the rows are grouped by it.
    rows = wrong.join(both.where("not q").select(F.col("id").alias("cand"), F.col("text").alias("b")), "cand")
    rows = rows.join(both.where("q").select(F.col("id").alias("s1"), "country", "n_true", F.col("text").alias("a")), "s1").where(F.col("rank") <= depth + F.col("n_true"))
    rows = rows.withColumns({"t": F.coalesce(similarity.sim_token_set("a", "b"), F.lit(0.0)), "r": F.coalesce(similarity.sim_ratio("a", "b"), F.lit(0.0))})
    best = rows.groupBy("country", "s1").agg(F.min(F.struct((-F.col("t")).alias("t"), (-F.col("r")).alias("r"), "cand", "a", "b")).alias("x"))
    return best.select("country", "s1", "x.cand", "x.a", "x.b")


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """(keys, auc): the chance that a positive row scores above another, ties counting half. Rows are counted by score before they are ordered."""
    values = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy(score)) - F.col("n")
    parts = values.withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    return parts.groupBy(*keys).agg((F.sum("won") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def compare(queries: DataFrame, pool: DataFrame, truth: DataFrame, max_df: float = blocking.MAX_DF) -> DataFrame:
    """(country, s1, cand, a, b, is_true, tsr, jac3): true pairs and hardest others of all queries."""
    named = truth.join(queries.select(F.col("id").alias("s1"), "country", F.col("text").alias("a")), "s1").join(pool.select(F.col("id").alias("cand"), F.col("text").alias("b")), "cand")
    wrong = hardest(queries, pool, truth, max_df=max_df).withColumn("is_true", F.lit(False))
    return similarities(named.select("country", "s1", "cand", "a", "b", F.lit(True).alias("is_true")).unionByName(wrong), "a", "b")


def summary(compared: DataFrame) -> DataFrame:
    """Medians and shares of low similarities by country and kind."""
    low = lambda c, bar: F.avg((F.col(c) < bar).cast("double")).alias(f"{c}_below_{bar}")
    median = lambda c: F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median")
    cells = [x for c in ("tsr", "jac3") for x in (median(c), low(c, 50), low(c, 70))]
    return compared.groupBy("country", "is_true").agg(F.count(F.lit(1)).alias("pairs"), *cells)
