"""Selection of matches and its metric, macro F0.5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select(scored: DataFrame, tau: float, margin: float = 0.0, one_owner: bool = True, tau2: float | None = None, similar: float = 0.9, owner_delta: float = 0.0) -> DataFrame:
    """Pairs (s1, cand, p) at or above tau; then one owner a candidate (ties: the smaller s1); then pairs within the margin of what is left of their list's best.

    tau2: a lower bar for look-alikes (s_sim_name and s_num_eq). owner_delta: a contested candidate whose lead is not above it goes to nobody.
    """
    bar = F.col("p") >= tau
    if tau2 is not None:
        bar |= (F.col("p") >= tau2) & (F.col("s_sim_name") >= similar) & (F.col("s_num_eq") >= 1)
    out = scored.where(bar)
    if one_owner:
        order = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
        out = out.withColumns({"_r": F.row_number().over(order), "_next": F.lead("p").over(order)}).where("_r = 1")
        if owner_delta > 0:
            out = out.where(F.coalesce(F.col("p") - F.col("_next"), F.lit(1.0)) > owner_delta)
        out = out.drop("_r", "_next")
    if margin > 0:
        out = out.withColumn("_best", F.max("p").over(Window.partitionBy("s1"))).where(F.col("p") >= F.col("_best") - margin).drop("_best")
    return out


def select_adaptive(scored: DataFrame, taus: dict[str, float], margins: dict[str, float], tau: float = 0.51, margin: float = 0.70) -> DataFrame:
    """Thresholds and margins by country; the margin is taken from the best before one owner is chosen."""
    pick = lambda table, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("country")), F.lit(other)) if table else F.lit(other)
    out = scored.where(F.col("p") >= pick(taus, tau))
    out = out.withColumn("_best", F.max("p").over(Window.partitionBy("s1"))).where(F.col("p") >= F.col("_best") - pick(margins, margin))
    order = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_best")


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of a query: 1 for an empty list without matches, 0 without a hit."""
    precision, recall = tp / n_pred, tp / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def f05_table(pred: DataFrame, truth: DataFrame, s1s: DataFrame) -> DataFrame:
    """s1s with tp, n_pred, n_true and f05; predictions for other queries do not count."""
    pred, truth = pred.select("s1", "cand").distinct(), truth.select("s1", "cand").distinct()
    count = lambda df, name: df.groupBy("s1").agg(F.count(F.lit(1)).alias(name))
    out = s1s.join(count(pred.join(truth, ["s1", "cand"], "left_semi"), "tp"), "s1", "left").join(count(pred, "n_pred"), "s1", "left").join(count(truth, "n_true"), "s1", "left")
    out = out.fillna(0, ["tp", "n_pred", "n_true"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def summary(table: DataFrame) -> DataFrame:
    """Macro F0.5 overall, by country and by kind (singleton or not)."""
    kind = F.when(F.col("n_true") == 0, "singleton").otherwise("matched")
    table.withColumn("kind", kind).createOrReplaceTempView("_f05")
    return table.sparkSession.sql("SELECT coalesce(country, 'ALL') AS country, coalesce(kind, 'ALL') AS kind, avg(f05) AS f05, count(*) AS n FROM _f05 GROUP BY GROUPING SETS ((), (country), (kind))")


def tune(scored: DataFrame, truth: DataFrame, s1s: DataFrame, taus: list[float], margins: list[float]) -> DataFrame:
    """(tau, margin, f05): macro F0.5 of all settings in one job. See tune_by()."""
    return tune_by(scored, truth, s1s, taus, margins)


def tune_by(scored: DataFrame, truth: DataFrame, s1s: DataFrame, taus: list[float], margins: list[float], *by: str) -> DataFrame:
    """Macro F0.5 of all settings, for each value of the columns `by` of the queries: each row is repeated for each of the few settings, which are part of the keys."""
    grid = F.inline(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(float(m)).alias("margin")) for t in taus for m in margins]))
    rows = scored.select("*", grid).where("p >= tau")
    owner = Window.partitionBy("tau", "margin", "cand").orderBy(F.desc("p"), "s1")
    rows = rows.withColumn("_r", F.row_number().over(owner)).where("_r = 1")
    rows = rows.withColumn("_best", F.max("p").over(Window.partitionBy("tau", "margin", "s1"))).where("p >= _best - margin")
    hits = rows.join(truth.withColumn("hit", F.lit(1)), ["s1", "cand"], "left").groupBy("tau", "margin", "s1").agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    every = s1s.join(truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true")), "s1", "left").select("*", grid).join(hits, ["tau", "margin", "s1"], "left").fillna(0, ["tp", "n_pred", "n_true"])
    return every.groupBy(*by, "tau", "margin").agg(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f05"))


def unseen_tau(tau: float, shift: float, seen: list[str], low: float = 0.3, high: float = 0.9) -> Column:
    """The threshold of a row's country: tau, shifted for countries outside `seen` (a null country is one), and clipped to low and high."""
    known = F.coalesce(F.col("country").isin(*seen), F.lit(False)) if seen else F.lit(False)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(known, tau).otherwise(tau + shift)))


def select_unseen(scored: DataFrame, tau: float, margin: float, shift: float, seen: list[str]) -> DataFrame:
    """select() of (s1, cand, p, country) with a threshold that is shifted for countries that no label has."""
    return select(scored.where(F.col("p") >= unseen_tau(tau, shift, seen)), 0.0, margin)


def half(id_col: str = "s1") -> Column:
    """0 or 1 by the number that an id ends in: settings are tuned on one half of the queries and reported on the other."""
    return F.regexp_extract(id_col, r"(\d+)$", 1).cast("long") % 2


def tune_and_report(scored: DataFrame, truth: DataFrame, s1s: DataFrame, taus: list[float], margins: list[float]) -> DataFrame:
    """(tau, margin, f05_tune, f05_report): the setting that is best on queries with even numbers, ties to the lower tau and margin, with its score on the others."""
    split = lambda k: (scored.where(half() == k), truth.where(half() == k), s1s.where(half() == k))
    best = tune(*split(0), taus, margins).orderBy(F.desc("f05"), "tau", "margin").limit(1)
    other = tune(*split(1), taus, margins).withColumnRenamed("f05", "f05_report")
    return best.withColumnRenamed("f05", "f05_tune").join(other, ["tau", "margin"])


def keeps(new: dict[str, float], old: dict[str, float], least_precision: float = 0.985) -> bool:
    """Whether a change stays: better overall and in each group of the old report, and precise enough. Both have `precision` and a score a group."""
    return new["precision"] >= least_precision and all(new.get(k, 0.0) > v for k, v in old.items() if k != "precision")


def robust_choice(scores: dict[str, float], order: tuple[str, ...] = ("C", "B", "A"), loss: float = 0.005) -> str:
    """The first variant, most robust first, that is at most `loss` below the best; the best one if none of them is."""
    best = max(scores, key=lambda k: scores[k])
    return next((v for v in order if v in scores and scores[v] >= scores[best] - loss), best)


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(missing, extra): how many distinct rows of a are not in b, and of b not in a; both are 0 for equal sets."""
    side = a.select(F.struct(*a.columns).alias("k"), F.lit(1).alias("s")).unionByName(b.toDF(*a.columns).select(F.struct(*a.columns).alias("k"), F.lit(2).alias("s")))
    sides = side.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return sides.agg(F.count_if(F.col("hi") == 1).alias("missing"), F.count_if(F.col("lo") == 2).alias("extra"))
