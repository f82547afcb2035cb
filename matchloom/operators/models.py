"""Pair classifiers: gradient-boosted trees with out-of-fold scores by query, blending and pseudo labels."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions.text import grams3
from matchloom.session import written

MISSING = -1.0


def _ready(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing values become a constant and a column that says so: trees here take no nulls."""
    return df.withColumns({f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in features})


def train(
    df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 5, seed: int = 42, step: float = 0.1, rows: float = 1.0, columns: str = "auto", least: int = 1, held_out: str | None = None
) -> PipelineModel:
    """Boosted trees. rows and columns: shares that each tree sees; least: rows of a leaf. held_out: a boolean column; boosting stops when its rows no longer gain."""
    options = {"validationIndicatorCol": held_out} if held_out else {}
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=step, subsamplingRate=rows, featureSubsetStrategy=columns, minInstancesPerNode=least, **options)
    return _fitted(trees, df, features, label)


def train_forest(df: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A second learner to blend with: a random forest."""
    return _fitted(RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed), df, features, label)


def _fitted(learner, df: DataFrame, features: list[str], label: str) -> PipelineModel:
    columns = [f"_v_{c}" for c in features] + [f"_m_{c}" for c in features]
    stages = [VectorAssembler(inputCols=columns, outputCol="_x"), learner]
    return Pipeline(stages=stages).fit(_ready(df, features).withColumn("_y", F.col(label).cast("double")))


def importance(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Share of the gain by feature, greatest first; a feature's value and its being missing count together."""
    gain = model.stages[-1].featureImportances.toArray()
    both = {c: float(gain[i] + gain[i + len(features)]) for i, c in enumerate(features)}
    return dict(sorted(both.items(), key=lambda kv: (-kv[1], kv[0])))


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    out = model.transform(_ready(df, features)).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def fold_of(key: Column, n: int, salt: int = 0) -> Column:
    """A fold from 0 to n - 1 by 24 bits of the key's md5, so that any engine deals alike; another salt deals anew."""
    text = F.concat(key.cast("string"), F.lit(f"/{salt}")) if salt else key.cast("string")
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 6), 16, 10).cast("long"), F.lit(n)).cast("int")


def slices(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with the number (0 to n - 1) of their slice, by a hash of the key: all rows of a key are in one slice, and slices are about equal."""
    return df.withColumn("slice", fold_of(F.col(key), n))


def out_of_fold(df: DataFrame, features: list[str], label: str, folds: int = 5, name: str = "p1", **options: int) -> DataFrame:
    """Scores of each row from a model that saw no row of its query."""
    df = written(df.withColumn("_fold", fold_of(F.col("s1"), folds)), "folds")  # rounds of boosting read features, not their sources
    parts = [predict(train(df.where(F.col("_fold") != k), features, label, **options), df.where(F.col("_fold") == k), features, name) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def ce_blend(p: Column, other: Column, w: float, low: float = 0.02, high: float = 0.98) -> Column:
    """A second score mixed in where the first is not sure."""
    return F.when((p > low) & (p < high) & other.isNotNull(), (1 - w) * p + w * other).otherwise(p)


def pseudo_labels(df: DataFrame, p: str = "p", high: float = 0.95, low: float = 0.05) -> DataFrame:
    return df.where((F.col(p) >= high) | (F.col(p) <= low)).withColumn("label", (F.col(p) >= high).cast("int"))


def seed_mean(rows: DataFrame, scored: DataFrame, features: list[str], label: str, seeds: list[int], name: str = "p", **options) -> DataFrame:
    """`scored` with the mean probability of models that differ in their seed."""
    out = scored
    for k in seeds:
        out = predict(train(rows, features, label, seed=k, **options), out, features, f"_p{k}")
    mean = reduce(Column.__add__, [F.col(f"_p{k}") for k in seeds]) / len(seeds)
    return out.select(*scored.columns, mean.alias(name))


# Settings that a search draws from.
SPACE = {"depth": [4, 5, 6, 7], "least": [20, 50, 100, 200, 400], "step": [0.03, 0.05, 0.08], "columns": ["0.6", "0.8", "1.0"], "rows": [0.7, 0.8, 1.0]}


def search(evaluate: Callable[[dict], float], trials: int, seed: int = 42, space: dict[str, list] | None = None) -> list[tuple[float, dict]]:
    """(score, options of train()) of the plain settings and of `trials` random draws, best first; ties keep their order."""
    draw = random.Random(seed)
    plans = [{}] + [{k: draw.choice(v) for k, v in (space or SPACE).items()} for _ in range(trials)]
    return sorted(((evaluate(p), p) for p in plans), key=lambda x: -x[0])


def average_rank(df: DataFrame, column: str, name: str, bins: int = 4096) -> DataFrame:
    """Adds the rank of a score between 0 and 1 among all rows, from 1, ties at their mean. Ranks run within bins of the score, whose totals come before."""
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.floor(F.col("_v") * bins))
    totals = values.groupBy("_b").agg(F.sum("_n").alias("_t"))
    totals = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))  # one row a bin
    inner = F.sum("_n").over(Window.partitionBy("_b").orderBy("_v"))
    ranks = values.join(totals, "_b").select("_v", (F.col("_before") + inner - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def blend(df: DataFrame, a: str, b: str, how: str, name: str = "p") -> DataFrame:
    """Two scores made one: `mean`, or `rank`, the mean of their ranks over the number of rows; `a` or `b` alone by its name."""
    if how in (a, b):
        return df.withColumn(name, F.col(how))
    if how == "mean":
        return df.withColumn(name, (F.col(a) + F.col(b)) / 2)
    if how != "rank":
        raise ValueError(how)
    n = df.count()
    ranked = average_rank(average_rank(df, a, "_ra"), b, "_rb")
    return ranked.withColumn(name, (F.col("_ra") + F.col("_rb")) / (2.0 * max(n, 1))).drop("_ra", "_rb")


def _crossed(df: DataFrame, a: str, b: str, size: int) -> DataFrame:
    x, y = (grams3(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in (a, b))
    mark = lambda grams, m: F.transform(grams, lambda g: F.concat(F.lit(m), g))
    words = F.concat(mark(F.array_intersect(x, y), "="), mark(F.array_except(x, y), "<"), mark(F.array_except(y, x), ">"))
    return HashingTF(inputCol="_g", outputCol="_x", numFeatures=size, binary=True).transform(df.withColumn("_g", words)).drop("_g")


class TextScorer:
    """A second opinion on a pair of texts: logistic regression on the hashed character 3-grams that both have, or one only. Any scorer with score() may take its place."""

    def __init__(self, a: str = "text_1", b: str = "text_2", size: int = 1 << 16, rounds: int = 30):
        self.a, self.b, self.size, self.rounds, self.model = a, b, size, rounds, None

    def fit(self, df: DataFrame, label: str) -> TextScorer:
        rows = _crossed(df, self.a, self.b, self.size).select("_x", F.col(label).cast("double").alias("_y"))
        self.model = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=self.rounds, regParam=0.01).fit(rows)
        return self

    def score(self, df: DataFrame, name: str = "p_ce") -> DataFrame:
        out = self.model.transform(_crossed(df, self.a, self.b, self.size))
        return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def agreed_labels(df: DataFrame, first: str, second: str, most: int = 30_000, per_positive: int = 3, most_negative: int = 120_000) -> DataFrame:
    """(s1, cand, label) of pairs on which two scorers agree: the surest positives by `second`, at most `most`, and for each of them per_positive negatives in hash order."""
    yes = df.where((F.col(first) >= 0.90) & (F.col(second) >= 0.95)).orderBy(F.desc(second), "s1", "cand").limit(most)
    wanted = min(yes.count() * per_positive, most_negative)
    no = df.where((F.col(first) <= 0.05) & (F.col(second) <= 0.02)).orderBy(F.md5(F.concat_ws("|", "s1", "cand"))).limit(wanted)
    return yes.select("s1", "cand", F.lit(1).alias("label")).unionByName(no.select("s1", "cand", F.lit(0).alias("label")))


def unseen_shift(results: list[dict[str, float]]) -> tuple[float, bool]:
    """(shift of the threshold, whether pseudo labels help) for countries without labels, from trials that train on one country and score another.

    A trial has tau_source, tau_target, and F0.5 on the target at_source, at_target and pseudo. The shift is the mean one if all trials move the same way and gain by it, else 0.
    """
    moves = [r["tau_target"] - r["tau_source"] for r in results]
    useful = (all(m > 0 for m in moves) or all(m < 0 for m in moves)) and all(r["at_target"] > r["at_source"] for r in results)
    return (sum(moves) / len(moves) if useful else 0.0), all(r["pseudo"] > r["at_source"] for r in results)
