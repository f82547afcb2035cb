"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule: (time, weight) knots over [0, 1], linear between them. The integral of the
schedule over the whole run is the source's share; its partial integrals say how the share is spread over the run.
A source's documents are put in a fixed order and numbered by cumulative tokens, pass after pass, up to the
source's target. A document's position in training is the time at which the source's integrated schedule
reaches the middle of the document's tokens, found by inverting the integral.

Everything is expressed with DataFrame operations. The running sums within a source are split over BUCKETS
hash-ordered buckets, so a source with a third of all rows is never ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.store import cut, written

#: Buckets of a source's hash order; one is the most that a task must order by itself.
BUCKETS = 4096
#: Most passes over a source.
MAX_PASSES = 3
#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Shapes of schedules with integral 1, repeating: constant, rising, falling.
SHAPES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def integral(knots: Sequence[tuple[float, float]], t: float = 1.0) -> float:
    """Integral of a schedule from 0 to t."""
    total = 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        h = max(0.0, min(t, t1) - t0)
        total += h * w0 + (w1 - w0) / (t1 - t0) * h * h / 2
    return total


def inverse(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which the integral reaches `share` (0 to 1) of its whole: a quadratic for each linear piece."""
    whole, out, done = integral(knots), None, 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, area = (w1 - w0) / (t1 - t0), (w0 + w1) / 2 * (t1 - t0)
        need = F.greatest(share * F.lit(whole) - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * F.lit(2 * slope), F.lit(0.0)))
        here = F.least(F.lit(t0) + F.when(root + F.lit(w0) > 0, need * 2 / (root + F.lit(w0))).otherwise(F.lit(0.0)), F.lit(t1))
        out = here if out is None else F.when(share * F.lit(whole) > F.lit(done), here).otherwise(out)
        done += area
    return out


def position(shape: Column, share: Column) -> Column:
    """Training position in [0, 1] for the schedule numbered `shape`."""
    out = inverse(SHAPES[0], share)
    for k in range(1, len(SHAPES)):
        out = F.when(shape == k, inverse(SHAPES[k], share)).otherwise(out)
    return out


def source_targets(sizes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, size) rows to one row a source: rank, weight, source_size, target, target_words.

    Targets share the sum of all sizes by weight. A target stops at max_passes times its source's size; what it
    leaves goes to the others by weight, until none is above. That is a water level: with sources in order of
    limit / weight, the ones below the level are at their limit, and the level is the rest of the total over the
    rest of the weights. Sums are of integers, so any order of addition gives the same targets.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    # One row a source from here on: names of sources, not documents.
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    per = per.withColumn("limit", F.col("source_size") * max_passes)
    order = Window.orderBy((F.col("limit").cast("double") / F.col("weight")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("full", F.col("limit") / F.col("weight") <= F.col("level"))
    # The first source that is not full sets the level of all later ones.
    per = per.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)["level"])
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    per = per.withColumn("target", target)
    return per.select("source", "rank", "weight", "source_size", "target", F.round("target").cast("long").alias("target_words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False, max_passes: int = MAX_PASSES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: (id, source, size, source_size, target, taken, passes), and the columns to carry along.

    passes: array of (words, position), one for each time that the document is taken, in order of the passes.
    A source's documents are in md5 order of their ids. With whole=False the last document taken may be cut, so a
    source's words are its rounded target; with whole=True a document is taken if the middle of it is within
    the target, so texts stay whole and a source's words miss the target by half a document at most.

    Null texts have no words, are never taken and have no passes. A null source is a source of its own, after all
    others. Documents without words take part with size 0. Repeated rows and ids are documents of their own; ties
    of the md5 order go by size, which leaves only interchangeable rows. An empty table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *carry)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")  # 4096 buckets, in md5 order
    # Narrow: ids, names and counts. Every later step reads this and not the texts.
    sized = cut(sized.select("*", order.alias("order"), bucket.alias("bucket")))
    targets = source_targets(sized, max_passes)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(start), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s, t = starts.alias("s"), targets.alias("t")
    joined = (
        placed.alias("d")
        .join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
        .join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.target_words", (F.col("t.rank") % len(SHAPES)).alias("shape"), (F.col("s.bucket_start") + F.col("d.before")).alias("first"), *[F.col(f"d.{c}") for c in carry])
    )

    def one(p: Column) -> Column:
        at = p * F.col("source_size") + F.col("first")
        if whole:
            words = F.when((F.col("size") > 0) & (2 * at + F.col("size") <= 2 * F.col("target_words")), F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.least(F.col("target_words") - at, F.col("size")), F.lit(0))
        share = (at.cast("double") + words / 2) / F.greatest(F.col("target_words"), F.lit(1))
        return F.struct(words.cast("long").alias("words"), position(F.col("shape"), F.least(share, F.lit(1.0))).alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), one), lambda x: x["words"] > 0)
    out = joined.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "passes", *carry)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows of mix() range-sorted by the position of their first pass; those never taken come last."""
    first = F.get("passes", F.lit(0))["position"]
    return mixed.withColumn("first_position", first).sort(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them: each as often as it is taken, whole, range-sorted by training position. Columns stay as they are; documents that the mix does not take go."""
    # Rows may repeat, ids too: each gets a number of its own, which is written down with it.
    columns = docs.columns
    rows = written(docs.toDF(*[f"x{i}" for i in range(len(columns))]).withColumn("row", F.monotonically_increasing_id()), "rows")
    name = lambda c: f"x{columns.index(c)}"
    passes = mix(rows, name(id_col), name(text_col), name(source_col), whole=True, carry=("row",)).where(F.size("passes") > 0).select("row", F.explode("passes.position").alias("position"))
    return rows.join(passes, "row").sort("position", "row").drop("row", "position").toDF(*columns)
