"""Candidate searches over whole documents: the name is the whole first line, of any length.

The record view in SQL reads 200 characters of a document; these queries read all of them. They have no DuckDB twin and are
tested against plain Python. Documents without a text have an empty name and find nothing; without a known language they are
in no country and find nothing either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import blocking, selection
from matchloom.plans import matching
from matchloom.session import table
from matchloom.sources import lists


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, country, bucket, text) of every document."""
    name = F.trim(F.regexp_replace(F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)), "[^a-z0-9]+", " "))
    country = F.expr("CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' WHEN 'de' THEN 'Germany' WHEN 'es' THEN 'Spain' END")
    state = F.when(F.col("doc_id") % 10 != 0, F.col("source"))
    entity = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(entity.alias("id"), country.alias("country"), F.coalesce(state, F.lit(blocking.NONE)).alias("bucket"), name.alias("text"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    s1 = F.col("id").startswith("S1-")
    return rows.where(s1), rows.where(~s1)


def name_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.search_forward(_names(spark, sf_dir), *matching._sides(), 5, max_df=0.2)


def reverse_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.search_reverse(_names(spark, sf_dir), *matching._sides(), 3, max_df=0.2)


def rare_token_search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir).drop("bucket")
    return blocking.rare_tokens(*_sides(names), blocking.token_frequency(names), 10)


def match_lists_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As match_lists: a threshold, one owner, a margin, and a list for each query."""
    chosen = selection.select(name_search_whole(spark, sf_dir).withColumnRenamed("score", "p"), 0.5, 0.3)
    return lists.id_lists(chosen, _sides(_names(spark, sf_dir))[0].select(F.col("id").alias("s1")), "p")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (name_search_whole, reverse_search_whole, rare_token_search_whole, match_lists_whole)}
