"""Files that steps leave for each other: lookup by name, schemas, small reports and settings, and steps that run once."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find(spark: SparkSession, root: str, name: str, parent: str | None = None, not_parent: str | None = None) -> str:
    """The first path, in order, of a file of that name (a glob) below root. parent, not_parent: what a folder of the path must, or must not, be called. Only names are read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    folders = F.split("path", "/")
    if parent is not None:
        paths = paths.where(F.array_contains(folders, parent))
    if not_parent is not None:
        paths = paths.where(~F.array_contains(folders, not_parent))
    first = paths.agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise FileNotFoundError(f"{name} below {root}")
    return first


def schema(spark: SparkSession, path: str) -> dict[str, str]:
    """Columns and types of a Parquet table; reads a footer only."""
    return dict(spark.read.parquet(path).dtypes)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows of a small report as a Markdown table; numbers that are not whole have four digits."""
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    rows = [df.columns, ["-"] * len(df.columns), *[[show(x).replace("|", "\\|") for x in r] for r in df.limit(most).collect()]]
    return "\n".join("|" + "|".join(r) + "|" for r in rows) + "\n"


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """Settings or figures of a step, as one line of JSON in a folder."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()["value"])


def done(spark: SparkSession, path: str) -> bool:
    """Whether a step wrote its table to the end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, made and written if no earlier run ended there; what a broken run left is overwritten."""
    if not done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def concat_parts(spark: SparkSession, parts: list[str], path: str) -> DataFrame:
    """The rows of several Parquet tables as one table at `path`; the parts go once it is written to the end. Columns are matched by name; a part that lacks one has nulls there."""
    tables = [spark.read.parquet(p) for p in parts]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.mode("overwrite").parquet(path)
    for p in parts:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.parquet(path)
