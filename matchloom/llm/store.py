"""Shared storage: checkpoints and scratch tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it is unset, as in tests, a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="matchloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return (spark.conf.get("spark.checkpoint.dir", None) or found).rstrip("/")


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of BATCH_ROWS rows. Spark's own default of 10,000 rows takes hundreds of MB outside the heap where texts are long; a setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table: a reliable checkpoint, which Spark's cleaner removes once unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/matchloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a wide table: written once as Parquet into the shared folder and read back."""
    return written_at(df, scratch(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of the caller's, who removes it when nothing reads it any more."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that no later job reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
