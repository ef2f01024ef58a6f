"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that names none gets a temporary one, any other is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="arglake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/arglake/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: lineage ends there, and what comes after does not compute it again."""
    spark = df.sparkSession
    path = f"{_work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int = 100_000) -> int:
    """In how many parts ``df`` has about so many rows each, so that a task's memory does not grow with the table."""
    return max(1, -(-df.count() // rows))


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: call it once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
