"""Incremental forms on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arglake.streaming.keyed_table import KeyedTable


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 16, glob: str | None = None) -> DataFrame:
    """A Parquet folder as a stream, with the schema of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def stream_file(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file or folder as a stream: a single file is found by its name in its folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    is_file = "." in name and spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).limit(1).count() > 0
    if is_file:
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def running_latency(events: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """n, mean and most of a value so far, for complete mode."""
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))


def windowed_counts(events: DataFrame, *by: str, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows, closed by a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def save_each(outputs: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append outputs as JSON, batch by batch; a restart goes on where the checkpoint is."""
    writer = outputs.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_each(outputs: DataFrame, path: str, checkpoint: str, key: str, order: str, shards: int = 64):
    """A table with one row a key, the last by ``order`` (of equals the one that came last): each batch is a commit of a
    ``KeyedTable``, which rewrites the shards of its keys only; a replayed batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order, shards).upsert(batch, number)

    return outputs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last batch that ``upsert_each`` has committed."""
    return KeyedTable(spark, path, "", "").read()


def drain(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming result over what there is into a memory table."""
    spark = result.sparkSession
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
