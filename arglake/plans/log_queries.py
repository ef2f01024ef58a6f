"""Queries over run logs (stand-in: events) and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arglake.operators import inference, runlog
from arglake.operators.prompts import PLACEHOLDER
from arglake.plans.registry import Registry
from arglake.session import importable, table
from arglake.streaming import generation, incremental
from arglake.work import shared_dir

query = Registry()


def _own_folder(spark, name):
    return f"{shared_dir(spark)}/arglake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("""
WITH s AS (SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1)
SELECT event_type, n, mean, median, std, round(greatest(0, 100000 - n) * mean, 4) AS remaining FROM s
""")
def log_latency_eta(spark, sf_dir):
    stats = runlog.latency_stats(table(spark, sf_dir, "events"), "value", "event_id", "event_type").drop("last")
    return stats.withColumn("remaining", F.round(runlog.remaining_seconds(F.lit(100000), F.col("n"), F.col("mean")), 4))


@query("""
SELECT event_type, array_to_string(list(event_id ORDER BY event_id), ',') AS last FROM (SELECT event_type, event_id FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5) GROUP BY 1
""")
def log_last_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "event_id")
    return runlog.latency_stats(rows, "event_id", "event_id", "event_type").select("event_type", F.array_join(F.col("last").cast("array<string>"), ",").alias("last"))


@query()
def checkpoint_envelope(spark, sf_dir):
    return runlog.checkpoints(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_id", "event_type", "value"])


@query("""
SELECT user_id, count(*) AS attempts, min(ts) AS first_seen, max(ts) AS last_seen, (arg_max(props, event_id)) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1
""")
def failure_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "events").where("event_type = 'error'")
    return runlog.failures(log, "user_id", "ts", "props", "event_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return runlog.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1")
def stream_eta(spark, sf_dir):
    """The running statistics of the event stream once it is drained: equal to those of the whole table."""
    importable(spark)
    events = incremental.stream_file(spark, f"{sf_dir}/events.parquet")
    out = incremental.drain(incremental.running_latency(events, "event_type"), f"eta_{uuid.uuid4().hex}")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), "most")


@query("""
SELECT client_id, seq, op, segment, city, balance FROM client_changes WHERE client_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, valid_at DESC, change_id DESC) = 1
""")
def keyed_upsert(spark, sf_dir):
    """The stream of changes in a keyed table: each client's last change."""
    importable(spark)
    path = _own_folder(spark, "clients")
    changes = incremental.stream_file(spark, f"{sf_dir}/client_changes.parquet").where("client_id IS NOT NULL")
    rows = changes.withColumn("place", F.struct("seq", "valid_at", "change_id"))
    incremental.upsert_each(rows, f"{path}/table", f"{path}/checkpoint", "client_id", "place", shards=16).awaitTermination()
    return incremental.latest(spark, f"{path}/table").select("client_id", "seq", "op", "segment", "city", "balance")


@query("""
WITH p AS (SELECT item_id::VARCHAR AS prompt_id, text AS prompt FROM benchmark QUALIFY row_number() OVER (ORDER BY item_id::VARCHAR) <= 2)
SELECT prompt_id, doc_id::VARCHAR AS paper_id, 'done' AS status, 1 AS attempt, (length(prompt) + 1 + length(text))::INT AS prompt_chars FROM documents, p WHERE text IS NOT NULL
""")
def generation_dry_run(spark, sf_dir):
    """Two prompts for every document in a dry run of the generation job, which is started twice on one checkpoint."""
    path = _own_folder(spark, "generation")
    prompts = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("prompt_id"), F.lit("").alias("system_prompt"), F.concat("text", F.lit("\n" + PLACEHOLDER)).alias("user_prompt"))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.col("text").alias("paper_text"))
    generation.requests_of(prompts.orderBy("prompt_id").limit(2), papers).write.parquet(f"{path}/requests")
    for _ in range(2):
        job = generation.run_job(generation.request_stream(spark, f"{path}/requests"), f"{path}/out", f"{path}/checkpoint", inference.stub_generator, dry_run=True)
        generation.finish(job, spark, f"{path}/out")
    return generation.outputs(spark, f"{path}/out").select("prompt_id", "paper_id", "status", "attempt", F.length("user_prompt").alias("prompt_chars"))
