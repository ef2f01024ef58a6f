"""Generation jobs on a stream of requests, with state: attempts and the last output of each (prompt, paper).

A request is (prompt_id, paper_id, system_prompt, user_prompt).  A finished one is never asked for again, whether it comes
again in the stream or the job is killed and started again on its checkpoint; a failed one is asked for again by a timer
until its attempts are used up.  A dry run goes the same way without calling the model.  Every batch is a checkpoint, of
at most ``every`` files of requests.

Keys are dealt into BUCKETS, each a group of the stateful operator with a map of its keys: Python is called for a bucket's
rows at once, not for each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from arglake.operators.inference import Generator
from arglake.operators.prompts import render

KEYS = ["prompt_id", "paper_id"]
REQUEST = "prompt_id string, paper_id string, system_prompt string, user_prompt string"
OUTPUT = "prompt_id string, paper_id string, status string, attempt int, text string, error string, dry_run boolean, user_prompt string"
#: Groups of keys; fixed for a checkpoint.
BUCKETS = 1024
#: The provider that keeps this kind of state.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Job(StatefulProcessor):
    """State of a bucket: each key's status (open, done or failed), attempts and last output; of open ones the prompts and when they are due."""

    def __init__(self, model_factory: Callable[[], Generator], attempts: int, wait_ms: int, dry_run: bool):
        self.model_factory, self.attempts, self.wait_ms, self.dry_run = model_factory, attempts, wait_ms, dry_run
        self.model = None

    def init(self, handle) -> None:
        self.handle = handle
        key = "prompt_id string, paper_id string"
        self.state = handle.getMapState("requests", key, "status string, attempt int, text string")
        self.open = handle.getMapState("open", key, "due long, system_prompt string, user_prompt string")

    def _ask(self, key: tuple, system: str | None, user: str | None, attempt: int, now: int) -> tuple:
        text = error = None
        if self.dry_run:
            text = ""
        else:
            try:
                if self.model is None:
                    self.model = self.model_factory()
                text = self.model(system or "", user or "")["text"]
            except Exception as failure:  # a model's failure is an outcome of the request
                error = f"{type(failure).__name__}: {failure}"
        again = error is not None and attempt < self.attempts
        if again:
            self.open.updateValue(key, (now + self.wait_ms, system, user))
            self.handle.registerTimer(now + self.wait_ms)
        elif attempt > 1:
            self.open.removeKey(key)
        self.state.updateValue(key, ("open" if again else "failed" if error else "done", attempt, text))
        return (*key, "retry" if again else "failed" if error else "done", attempt, text, error, self.dry_run, user)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            new = []
            for prompt, paper, system, user in zip(*(part[c] for c in [*KEYS, "system_prompt", "user_prompt"])):
                if not self.state.containsKey((prompt, paper)):  # repeated requests are one
                    new.append(self._ask((prompt, paper), system, user, 1, now))
            if new:
                yield self._frame(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, until = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        for request in [tuple(k) for k, (due, *_) in self.open.iterator() if due <= until]:
            _, system, user = self.open.getValue(request)
            yield self._frame([self._ask(request, system, user, self.state.getValue(request)[1] + 1, now)])

    def close(self) -> None:
        self.model = None


def requests_of(prompts: DataFrame, papers: DataFrame, prompt_limit: int | None = None, paper_limit: int | None = None) -> DataFrame:
    """Each of the first prompts (by prompt_id) for each of the first papers (by paper_id), the paper's text in its place.

    ``prompts`` are (prompt_id, system_prompt, user_prompt), a few files, held as one array; papers (paper_id, paper_text)
    without a text are left out after the limit.
    """
    names = ["prompt_id", "system_prompt", "user_prompt"]
    few = sorted(map(tuple, prompts.select(names).collect()))[:prompt_limit]
    if paper_limit is not None:
        papers = papers.orderBy("paper_id").limit(paper_limit)
    each = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, p))) for p in few)) if few else F.expr("CAST(array() AS array<struct<prompt_id:string,system_prompt:string,user_prompt:string>>)")
    both = papers.where("paper_text IS NOT NULL").select(F.col("paper_id").cast("string").alias("paper_id"), "paper_text", F.explode(each).alias("p"))
    return both.select("p.prompt_id", "paper_id", *(render(F.col(f"p.{n}"), F.col("paper_text")).alias(n) for n in names[1:]))


def generated(requests: DataFrame, model_factory: Callable[[], Generator], attempts: int = 3, wait_seconds: float = 30.0, dry_run: bool = False) -> DataFrame:
    """A row (OUTPUT) for each attempt of the streamed ``requests``: done, failed, or retry where another attempt follows.

    ``model_factory`` makes a task's model, as for ``inference.generate``; what it raises is the attempt's error.  The query has
    to be started with STATE_STORE, as ``run_job`` does.
    """
    job = _Job(model_factory, attempts, int(1000 * wait_seconds), dry_run)
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")
    return requests.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(job, OUTPUT, "append", "ProcessingTime")


def request_stream(spark: SparkSession, path: str, every: int = 8) -> DataFrame:
    """Requests written as Parquet, up to ``every`` files a batch."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", every).parquet(path)


def run_job(requests: DataFrame, path: str, checkpoint: str, model_factory, attempts: int = 3, wait_seconds: float = 30.0, dry_run: bool = False, every: str | None = None):
    """Start the job: attempts go to ``path`` as JSON.  With ``every`` (a trigger interval) it goes on for new requests; without, it
    takes what there is, and timers go on firing until ``finish`` or a stop ends it."""
    writer = generated(requests, model_factory, attempts, wait_seconds, dry_run).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    conf, name = requests.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.set(name, before)


def _attempts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(OUTPUT).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], OUTPUT)


def finish(query, spark: SparkSession, path: str, look: float = 0.2) -> None:
    """Wait until all requests that were there when the job started are done or failed, then stop it."""
    while True:
        if query.awaitTermination(look):
            return
        last = query.lastProgress
        if last and last["numInputRows"] == 0:  # what was there has been read; timers may be left
            newest = _attempts(spark, path).groupBy(*KEYS).agg(F.max_by("status", "attempt").alias("status"))
            if newest.where("status = 'retry'").isEmpty():
                query.stop()
                return


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """Finished requests, a row each: done or failed, with the attempts that it took."""
    return _attempts(spark, path).where("status <> 'retry'")
