"""A table with one row a key, kept in shards by key hash; a commit rewrites only the shards of its keys.

    <path>/data/commit=<n>/shard=<k>/*.parquet    rows of shard k as commit n wrote them
    <path>/manifest/<n>.json                      which commit holds each shard, and the schema

A commit writes its shards first and then puts its manifest in place by a rename: readers see all of it or nothing, and a
commit that broke off is written again.  A commit whose manifest is there is not repeated, so that a replayed batch changes
nothing.  One writer a table; readers need no lock, as files live on for ``KEEP`` commits after they were replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits for which replaced files are kept.
KEEP = 2
_INTERNAL = ("_arrival", "_order", "_shard")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str, shards: int = 64):
        """``order`` says which of a key's rows stays: the last, and of equals the one that came last.  ``shards`` holds for a new table."""
        self.spark, self.path, self.key, self.order, self.shards = spark, path.rstrip("/"), key, order, shards
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._paths.Path(f"{self.path}/{name}" if name else self.path)

    # --- manifests ----------------------------------------------------------------------------

    def commits(self) -> list[int]:
        """Numbers of the commits whose manifest is there, in order."""
        folder = self._at("manifest")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, number: int) -> dict:
        stream = self._files.open(self._at(f"manifest/{number:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        draft, final = self._at(f"manifest/_draft-{number:012d}"), self._at(f"manifest/{number:012d}.json")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"commit {number} of {self.path} is there: another writer is at work")

    # --- rows ---------------------------------------------------------------------------------

    def _rows(self, manifest: dict, shards: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        held = {k: n for k, n in manifest["shards"].items() if shards is None or k in shards}
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/commit={n}/shard={k}" for k, n in sorted(held.items())))

    def read(self) -> DataFrame:
        """The rows of the last commit."""
        done = self.commits()
        if not done:
            raise FileNotFoundError(f"no commit in {self.path}")
        return self._rows(self.manifest(done[-1]))

    def upsert(self, rows: DataFrame, number: int) -> bool:
        """Commit ``rows`` under a ``number``, which rises from commit to commit; False if it was committed before."""
        done = self.commits()
        if done and number <= done[-1]:
            return False
        last = self.manifest(done[-1]) if done else {"shards": {}, "shard_count": self.shards, "schema": rows.schema.jsonValue()}
        count = last["shard_count"]
        shard = F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")
        touched = sorted(str(r[0]) for r in rows.select(shard.alias("s")).distinct().collect())  # at most a row a shard
        before = self._rows(last, touched)
        both = before.withColumn("_arrival", F.lit(0)).unionByName(rows.withColumn("_arrival", F.lit(1)))
        names = [c for c in both.columns if c not in _INTERNAL]
        # a partial maximum by key; which of fully equal places wins is settled by the row's hash
        place = F.struct(F.col(self.order), "_arrival", F.xxhash64(*names))
        kept = both.groupBy(self.key).agg(F.max_by(F.struct(*(F.col(f"`{c}`").alias(c) for c in names)), place).alias("_r")).select("_r.*")
        dealt = kept.withColumn("shard", shard).repartition(max(1, min(count, len(touched))), "shard")
        dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/data/commit={number}")
        self._publish(number, last | {"shards": last["shards"] | dict.fromkeys(touched, number), "commit": number})
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Delete the files that none of the last manifests names, and manifests before these."""
        done = self.commits()
        recent = [self.manifest(n) for n in done[-KEEP - 1 :]]
        named = {(str(n), k) for m in recent for k, n in m["shards"].items()}
        for folder in self._files.listStatus(self._at("data")):
            number = folder.getPath().getName().removeprefix("commit=")
            parts = list(self._files.listStatus(folder.getPath()))
            shards = [s for s in parts if s.getPath().getName().startswith("shard=")]
            old = [s for s in shards if (number, s.getPath().getName().removeprefix("shard=")) not in named]
            if len(old) == len(shards):
                self._files.delete(folder.getPath(), True)
            else:
                for s in old:
                    self._files.delete(s.getPath(), True)
        for n in done[: -KEEP - 1]:
            self._files.delete(self._at(f"manifest/{n:012d}.json"), False)
