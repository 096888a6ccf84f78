"""Runs of stages with tables between them: each stage is written once and skipped when nothing that it reads changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Options that say how a run goes, not what comes out.
RESOURCES = frozenset({"workers", "memory", "shuffle_partitions", "profile"})
#: Settings by the share of a machine that a run may take.
PROFILES = {"interactive": {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}, "balanced": {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"}, "throughput": {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m"}}


def identity(options: Mapping[str, object], inputs: Mapping[str, object]) -> str:
    """Digest of inputs and of the options that matter to the result; code and resources do not."""
    kept = {k: v for k, v in options.items() if k not in RESOURCES}
    return hashlib.sha256(json.dumps([kept, inputs], sort_keys=True, default=str).encode()).hexdigest()


class Run:
    """A folder with a table for each stage and a receipt beside it. The folder may be on any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, options: Mapping[str, object], inputs: Mapping[str, object]):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity(options, inputs)
        self.cached: list[str] = []

    def receipt(self, stage: str) -> dict | None:
        path = f"{self.folder}/{stage}.receipt"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return json.loads(self.spark.read.text(path).first()[0])

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read if its receipt is of this run, refused if it is of another, else made now."""
        path = f"{self.folder}/{name}"
        found = self.receipt(name)
        if found and found["identity"] != self.identity:
            raise ValueError(f"stage {name} in {self.folder} was made from other inputs or options")
        if found:
            self.cached.append(name)
            return self.spark.read.parquet(path)
        build().write.mode("overwrite").parquet(path)  # what an interrupted run left has no receipt
        out = self.spark.read.parquet(path)
        text = json.dumps({"stage": name, "identity": self.identity, "rows": out.count()})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.receipt")
        return out


def run_stages(run: Run, stages: Sequence[tuple[str, Callable[[dict], DataFrame]]]) -> dict[str, DataFrame]:
    """Stages in order; each gets the tables of those before it."""
    made: dict[str, DataFrame] = {}
    for name, build in stages:
        made[name] = run.stage(name, lambda build=build: build(made))
    return made
