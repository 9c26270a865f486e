"""Experiment tracking as tables (S-11): runs, parameters and metrics, appended; a run's status is its latest row."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import flatten_metrics

RUNS = "run_id string, name string, status string, tags string, at timestamp"
FACTS = "run_id string, kind string, key string, value string, number double"


class Tracker:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, rows, schema: str, name: str) -> None:
        if rows:
            df = self.spark.createDataFrame(rows, schema)
            (df.withColumn("at", F.current_timestamp()) if name == "runs" else df).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def start(self, run_id: str, name: str, **tags) -> None:
        self._add([(run_id, name, "running", json.dumps(tags), None)], RUNS, "runs")

    def end(self, run_id: str, status: str = "done") -> None:
        self._add([(run_id, None, status, None, None)], RUNS, "runs")

    def params(self, run_id: str, **values) -> None:
        self._add([(run_id, "param", k, str(v), None) for k, v in values.items()], FACTS, "facts")

    def metrics(self, run_id: str, profile: dict) -> None:
        self._add([(run_id, "metric", k, None, float(v)) for k, v in flatten_metrics(profile).items()], FACTS, "facts")

    def artifact(self, run_id: str, name: str, payload: dict) -> None:
        self._add([(run_id, "artifact", name, json.dumps(payload, ensure_ascii=False, default=str), None)], FACTS, "facts")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(f"{self.path}/runs").groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("name").alias("name"))

    def facts(self) -> DataFrame:
        return self.spark.read.schema(FACTS).parquet(f"{self.path}/facts")
