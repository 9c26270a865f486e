"""Corpus files and job records (S-1 to S-3, S-10 to S-12)."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required=("text",), schema: str | None = None) -> DataFrame:
    """A corpus with quoted, possibly multi-line cells. Columns with a blank header are dropped; a missing required one is an error."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    df = df.drop(*[c for c in df.columns if c.strip() == "" or c.startswith("Unnamed:") or (c.startswith("_c") and c[2:].isdigit())])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise RuntimeError(f"missing columns {missing}; there are {df.columns}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def job_status(jobs: DataFrame) -> DataFrame:
    """(rec_id, job_id, status, progress, message, error, saved_at): blank and broken bodies are left out, as on recovery."""
    schema = "status string, progress string, message string, dataset_name string, batch_size string, error string"
    b = jobs.where("body is not null and trim(body) <> ''").select("rec_id", "job_id", "saved_at", F.from_json("body", schema, {"mode": "PERMISSIVE"}).alias("b"), F.expr("try_parse_json(body)").isNotNull().alias("ok"))
    state = F.coalesce(F.get_json_object("b.status", "$.state"), F.col("b.status"))
    return b.where("ok").select("rec_id", "job_id", state.alias("status"), F.col("b.progress").cast("double").alias("progress"), "b.message", "b.error", "saved_at")


def latest_status(jobs: DataFrame) -> DataFrame:
    """(job_id, status, n_records): the record saved last counts."""
    return job_status(jobs).groupBy("job_id").agg(F.max_by("status", F.struct("saved_at", "rec_id")).alias("status"), F.count("*").alias("n_records"))


def write_manifest(path: str, spark: SparkSession | None = None, **facts) -> None:
    """The description of an experiment as JSON beside its output; with a session, on any file system."""
    text = json.dumps(facts, ensure_ascii=False, indent=1, default=str)
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_records(jobs: DataFrame, path: str) -> None:
    """S-10, the sink: the latest record of each job, one JSON line per job, in a folder of its own."""
    last = jobs.where("job_id is not null").groupBy("job_id").agg(F.max_by("body", F.struct("saved_at", "rec_id")).alias("value"))
    last.select("job_id", F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).where("value is not null").write.mode("overwrite").partitionBy("job_id").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """S-10, recovery: (job_id, body) of every record that a sink wrote and that is JSON; blank and broken ones are left out."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.where("try_parse_json(value) is not null").select(F.col("job_id").cast("string").alias("job_id"), F.col("value").alias("body"))


def flatten_metrics(profile: dict, prefix: str = "") -> dict[str, float]:
    """Numbers of a nested result under dotted names; truth values are left out."""
    out = {}
    for k, v in profile.items():
        if isinstance(v, dict):
            out |= flatten_metrics(v, f"{prefix}{k}.")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[prefix + k] = v
    return out
