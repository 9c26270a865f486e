"""An embedding cache as a table (S-6 to S-9): key = sha256 of model, zero byte and text; the latest write wins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _at(spark: SparkSession, path: str):
    """(file system, path) of a folder, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


SCHEMA = "cache_key string, model_name string, vector array<float>, created_at timestamp"


def key(model: str | Column, text: Column) -> Column:
    m = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(m, F.lit("\x00"), text), 256)


class EmbeddingCache:
    """Parquet under `path`, one folder per model; writes append, reads take the latest vector of each key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        fs, p = _at(self.spark, self.path)
        if not fs.exists(p):  # nothing was put yet; any other failure to read is one
            return self.spark.createDataFrame([], SCHEMA)
        raw = self.spark.read.schema(SCHEMA).parquet(self.path)
        return raw.groupBy("model_name", "cache_key").agg(F.max_by("vector", "created_at").alias("vector"), F.max("created_at").alias("created_at"))

    def put(self, texts: DataFrame, model: str) -> None:
        """texts: (text, vector)."""
        rows = texts.where("text is not null and vector is not null").select(key(model, F.col("text")).alias("cache_key"), F.lit(model).alias("model_name"), F.col("vector").cast("array<float>").alias("vector"), F.current_timestamp().alias("created_at"))
        rows.write.mode("append").partitionBy("model_name").parquet(self.path)

    def get(self, texts: DataFrame, model: str, text_col: str = "text") -> DataFrame:
        """The rows with their vector, null where unknown."""
        known = self.table().where(F.col("model_name") == model).select("cache_key", "vector")
        return texts.withColumn("cache_key", key(model, F.col(text_col))).join(known, "cache_key", "left").drop("cache_key")

    def misses(self, texts: DataFrame, model: str, text_col: str = "text") -> DataFrame:
        """Distinct texts without a vector."""
        t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("cache_key", key(model, F.col("text")))
        return t.join(self.table().where(F.col("model_name") == model).select("cache_key"), "cache_key", "left_anti").select("text")

    def encode(self, texts: DataFrame, model: str, encode_fn, dim: int, text_col: str = "text") -> DataFrame:
        """Read-through: distinct unknown texts are encoded (list of texts to list of vectors) and kept; what stays unknown is zero."""

        def run(frames):
            import pandas as pd

            for f in frames:
                yield pd.DataFrame({"text": f["text"], "vector": [list(map(float, v)) for v in encode_fn(f["text"].tolist())]})

        todo = self.misses(texts, model, text_col)
        if not todo.isEmpty():
            self.put(todo.mapInPandas(run, "text string, vector array<float>"), model)
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return self.get(texts, model, text_col).withColumn("vector", F.coalesce("vector", zero))

    def stats(self) -> DataFrame:
        return self.table().groupBy("model_name").agg(F.count("*").alias("n"))

    def clear(self, model: str | None = None) -> None:
        """Drop all vectors, or those of one model."""
        fs, p = _at(self.spark, f"{self.path}/model_name={model}" if model else self.path)
        fs.delete(p, True)
