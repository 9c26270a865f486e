"""Session defaults and tables shared between jobs."""

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    folder; on a cluster that would be one machine's folder, so there the setting is asked for."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="sangam-")
        atexit.register(shutil.rmtree, d[7:], True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: a cut of the lineage that survives lost executors.

    The table stays until the session ends, because the returned frame is lazy; then the file system it lies on drops it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows, counted without reading on beyond that."""
    return df.limit(most + 1).count() <= most


def width(df: DataFrame, per: int = 32 << 20) -> int:
    """Partitions for a shuffle of a table as it is read: one for each `per` bytes of its files, at least the session's.

    Frames whose size Spark doesn't know (it then assumes the largest number) get the session's."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_width(df.sparkSession), -(-size // per) if size < 1 << 50 else 0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application: they need not find it on their own path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sangam-")  # of the driver only: addPyFile sends the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"sangam-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(root)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a small input comes in fewer partitions than half of them; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
