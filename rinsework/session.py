"""Session settings and small helpers that every other module shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def get_session(app: str = "rinsework", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster, spark-submit's settings win over these."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers must find this package when the driver was started from another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # rows hold whole texts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine (tests), a temporary
    one; on a cluster other executors wouldn't see that, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="rinsework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged_path(df: DataFrame, name: str) -> str:
    """Where df is written as Parquet in the shared folder. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rinsework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
