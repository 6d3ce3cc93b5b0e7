"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_fallback_root: str | None = None


def session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned under; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset."""
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(_fallback_root)
    return _fallback_root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder."""
    return f"{work_root(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the work folder and read it back: cuts lineage, survives lost executors. ``codec`` other than the session's."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where it is missing."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(jvm_path)] if files.exists(jvm_path) else []
