"""Spark session settings and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_stored: list[str] = []


def build_session(app_name: str = "textlens", master: str | None = None, **conf: object) -> SparkSession:
    """Session with the settings the library is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, as in tests, may fall back on a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="textlens-")
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run under the shared folder."""
    path = os.path.join(shared_dir(spark), "textlens", f"{name}-{uuid.uuid4().hex}")
    _stored.append(path)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and read it back.

    This cuts the lineage: the rows survive the loss of executors, every later use reads the same rows,
    and Spark knows the size of what it reads. `release_scratch` removes the tables.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it; no frame that reads from it may be used afterwards."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the storage that Spark takes it from, the default one where it names none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def release_scratch(spark: SparkSession) -> None:
    """Remove the tables this process has stored; no frame that reads them may be used afterwards."""
    for path in _stored:
        remove(spark, path)
    _stored.clear()
