"""Sessions with the settings that the engine is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def builder(name: str = "landtide", **conf: str) -> SparkSession.Builder:
    """A session builder: ANSI types, UTC, adaptive plans, Arrow between JVM and Python."""
    made = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        made = made.config(k, v)
    return made


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster: where it is installed)."""
    here = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if here not in paths:
        env["PYTHONPATH"] = ":".join([here, *paths])
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only in a local session that has none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="landtide-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for old in paths:
        where = jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, name: str, made: list[str], done: Sequence[str] = ()) -> DataFrame:
    """``df`` as a written table of the shared folder, whose path goes to ``made``; the tables ``done`` are deleted then."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    made.append(path)
    deleted(df.sparkSession, done)
    return df.sparkSession.read.schema(df.schema).parquet(path)
