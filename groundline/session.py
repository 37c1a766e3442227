"""Session construction for local runs, tests and benchmarks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "groundline", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with the settings every query of this library assumes (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one for a local session that names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="groundline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write `df` to the shared folder, bucketed and sorted by `key`, and read it back: joins and groups by the key need no shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", f"{shared_folder(spark)}/groundline/{table}").saveAsTable(table)
    return spark.table(table)
