"""Session factory, table loading and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tesselle", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE. The master and the memory are those of spark-submit; only where
    none is configured is it a local session of so many cores."""
    from pyspark import SparkConf

    conf = SparkConf()
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not conf.contains("spark.master") and "SPARK_REMOTE" not in os.environ:
        b = b.master(f"local[{cores}]").config("spark.driver.memory", conf.get("spark.driver.memory", "8g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its own;
    a cluster without one is refused, as its machines would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
            folder = tempfile.mkdtemp(prefix="tesselle-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so a lost executor costs no recomputation. Checkpoints are removed once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the shared folder: for tables of many rows, which compress well and are read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """The table marked for broadcast if it has at most ``most`` rows, else as it is; counting stops at the bound."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class TooLarge(ValueError):
    """A table that must reach the driver has more rows than the documented bound."""


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must stay small; more than ``most`` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"{what}: more than {most} rows")
    return rows
