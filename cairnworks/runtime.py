"""Session settings, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairnworks")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session has cores, for work in Python.

    A table of few files is dealt out once; one of many partitions, as any large table is, stays as it is. df must be a
    scan with narrow steps only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; without one a session within one machine gets a folder of its own, a cluster an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(?:\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnworks-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Run df once and cut its lineage in the reliable, shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_freed(df: DataFrame) -> DataFrame:
    """cut, and remove the shuffle files of df as soon as its rows are in the checkpoint."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        return cut(df)
    finally:
        conf.set(FREED, before)
