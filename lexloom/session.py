"""Session helpers: settings, the shared checkpoint folder, code shipping."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Parent of the package, where Python workers of a local session find it.
PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "lexloom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # text kernels are heavy for their bytes: small partitions are worth a task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers that share the driver's disk import this package.

    On a cluster the package is installed on (or shipped to) the executors;
    a path that does not exist there is ignored by Python.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_PARENT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_PARENT, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, made active.

    Only a local session without such a setting gets a folder of this machine;
    on a cluster that would lose data with its executors, so it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexloom-checkpoints-")
    sc.setCheckpointDir(where)
    return where


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores.

    A small table in one file would be read by one task. An input that is
    split enough already, as any large one, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
