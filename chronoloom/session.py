"""Session helpers for tests, benchmarks and scripts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "chronoloom", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    as in tests, a scratch folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named:
        if not active.isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if active.isDefined():
        return active.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-chronoloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """Writes an intermediate result as a table in the shared folder and reads it back.

    For results that several branches of a plan read: they scan a columnar file
    instead of computing their common part again, and a lost executor costs a
    rescan, not a recomputation.
    """
    path = f"{checkpoint_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small iterated result."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
