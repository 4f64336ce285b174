"""Running metric meters over a stream (STR2), and results of a finished stream."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoloom.session import checkpoint_root


def running_meter(stream: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """The weighted mean so far and its squared form, per group.

    The state is three sums per group.
    """
    v, n = F.col(value), F.col(weight)
    sums = stream.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(v * n).alias("_s1"), F.sum(v * v * n).alias("_s2"))
    total = F.nullif(F.col("n"), F.lit(0))
    return sums.select(*by, "n", (F.col("_s1") / total).alias("mean"), F.sqrt(F.col("_s2") / total).alias("rms"))


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs a stream over what is there, however long it takes, and returns the latest row of each key.

    Every trigger appends its rows to a table in the shared folder; the
    checkpoint beside it makes a restart continue where it stopped.  State is
    kept in RocksDB, also where the session names another store.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query takes its settings along when it starts
        job = (stream.writeStream.outputMode("update").foreachBatch(keep)
               .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    job.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").drop("batch")
    columns = [c for c in rows.columns if c != "_batch" and c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
