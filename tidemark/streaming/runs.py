"""Streams that run once over what there is, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..work import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there, as exactly-once Parquet files in the shared folder, and reads these. With the same checkpoint and out, a later call goes on where the last one ended. State lies in RocksDB, as timers and typed state need it."""
    spark = stream.sparkSession
    out, checkpoint = out or work_path(spark, f"{name}-out"), checkpoint or work_path(spark, f"{name}-state")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
