"""Results of streams as tables, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is not set, on a local master only, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Local state in RocksDB, so that state need not fit in an executor's heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its result, written to Parquet with a checkpoint of its progress.

    In ``append`` mode results go to the file sink, each once. A ``complete`` result replaces the table at each
    micro-batch.
    """
    spark = df.sparkSession
    at = shared_folder(spark, "stream")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        writer = df.writeStream.option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").start(f"{at}/table")
        else:
            query = writer.foreachBatch(lambda x, _: x.write.mode("overwrite").parquet(f"{at}/table")).start()
        query.awaitTermination()
    finally:
        key = "spark.sql.streaming.stateStore.providerClass"
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(f"{at}/table")
