"""Run a stream over the files that are there and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.tables import new_folder

#: Stateful processors need this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stream(stream: DataFrame, mode: str, path: str) -> list[dict]:
    """Read the files that are new since the last run with ``path``, and write the result below it; the progress of each
    micro-batch.

    A micro-batch writes a folder of its own anew, so that one that is repeated after a failure does not count twice;
    ``complete`` results replace each other.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
        query.awaitTermination()
        return [dict(p) if isinstance(p, dict) else p for p in query.recentProgress]
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def result(stream: DataFrame, path: str) -> DataFrame:
    """What runs with ``path`` have written so far."""
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def available_now(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that the stream gives for its present files; ``complete`` results replace each other, others are appended."""
    path = new_folder(stream.sparkSession, "streamed")
    run_stream(stream, mode, path)
    return result(stream, path)
