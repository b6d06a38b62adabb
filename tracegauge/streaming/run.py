"""Read tables as streams and run a streaming plan over everything available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracegauge.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, sf_dir: str, name: str, bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """One table as a stream, whether it is a folder of part files or one file; bytes bound a micro-batch.

    Of the inputs of one trigger at least one file is read, so a single larger file is one batch.
    """
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", bytes_per_trigger)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB on the executors, with checkpoints in the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input and return the written result.

    Output and checkpoint live under the session's shared checkpoint folder, so any executor can
    take over. ``update`` results are written per micro-batch with their batch number.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

        q = w.outputMode(mode).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
