"""Session helpers: local sessions for tests and benches, and the checkpoint location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tracegauge") -> SparkSession:
    """A local session with the same settings the operators expect on a cluster (AQE, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master, where driver and executors share one
    disk; on a cluster a missing setting is an error, because a machine-local folder would be
    lost together with the executor that wrote it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="tracegauge-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)  # ours alone, and nothing outlives the process
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, its lineage ends, a lost executor costs nothing.

    Unlike an eager checkpoint it does not compute the rows twice. A table that was written here stays as it is.
    Tables lie under the application's own checkpoint folder, which may go when the application has ended.
    """
    if getattr(df, "_written", False):
        return df
    spark, schema = df.sparkSession, df.schema
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = True
    return out
