"""Shared pieces of the corpus operators: shared-folder tables, batch plumbing, word tables."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegauge.session import ensure_checkpoint_dir

#: ASCII white space, the same set that ``bytes.split()`` splits on.
SPACE = r"[\x20\x09-\x0D]+"
#: ``bytes.translate`` tables: A-Z lower-cased; and, beside that, every ASCII byte that is no letter or digit made a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = bytes(c if (c := LOWER[b]) >= 128 or chr(c).isalnum() else 32 for b in range(256))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (a temporary one only where that is unset, on a local master)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, lost executors cost nothing.

    Pass the frame without keeping it: its shuffle files can go as soon as the table is there.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    del df
    release_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of frames that nothing refers to any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once: a lambda variable is bound, a column would be inlined."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-task setup: ``make()`` builds the function that is applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def with_text(batch: pa.RecordBatch, column: str, texts: list[str | None], keep: list[bool] | None = None) -> pa.RecordBatch:
    """The batch with another text column, and only the rows to keep."""
    i = batch.schema.get_field_index(column)
    cols = list(batch.columns)
    cols[i] = pa.array(texts, cols[i].type)
    out = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
    return out if keep is None else out.filter(pa.array(keep))
