"""What the whole library shares: the folder that driver and executors see, and the size of batches for Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker: cells may be long, so rows alone don't bound it.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by bytes, unless the session has set a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table computed once and kept in the cluster's checkpoint folder; a temporary one only in local mode, as in tests."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()
