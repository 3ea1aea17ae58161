"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.shared import bounded_batches

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode where none is set, as in tests."""
    bounded_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table: computed once, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table written to the shared folder as Parquet and read back; smaller than a checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Shuffles of tables that are written and of no more use leave the disks now: Spark removes them when the driver's JVM
    collects what refers to them, and a driver with memory to spare may not do so for half an hour."""
    gc.collect()
    spark.range(0).collect()  # each queue of listeners holds the last event, and with it that query's plan, until the next one
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()


#: Rows of a few numbers each that may be sent to every executor, and bytes of wider ones.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """A table marked for broadcast if it is counted to have at most ``rows`` rows, and at most
    ``BROADCAST_BYTES`` where rows of unequal size give their ``width`` in bytes; else it is shuffled."""
    df = cut(df)
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_print(text: Column) -> Column:
    """Hash that tells texts of one id apart; null has one of its own."""
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def released(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives the worker's free memory back when its task is done."""

    @functools.wraps(rows)
    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc nothing is to be done
            ctypes.CDLL(None).malloc_trim(0)

    return run
