"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: A word is a run of characters other than the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that ``spark.checkpoint.dir`` names; only where it is unset, in local runs and tests, a
    temporary one is set. On a cluster it must be named: executors do not see the driver's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: While a table is settled, its query's shuffle files go when it ends, rather than when the driver happens to collect
#: its garbage, and joins on hot keys are split even where that costs another shuffle.
SETTLING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate table with a checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    before = {k: spark.conf.get(k, "false") for k in SETTLING}
    for k, v in SETTLING.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """What a worker process keeps between batches and tasks: one thing at a time, so that operators run in turn by the
    same process (the stages of a pipeline) do not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]  # type: ignore[return-value]


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Hand a worker process's free memory back to the system: idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """A function of a task (over batches, or over one group) that gives memory back when it ends."""
    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def over_batches(batches):  # noqa: ANN001, ANN202
            try:
                yield from function(batches)
            finally:
                give_back()

        return over_batches

    def over_group(table):  # noqa: ANN001, ANN202
        try:
            return function(table)
        finally:
            give_back()

    def over_two_groups(left, right):  # noqa: ANN001, ANN202
        try:
            return function(left, right)
        finally:
            give_back()

    # Spark tells by the number of arguments what a function takes.
    return over_group if len(inspect.signature(function).parameters) == 1 else over_two_groups


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, records: int = 500, size: int = 8 << 20) -> None:
    """Keep Arrow batches small, in rows and in bytes: rows hold whole texts, and a worker's memory is bounded by what a
    batch holds. The settings stay: plans are made when the caller asks for rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
