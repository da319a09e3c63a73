"""Keyed tables in hash buckets, so that an upsert rewrites only the buckets that its changes touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import latest
from ..tables import settled

BUCKET = "_bucket"


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias(BUCKET)


def write(df: DataFrame, path: str, by: list[str], buckets: int = 64) -> None:
    """A keyed table in ``buckets`` folders; a key's rows are in one."""
    df.withColumn(BUCKET, _bucket(by, buckets)).repartition(buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert(changes: DataFrame, path: str, by: list[str], order: list[Column], buckets: int = 64) -> list[int]:
    """Bring rows into a table of `write`: of each key the first row by ``order`` stays, of equal ones that of the changes.

    Only buckets with changes are read (partition pruning) and written again (dynamic overwrite); their numbers are
    returned. Of many changes of one key only the first is shuffled (`latest`). The merged rows are settled before the old
    ones go, so an upsert that breaks off can be run again."""
    spark = changes.sparkSession
    new = settled(latest(changes, by, order).withColumn(BUCKET, _bucket(by, buckets)))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
    if not touched:
        return []
    old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = settled(latest(both, by, [*order, F.desc("_new")]).drop("_new"))
    merged.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched
