"""Order at any size: places in a total order, numbers within keys however hot, and medians from counts.

A window over everything, or over a key that a third of all rows share, is one task. Here rows are sorted by ranges that
Spark's range partitioner cuts from samples, over the keys *and* what orders them within a key, so a hot key spreads over
many partitions. The sorted table is settled; a row's place in its partition and the rows of all partitions before it (one
number for each partition) give its place. What belongs to a key reaches its rows by key and partition: a key has no more
rows there than there are partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import settled

#: Columns that `positions` adds besides the place: the partition, and Spark's own number of the row.
PART, OWN = "_part", "_own"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def positions(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with ``name``, a row's place (from 1) in the total order, and `PART`, the range it is in.

    Rows equal in all of ``order`` stay in one range, in no order of their own; give enough columns to tell rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settled(ranged.withColumns({PART: F.spark_partition_id(), OWN: F.monotonically_increasing_id()}))
    sizes = placed.groupBy(PART).agg(F.count("*").alias("_rows"))  # as many rows as there are ranges
    before = sizes.select(F.col(PART).alias("_p"), (F.sum("_rows").over(Window.orderBy(PART)) - F.col("_rows")).alias("_before"))
    local = F.col(OWN) - F.shiftleft(F.col(PART).cast("long"), 33)
    return placed.join(F.broadcast(before), F.col(PART) == F.col("_p")).withColumn(name, F.col("_before") + local + 1).drop("_p", "_before", OWN)


def spread(placed: DataFrame, by: list[str], facts: DataFrame) -> DataFrame:
    """Rows of `positions` with the columns that ``facts`` has for their keys (null where it has none); ``facts`` has a row
    for a key at most, null keys too. Keys meet ``facts`` once for each range that has them, and rows meet those."""
    own = placed.select(PART, *by).distinct()
    theirs = facts.select(*[F.col(c).alias(f"_f_{c}") for c in by], *[c for c in facts.columns if c not in by])
    met = own.join(theirs, _all([F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in by]), "left").drop(*[f"_f_{c}" for c in by])
    told = met.select(F.col(PART).alias("_q"), *[F.col(c).alias(f"_k_{c}") for c in by], *theirs.columns[len(by) :])
    return placed.join(told, _all([F.col(PART) == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]])).drop("_q", *[f"_k_{c}" for c in by])


def number_within(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: a row's number (from 1) among those of its key, in order; and `PART`, for `spread`."""
    placed = positions(df, [*by, *order], "_place")
    firsts = placed.groupBy(PART, *by).agg(F.min("_place").alias("_first"))
    # A key that runs on over several ranges begins in the first of them.
    begins = firsts.groupBy(*by).agg(F.min("_first").alias("_begin"))
    return spread(placed, by, begins).withColumn(name, F.col("_place") - F.col("_begin") + 1).drop("_place", "_begin")


def medians(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``by`` and the exact median of the values that are not null, from counts: equal values are counted before they are
    shuffled, and what is sorted are a key's distinct values. A key without values has no row."""
    counts = df.select(*by, value.cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    ordered = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(ordered)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (F.col("_upto") >= place), F.col("_v")))
    middle = ranked.groupBy(*by).agg(holds(F.expr("(_all + 1) div 2")).alias("_low"), holds(F.expr("(_all + 2) div 2")).alias("_high"))
    return middle.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * 0.5).alias(name))


def gap_ranges(df: DataFrame, by: list[str], number: Column, block: int = 1 << 16) -> DataFrame:
    """``by, first, last, missing``: every run of whole numbers that a key lacks between its least and its greatest.

    Gaps and islands over distinct numbers: a gap lies between neighbours within a block of numbers, or between the
    neighbouring ends of two blocks, so that no task sorts a whole key."""
    have = df.select(*by, number.cast("long").alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_block", F.floor(F.col("_k") / block))
    inner = have.select(*by, F.col("_k").alias("_a"), F.lead("_k").over(Window.partitionBy(*by, "_block").orderBy("_k")).alias("_b"))
    ends = have.groupBy(*by, "_block").agg(F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    outer = ends.select(*by, F.col("_high").alias("_a"), F.lead("_low").over(Window.partitionBy(*by).orderBy("_block")).alias("_b"))
    apart = inner.unionByName(outer).filter(F.col("_b") - F.col("_a") > 1)
    return apart.select(*by, (F.col("_a") + 1).alias("first"), (F.col("_b") - 1).alias("last"), (F.col("_b") - F.col("_a") - 1).alias("missing"))
