"""Work on groups that are small, however many there are, with one shuffle; large ones go by partial counts.

Aggregates by (folder, field, value), (folder, field) and folder are a shuffle each, and long rows cross all of them. Rows
dealt by the folder once meet all of these aggregates, and joins of folders, where they are. A group of more than `MOST`
rows would be one task's: such groups are told by counting and go through the same work undealt, where counts are combined
before every shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settled

#: Rows of a group that one task may meet.
MOST = 50_000


def by_key(tables: list[DataFrame], key: str, work: Callable[..., DataFrame], most: int = MOST, large: Callable[..., DataFrame] | None = None, deal: bool = True) -> DataFrame:
    """``work(*tables)``, which must treat each value of ``key`` on its own; groups of more than ``most`` rows by ``large``
    if it is given. ``deal``: rows are dealt by the key first (else ``work`` groups by nothing else, so it need not be)."""
    sizes = reduce(DataFrame.unionByName, [t.select(key) for t in tables]).groupBy(key).agg(F.count("*").alias("_rows"))
    apart = settled(sizes.filter(F.col("_rows") > most).select(F.col(key).alias("_large")))
    dealt = lambda some: work(*[t.repartition(key) if deal else t for t in some])
    if apart.isEmpty():
        return dealt(tables)
    split = lambda how: [t.join(apart, t[key].eqNullSafe(apart["_large"]), how) for t in tables]
    return dealt(split("left_anti")).unionByName((large or work)(*split("left_semi")))
