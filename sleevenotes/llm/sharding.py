"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number; a keyed permutation of ``0 .. n-1`` moves it to a position, and the position
fixes its place: ``shard = position mod shards``, ``slot = position div shards``. Shard sizes differ by one row at
most, the order within a shard is a reproducible shuffle, and both directions can be computed from the number alone
(`place_of`, `number_at`), so a reader can find any row without a lookup table.

*Row numbers.* Rows fall into ``blocks`` by CRC-32 of their key; a row's number is its rank within its block plus the
rows of all earlier blocks. Only the narrow key columns are shuffled, equal rows are counted before they are numbered,
and the one global step runs over the ``blocks`` block totals, whatever the input size.

*Permutation.* An alternating Feistel network on ``a x b`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``. The
domain exceeds n by less than ``a``; positions of n or more are walked on along their cycle until they fall below n.

Defined cases: null keys are a key of their own; equal rows get different positions; an empty table gives an empty
result; other columns of the input play no part. Equal texts are dealt like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME = 2147483647
#: First factor, increment, mask and second factor of each round function.
ROUNDS = (
    (1103515245, 12345, 715827882, 48271), (1664525, 1013904223, 1431655765, 69621), (22695477, 7, 858993459, 39373),
    (134775813, 11, 1717986918, 16807), (214013, 2531011, 252645135, 62089911), (69069, 5, 2021161080, 630360016),
)
#: With fewer than one in sqrt(n) positions to skip, a longer walk cannot happen in practice; it would be an error.
MAX_WALK = 64


def _round(x: str, k: int, seed: int, xor: str) -> str:
    """Modular products with an exclusive or between them; x stands in it once, so that nested rounds stay short."""
    factor, add, mask, again = ROUNDS[k]
    inner = f"((({x}) * {factor} + {add + seed % PRIME}) % {PRIME})"
    return f"((({xor.format(inner, mask)}) * {again}) % {PRIME})"


def feistel_sql(x: str, a: str, b: str, seed: int = 0, div: str = "div", xor: str = "{} ^ {}") -> str:
    """SQL text of the network's value at ``x``; ``div`` and ``xor`` are the dialect's integer division and exclusive or."""
    left, right = f"(({x}) {div} ({b}))", f"(({x}) % ({b}))"
    for k in range(0, len(ROUNDS), 2):
        left = f"(({left} + {_round(right, k, seed, xor)}) % ({a}))"
        right = f"(({right} + {_round(left, k + 1, seed, xor)}) % ({b}))"
    return f"({left} * ({b}) + {right})"


def _radices(n: int) -> tuple[int, int]:
    a = max(1, int(n**0.5))
    a += a * a < n
    return a, max(1, -(-n // a))


def _f(x: int, k: int, seed: int) -> int:
    factor, add, mask, again = ROUNDS[k]
    return ((x * factor + add + seed % PRIME) % PRIME ^ mask) * again % PRIME


def place_of(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of a row number among n."""
    a, b = _radices(n)
    x = number
    while True:
        left, right = divmod(x, b)
        for k in range(0, len(ROUNDS), 2):
            left = (left + _f(right, k, seed)) % a
            right = (right + _f(left, k + 1, seed)) % b
        x = left * b + right
        if x < n:
            return x % shards, x // shards


def number_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Row number at a place: the network run backwards."""
    a, b = _radices(n)
    x = slot * shards + shard
    while True:
        left, right = divmod(x, b)
        for k in reversed(range(0, len(ROUNDS), 2)):
            right = (right - _f(left, k + 1, seed)) % b
            left = (left - _f(right, k, seed)) % a
        x = left * b + right
        if x < n:
            return x


def number_rows(keys: DataFrame, block: Column, blocks: int = 4096) -> DataFrame:
    """``keys`` with ``row_number`` (dense from 0) and ``n_rows``; equal rows are counted first and then told apart."""
    names = keys.columns
    blocked = keys.withColumn("_block", F.pmod(block, F.lit(blocks)).cast("int"))
    totals = blocked.groupBy("_block").agg(F.count("*").alias("_rows"))
    ordered = Window.orderBy("_block")  # over at most `blocks` rows
    offsets = totals.select(
        "_block",
        (F.sum("_rows").over(ordered) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    within = Window.partitionBy("_block").orderBy(*names)
    counted = blocked.groupBy("_block", *names).agg(F.count("*").alias("_copies"))
    return (
        counted.withColumn("_rank", F.sum("_copies").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies"))
        .join(F.broadcast(offsets), "_block")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(*names, (F.col("_before") + F.col("_rank") + F.col("_copy")).alias("row_number"), "n_rows")
    )


def deal(keys: DataFrame, block: Column, shards: int, seed: int = 0, blocks: int = 4096) -> DataFrame:
    """``keys`` with ``row_number``, ``n_rows``, ``shard`` (int) and ``slot`` (long)."""
    numbered = number_rows(keys, block, blocks)
    sized = numbered.withColumn("_a", F.ceil(F.sqrt("n_rows"))).withColumn("_b", F.expr("(n_rows + _a - 1) div _a"))
    first = sized.withColumn("_y", F.expr(feistel_sql("row_number", "_a", "_b", seed)))
    walk = f"aggregate(sequence(1, {MAX_WALK}), _y, (v, i) -> if(v < n_rows, v, {feistel_sql('v', '_a', '_b', seed)}))"
    walked = first.withColumn("_y", F.expr(f"if(_y < n_rows, _y, {walk})"))
    checked = walked.withColumn("_y", F.when(F.col("_y") < F.col("n_rows"), F.col("_y")).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))
    return checked.select(*keys.columns, "row_number", "n_rows", F.expr(f"cast(_y % {shards} as int)").alias("shard"), F.expr(f"_y div {shards}").alias("slot"))
