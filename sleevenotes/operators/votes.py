"""Plurality votes. Counts are made first, with map-side combining, so a huge group costs one row for each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plurality(df: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """``by, winner, share, votes``: the most frequent non-empty key of each group.

    Ties go to the key seen first (least ``order``), then to the least key. The share is among non-empty votes.
    """
    counts = df.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(*by, F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    won = counts.groupBy(*by).agg(F.min_by(F.struct("_key", "_n"), F.struct(-F.col("_n"), "_first", "_key")).alias("_won"), F.sum("_n").alias("_all"))
    return won.select(*by, F.col("_won._key").alias("winner"), (F.col("_won._n") / F.col("_all")).alias("share"), F.col("_won._n").alias("votes"))


def display_form(df: DataFrame, by: list[str], raw: str, key: str, order: str) -> DataFrame:
    """``by, winner, share, votes, display``: the winning key, and its most frequent raw spelling."""
    won = plurality(df, by, key, order)
    spelled = plurality(df.join(won.withColumnRenamed("winner", key).select(*by, key), [*by, key]), by, raw, order)
    return won.join(spelled.select(*by, F.col("winner").alias("display")), by)


def multi_field(df: DataFrame, by: list[str], fields: list[str], order: str) -> DataFrame:
    """One vote over all fields: long rows ``by, field, winner, share, votes``.

    Rows are made longer by a generator, which leaves them where they are: dealt by ``by`` already, they stay so (what
    unpivots them forgets it)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return plurality(df.select(*by, order, F.inline(pairs)), [*by, "field"], "value", order)


def vote_key(c: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """Lower case, no bracketed phrases, punctuation as spaces, spaces collapsed, known suffixes stripped in order."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(out, r"[\(\[].*?[\)\]]", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", " "), r"\s+", " "))
    for s in suffixes:
        out = F.when(out.endswith(s.lower()), F.trim(F.substring(out, F.lit(1), F.length(out) - len(s)))).otherwise(out)
    return out


def plurality_sql(source: str, by: str, key: str, order: str) -> str:
    """DuckDB text of `plurality`."""
    return f"""(SELECT {by}, k AS winner, n * 1.0 / total AS share, n AS votes FROM (
    SELECT {by}, k, n, sum(n) OVER (PARTITION BY {by}) AS total, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, f, k) AS r
    FROM (SELECT {by}, {key} AS k, count(*) AS n, min({order}) AS f FROM {source} WHERE coalesce({key}, '') <> '' GROUP BY {by}, {key})) WHERE r = 1)"""
