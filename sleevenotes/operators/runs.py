"""Runs, sessions and logs: comparison, resumption, reconciliation and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import PART, number_within, spread


def diff(a: DataFrame, b: DataFrame, moved: float = 0.05) -> DataFrame:
    """Full outer comparison of two runs by proposed name."""
    x = a.select("proposed_name", F.col("destination").alias("destination_a"), F.col("confidence").alias("confidence_a"))
    y = b.select("proposed_name", F.col("destination").alias("destination_b"), F.col("confidence").alias("confidence_b"))
    change = (
        F.when(F.col("destination_b").isNull(), "only_a").when(F.col("destination_a").isNull(), "only_b").when(F.col("destination_a") != F.col("destination_b"), "destination_changed")
        .when(F.abs(F.col("confidence_a") - F.col("confidence_b")) > moved, "confidence_moved").otherwise("same")
    )
    return x.join(y, "proposed_name", "full_outer").withColumn("change", change)


def reconcile(manifest: DataFrame, disk: DataFrame, key: str = "name") -> DataFrame:
    """``name, status`` (ok, missing_on_disk, not_in_manifest)."""
    m, d = manifest.select(key).distinct().withColumn("_m", F.lit(True)), disk.select(key).distinct().withColumn("_d", F.lit(True))
    status = F.when(F.col("_d").isNull(), "missing_on_disk").when(F.col("_m").isNull(), "not_in_manifest").otherwise("ok")
    return m.join(d, key, "full_outer").select(key, status.alias("status"))


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each key. Spark keeps only first rows while it sorts (window group limit), so a hot key is cut down
    before it is shuffled."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def upsert(state: DataFrame, changes: DataFrame, by: list[str], stamp: str) -> DataFrame:
    """Keyed table after changes: the newest row of each key stays."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, by, [F.desc(stamp), F.desc("_new")]).drop("_new")


def first_only(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Insert-or-ignore: the first row of each key stays."""
    return latest(df, by, order)


def incremental(listing: DataFrame, cache: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``path, action`` (read, keep, evict) of a new listing against what was read before; both have path and mtime (seconds)."""
    new, old = listing.select("path", F.col("mtime").alias("now")), cache.select("path", F.col("mtime").alias("then"))
    action = F.when(F.col("now").isNull(), "evict").when(F.col("then").isNull() | (F.abs(F.col("now") - F.col("then")) > tolerance), "read").otherwise("keep")
    return new.join(old, "path", "full_outer").select("path", action.alias("action"))


def resume(proposals: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return proposals.join(done.select(key).distinct(), key, "left_anti")


def roll_up(log: DataFrame) -> DataFrame:
    """First and last time, totals by destination and up to three examples of each session.

    The examples are cut to three for a session before they are shuffled (window group limit), so a hot session is not
    ranked in one task."""
    totals = log.groupBy("session_id").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("actions"),
        *[F.count(F.when(F.col("destination") == d, 1)).alias(d) for d in ("clean", "review", "duplicate")],
    )
    ranked = log.select("session_id", "original_path").withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy("original_path"))).filter("_r <= 3")
    examples = ranked.groupBy(F.col("session_id").alias("_s")).agg(F.concat_ws("|", F.array_sort(F.collect_list("original_path"))).alias("examples"))
    return totals.join(examples, F.col("session_id").eqNullSafe(F.col("_s"))).drop("_s")


def nth_latest(log: DataFrame, n: int) -> DataFrame:
    """The session that was n-th last active (1: the latest)."""
    last = log.groupBy("session_id").agg(F.max("timestamp").alias("last_ts"))
    return last.orderBy(F.desc("last_ts"), F.desc("session_id")).offset(n - 1).limit(1)


def free_names(plan: DataFrame, taken: DataFrame, target: str = "target", order: str = "source", form: str = "%s (%d)") -> DataFrame:
    """Targets made unique: the first holder keeps a free name, the others (all, if it is taken) get a number, in ``form``.

    In a form of three parts, as ``"%s (UNDO%d)%s"``, the number stands before the extension. A target that very many rows
    share is numbered over many tasks (`number_within`)."""
    known = taken.select(target).distinct().withColumn("_taken", F.lit(1))
    numbered = spread(number_within(plan, [target], [order], "_n"), [target], known).withColumn("_k", (F.col("_n") - 1 + F.coalesce("_taken", F.lit(0))).cast("int"))
    extension = F.regexp_extract(target, r"[^/](\.[^./]+)$", 1)
    parts = [F.col(target), F.col("_k")] if form.count("%") == 2 else [F.expr(f"substring({target}, 1, length({target}) - length(_extension))"), F.col("_k"), F.col("_extension")]
    return numbered.withColumn("_extension", extension).withColumn("final", F.when(F.col("_k") == 0, F.col(target)).otherwise(F.format_string(form, *parts))).drop("_n", "_taken", "_k", "_extension", PART)
