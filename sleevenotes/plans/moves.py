"""Move, undo and apply plans: rows that say what would be done, and why a row is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import free_names
from ..tables import settled


def move_plan(routed: DataFrame, taken: DataFrame, root: str) -> DataFrame:
    """``source, destination, final, skipped``: accepted folders go to a free name below the root, the rest are skipped with a reason."""
    target = F.concat(F.lit(root + "/"), F.col("proposed_name"))
    eligible = free_names(routed.filter("destination = 'clean'").select(F.col("folder_path").alias("source"), target.alias("target")), taken)
    moved = eligible.select("source", F.lit("clean").alias("destination"), "final", F.lit(None).cast("string").alias("skipped"))
    left = routed.filter("destination != 'clean'").select(F.col("folder_path").alias("source"), "destination", F.lit(None).cast("string").alias("final"), F.concat(F.lit("destination_"), F.col("destination")).alias("skipped"))
    return moved.unionByName(left)


def chosen(log: DataFrame, action_id: str | None = None, session_id: str | None = None, path: str | None = None, folder: str | None = None) -> DataFrame:
    """The logged actions of one id, else of one session, else with ``path`` in the original path, else of a folder: its
    name or a part of the original path."""
    if action_id is not None:
        return log.filter(F.col("action_id") == action_id)
    if session_id is not None:
        return log.filter(F.col("session_id") == session_id)
    part = path if path is not None else folder
    if part is None:
        raise ValueError("what to undo: an action_id, a session_id, a path or a folder")
    return log.filter(F.col("original_path").contains(part))


def undo_plan(log: DataFrame, taken: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """Logged moves back from target to original; originals that are taken again get " (UNDOn)" before their extension.

    there: ``source`` of what is still where it was moved to; what is not is ``skipped`` as missing."""
    back = log.select("action_id", "timestamp", "ord", F.col("target_path").alias("source"), F.col("original_path").alias("target"))
    lost = F.lit(None).cast("string")
    if there is not None:
        back = back.join(there.select("source").distinct().withColumn("_there", F.lit(True)), "source", "left")
        missing = back.filter("_there IS NULL").select("action_id", "source", lost.alias("final"), "timestamp", F.lit("missing").alias("skipped"))
        back = back.filter("_there").drop("_there")
    done = free_names(back, taken, order="ord", form="%s (UNDO%d)%s").select("action_id", "source", "final", "timestamp", lost.alias("skipped"))
    return done if there is None else done.unionByName(missing)


def undo_tags(snapshots: DataFrame, session_id: str | None = None, path: str | None = None) -> DataFrame:
    """Written and not yet undone changes of a session, or of files with ``path`` in their path, newest first by
    ``ord``: the value each field gets back. A field changed more than once gets the oldest value."""
    some = snapshots.filter("written AND NOT undone")
    some = some.filter(F.col("apply_session_id") == session_id) if session_id is not None else some
    some = some.filter(F.col("file_path").contains(path)) if path is not None else some
    return some.groupBy("file_path", "field_name").agg(F.min_by("original_value", "ord").alias("restored"), F.max_by("new_value", "ord").alias("found"), F.count("*").alias("changes"))


def apply_plan(proposals: DataFrame, protected: list[str], cap: int | None = None) -> DataFrame:
    """Accepted fixes of unprotected fields as snapshots of old and new values, the first ``cap`` by file and kind (the batch)."""
    some = proposals.filter((F.col("status") == "accepted") & ~F.col("field_name").isin(*protected)).orderBy("file_id", "fix_type", "field_name")
    return (some.limit(cap) if cap else some).select("proposal_id", "file_id", "field_name", F.col("old_value").alias("original_value"), "new_value", F.lit(False).alias("written"), F.lit(False).alias("undone"))


def first_batch(files: DataFrame, plan: Callable[[DataFrame], DataFrame], cap: int, tries: tuple[int, ...] = (4, 64)) -> DataFrame:
    """``plan(files)``, which gives the first ``cap`` rows by ``file_id`` and makes each row of one file alone.

    Rows of later files come after those of earlier ones, so if the files up to some id fill the batch, it is the batch of all
    files. All ids are read; only if a few times ``cap`` files do not fill it is every file worked on."""
    for n in tries:
        edge = files.select("file_id").orderBy("file_id").limit(n * cap).agg(F.max("file_id").alias("last"), F.count("*").alias("n")).first()
        if edge["n"] < n * cap:
            break
        found = settled(plan(files.filter(F.col("file_id").isNull() | (F.col("file_id") <= edge["last"]))))
        if found.count() >= cap:
            return found
    return plan(files)
