"""Structured Streaming forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import routing, runs


def stream_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_at_once: int = 1) -> DataFrame:
    """Files that arrive in a folder, a few at a time; the checkpoint of the query remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(kind).load(path)


def running_tallies(log: DataFrame) -> DataFrame:
    """Totals by session and destination, kept up to date as the log grows."""
    return log.groupBy("session_id", "destination").agg(F.count("*").alias("actions"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


#: What is kept of a name: its first holder, and whether one of its holders was accepted.
NAME_STATE = "first string, accepted boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_names_seen(proposals: DataFrame) -> DataFrame:
    """Adds ``occurrence``, ``other`` and ``_known`` (as `routing.decide` takes them) to a stream of proposals, from state
    kept for each name and not from what was written before.

    "First" means first by (batch, path), where the batch job orders by path alone. A name that an earlier batch accepted is
    known; one that it has seen and not accepted is a duplicate of its first holder. The state has a short row for each
    name; a task holds the rows that one batch has of a name."""
    columns = [c for c in proposals.columns if c != "fits"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in proposals.schema.fields if f.name != "fits") + ", occurrence int, other string, _known boolean"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, accepted = state.get if state.exists else (None, False)
        rows = pd.concat(list(chunks)).sort_values("folder_path", kind="stable")
        place = np.arange(1, len(rows) + 1) + (first is not None and not accepted)
        head = rows["folder_path"].iloc[0] if first is None else first
        out = rows[columns].assign(occurrence=place.astype("int32"), other=head, _known=bool(accepted))
        fits = not accepted and first is None and bool(rows["fits"].iloc[0])
        state.update((head, bool(accepted or fits)))
        yield out

    return proposals.groupBy("proposed_name").applyInPandasWithState(step, schema, NAME_STATE, "append", GroupStateTimeout.NoTimeout)


def route_arriving(proposals: DataFrame, manifest: str, history: str, checkpoint: str) -> StreamingQuery:
    """Route proposals batch by batch against the names seen and accepted so far, append the outcome, and add newly accepted
    names.

    Names are state of the query (in RocksDB, with its checkpoint), so a batch costs what it holds, however long the
    history is, and a query that is started again goes on where it stopped. A batch is told apart by its number, in whose
    folder its rows are written, so a batch that is run again after a failure writes the same folders again."""
    alone = {"occurrence": F.lit(1), "other": F.lit(None).cast("string"), "_known": F.lit(False)}
    fits = routing.decide(proposals.withColumns(alone | {"_confidence": F.col("confidence")})).withColumn("confidence", F.col("_confidence"))
    named = with_names_seen(fits.select(*proposals.columns, "fits"))

    def step(batch: DataFrame, number: int) -> None:
        routed = routing.decide(batch).drop("fits")
        routed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{history}/batch={number}")
        done = batch.sparkSession.read.parquet(f"{history}/batch={number}")
        accepted = done.filter("destination = 'clean'").select(F.col("proposed_name").alias("name"))
        runs.first_only(accepted, ["name"], ["name"]).write.mode("overwrite").parquet(f"{manifest}/batch={number}")

    spark = proposals.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return named.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
