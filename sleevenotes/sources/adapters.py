"""Catalog views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import size

#: Bytes of a table below which its rows are not worth dealing, and bytes for each task that may run at once from which its
#: row groups keep all of them busy (a million rows of `lineitem` have about as many).
WORTH, BUSY = 1 << 20, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """`read` for much work on every row: a row group is one task's, however many tasks may run, so the rows of a table with
    few of them are dealt to all tasks."""
    rows, tasks, there = read(spark, sf_dir, table), spark.sparkContext.defaultParallelism, size(spark, f"{sf_dir}/{table}.parquet")
    return rows.repartition(2 * tasks) if WORTH < there < BUSY * tasks else rows


def text(c) -> F.Column:  # noqa: ANN001
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file, grouped into folders; string tags that may be null.

    Files meet their orders by the folder's path, last: where both sides are shuffled for it, a folder's files are together
    already for what groups by folder next, and are not dealt again."""
    path = lambda key: F.concat(F.lit("o"), text(key))
    files = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("folder_path", path("l_orderkey"))
    rows = files.join(read(spark, sf_dir, "orders").select(path("o_orderkey").alias("folder_path"), "o_custkey"), "folder_path")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return rows.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), text(F.to_date("l_shipdate")), text(cents)).alias("file_id"),
        "folder_path",
        F.concat(F.lit("c"), text("o_custkey")).alias("parent_path"),
        F.col("p_brand").alias("album"),
        F.concat(F.lit("Supplier "), text(F.col("l_suppkey") % 7)).alias("artist"),
        F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Supplier "), text(F.col("l_suppkey") % 3))).alias("albumartist"),
        F.concat("p_name", F.lit(" "), text("l_partkey")).alias("title"),
        F.concat(text("l_linenumber"), F.lit("/7")).alias("tracknumber"),
        text(F.col("l_suppkey") % 2 + 1).alias("discnumber"),
        text(F.year("l_shipdate")).alias("year"),
        text(60 + 2 * F.col("p_size")).alias("bpm"),
        F.col("p_type").alias("genre"),
        F.concat(F.lit("P"), text("l_partkey")).alias("isrc"),
        F.when(F.col("l_linestatus") == "O", F.lit("1")).alias("compilation"),
        F.when(F.col("l_partkey") % 3 == 0, ".mp3").when(F.col("l_partkey") % 3 == 1, ".flac").otherwise(".m4a").alias("ext"),
        (F.col("l_quantity") * 1000).cast("long").alias("size"),
        (F.col("l_extendedprice") / 100.0).alias("duration_sec"),
        F.to_date("l_shipdate").alias("mtime"),
    )


TRACKS_SQL = """v_tracks AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS file_id,
    concat('o', CAST(l_orderkey AS VARCHAR)) AS folder_path, concat('c', CAST(o_custkey AS VARCHAR)) AS parent_path, p_brand AS album, concat('Supplier ', CAST(l_suppkey % 7 AS VARCHAR)) AS artist,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE concat('Supplier ', CAST(l_suppkey % 3 AS VARCHAR)) END AS albumartist, concat(p_name, ' ', CAST(l_partkey AS VARCHAR)) AS title,
    concat(CAST(l_linenumber AS VARCHAR), '/7') AS tracknumber, CAST(l_suppkey % 2 + 1 AS VARCHAR) AS discnumber, CAST(year(l_shipdate) AS VARCHAR) AS year, CAST(60 + 2 * p_size AS VARCHAR) AS bpm, p_type AS genre,
    concat('P', CAST(l_partkey AS VARCHAR)) AS isrc, CASE WHEN l_linestatus = 'O' THEN '1' END AS compilation, CASE l_partkey % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' ELSE '.m4a' END AS ext,
    CAST(l_quantity * 1000 AS BIGINT) AS size, l_extendedprice / 100.0 AS duration_sec, CAST(l_shipdate AS DATE) AS mtime
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per logged action."""
    e = read(spark, sf_dir, "events")
    user, kind = text("user_id"), F.col("event_type")
    return e.select(
        text("event_id").alias("action_id"),
        F.col("event_id").alias("ord"),
        F.col("ts").alias("timestamp"),
        F.concat(user, F.lit("-"), text(F.to_date("ts"))).alias("session_id"),
        F.when(kind.isin("purchase", "signup"), "clean").when(kind.isin("view", "click"), "review").otherwise("duplicate").alias("destination"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        F.concat(F.lit("in/"), user, F.lit("/"), text("event_id")).alias("original_path"),
        F.concat(F.lit("out/"), kind, F.lit("/"), text(F.col("event_id") % 50)).alias("target_path"),
    )


HISTORY_SQL = """v_history AS (
  SELECT CAST(event_id AS VARCHAR) AS action_id, event_id AS ord, ts AS timestamp, concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'clean' WHEN event_type IN ('view', 'click') THEN 'review' ELSE 'duplicate' END AS destination, least(value / 100.0, 1.0) AS confidence,
    concat('in/', CAST(user_id AS VARCHAR), '/', CAST(event_id AS VARCHAR)) AS original_path, concat('out/', event_type, '/', CAST(event_id % 50 AS VARCHAR)) AS target_path FROM events)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per verdict on a proposed fix."""
    r = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    lang = F.col("lang")
    fix = F.when(lang == "en", "noise_removal").when(lang == "fr", "bpm_extraction").when(lang == "de", "artist_normalize").otherwise("whitespace")
    verdict = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "accept").otherwise("reject")
    return r.select(text("doc_id").alias("proposal_id"), fix.alias("fix_type"), F.col("source").alias("source_label"), verdict.alias("verdict"))


REVIEWS_SQL = """v_reviews AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS proposal_id, CASE lang WHEN 'en' THEN 'noise_removal' WHEN 'fr' THEN 'bpm_extraction' WHEN 'de' THEN 'artist_normalize' ELSE 'whitespace' END AS fix_type,
    source AS source_label, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def sessions(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """Proposals of one of two runs: orders before, or from, the middle of 1998."""
    o = read(spark, sf_dir, "orders")
    cut = F.lit("1998-07-01").cast("date")
    some = o.filter((F.to_date("o_orderdate") >= cut) if late else (F.to_date("o_orderdate") < cut))
    return some.groupBy(F.concat(F.lit("c"), text("o_custkey")).alias("proposed_name")).agg(
        F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("destination"), (F.avg("o_totalprice") / 500000.0).alias("confidence")
    )


def session_sql(name: str, late: bool) -> str:
    return f"""{name} AS (SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS proposed_name, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS destination, avg(o_totalprice) / 500000.0 AS confidence
  FROM orders WHERE CAST(o_orderdate AS DATE) {'>=' if late else '<'} DATE '1998-07-01' GROUP BY o_custkey)"""
