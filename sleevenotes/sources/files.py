"""Readers and writers of catalog tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "action_id string, timestamp timestamp, session_id string, type string, original_path string, original_folder_name string, target_path string, target_folder_name string, destination string, confidence double, move_method string"


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Path, size and time of the files below a folder, without hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("ext", F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).filter(F.col("ext").isin(*suffixes) & ~name.startswith("."))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Logged actions, one JSON object a line; lines that cannot be read are dropped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def append_history(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def session_report(proposals: DataFrame) -> DataFrame:
    """Flat rows for a CSV report: lists joined by ``|``, flags as yes or no."""
    return proposals.select(
        "folder_path", "proposed_name", "destination", F.round("confidence", 3).alias("confidence"), F.concat_ws("|", "reasons").alias("reasons"), F.when(F.col("destination") == "clean", "yes").otherwise("no").alias("accepted")
    )


def tree_dump(paths: DataFrame, path: str = "path") -> DataFrame:
    """``kind, depth, ext, path`` of every file and of every folder above one."""
    parts = F.split(path, "/")
    files = paths.select(F.lit("FILE").alias("kind"), (F.size(parts) - 1).alias("depth"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("ext"), F.col(path).alias("path")).distinct()
    above = paths.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    return files.unionByName(above.select(F.lit("DIR").alias("kind"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.lit("").alias("ext"), "path"))
