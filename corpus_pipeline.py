"""A corpus from raw documents to token ids: STAGES in order, each applied to all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleevenotes.llm import encoding, langid, mixing, nearsets, suffixes
from sleevenotes.llm.common import shared_folder
from sleevenotes.llm.queries import held_out


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned: those with a letter whose text is likelier in its best language than letters
    drawn evenly, by the character, so that neither a long text passes nor a short one goes for its length. ``lang`` stays
    as it came."""
    langs, table = langid.learn(docs.filter(~held_out()).select("text", "lang"))
    if not langs:  # nothing to learn from: nothing can be rejected
        return docs
    told = langid.predict(docs, langs, table, names=("_lang", "_score", "_fit"))
    return told.filter((F.col("_lang") != langid.UND) & (F.col("_fit") > langid.NO_LANGUAGE)).select(*docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return nearsets.keep_one(docs, nearsets.link(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that documents of smaller id have."""
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Ids may be null or repeated: rows meet their copies by a hash of all their columns. Rows equal in all of them share
    the sum of their copies evenly.
    """
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumns({f"_key{k}": F.xxhash64(F.lit(k), *columns, *[c.isNull() for c in columns]) for k in (1, 2)})
    sizes = mixing.with_size(keyed.select(F.struct("_key1", "_key2").alias("doc_id"), "source", "text"))
    copies = mixing.mix(sizes).groupBy(F.col("doc_id._key1").alias("_key1"), F.col("doc_id._key2").alias("_key2")).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    row = F.row_number().over(Window.partitionBy("_key1", "_key2").orderBy("_all"))
    own = F.floor(F.col("_all") / F.col("_rows")) + F.when(row <= F.col("_all") % F.col("_rows"), 1).otherwise(0)
    met = keyed.join(copies.filter("_all > 0"), ["_key1", "_key2"]).withColumn("_own", own.cast("int")).filter("_own > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    ids = encoding.encode(docs)
    return ids.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("near_dedup", near_deduplicated),
    ("suffix_dedup", without_repeats),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Language models, similarity trees and entropy balancing are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read again; then what the one before it wrote goes."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
