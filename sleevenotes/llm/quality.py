"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Two multinomials over ``buckets`` hashed word n-grams (single words and pairs) are counted: one over all documents (the
raw corpus), one over trusted documents (labelled of good quality). A document's score is the mean, over its n-grams,
of ``ln p_target(bucket) - ln p_raw(bucket)``: what it gains, by n-gram, when read as trusted text. Every document whose
score is below a fixed threshold goes. Weights are whole millionths, so sums and the verdict are exact.

The trusted documents are a bounded sample: the ``max_trusted`` labelled rows whose id has the lowest CRC-32, so their
ids can be broadcast. The raw counts cover every document. The table of weights has ``buckets`` entries whatever the
corpus size; it reaches the tasks as a scalar subquery. Everything is built-in functions over arrays inside one row:
texts are never shuffled, only bucket counts are.

Defined cases: a null text has no words and fails the base rules; a text of one word has one n-gram; without trusted or
raw documents all weights are 0; repeated rows are judged alike; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_text`` (null: empty) and ``_words``."""
    return docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))


def base_counts(worded: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (all long)."""
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twice = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", k + 1)["h"].eqNullSafe(x["h"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return (
        worded.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(_without(F.col("_text"), SPACE)).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_sorted", F.sort_array(windows))
        .withColumn("n_repeat_words", F.size(covered).cast("long"))
        .drop("_lines", "_sorted")
    )


def ngrams(worded: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_ngrams``: the bucket of every word, and of every pair of neighbouring words."""
    pairs = F.when(
        F.size("_hashes") >= 2,
        F.transform(F.sequence(F.lit(0), F.size("_hashes") - 2), lambda i: ((F.get("_hashes", i) * 31 + F.get("_hashes", i + 1)) % buckets).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    singles = F.transform("_hashes", lambda h: (h % buckets).cast("int"))
    return worded.withColumn("_hashes", F.transform("_words", lambda w: F.crc32(w.cast("binary")))).withColumn("_ngrams", F.concat(singles, pairs)).drop("_hashes")


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    """At most ``max_trusted`` ids of documents labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_trusted)


def weights(docs: DataFrame, labels: DataFrame, buckets: int, max_trusted: int) -> DataFrame:
    """One row: ``weights``, an array of ``buckets`` log ratios in millionths."""
    trusted = trusted_ids(labels, max_trusted).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_trusted"))
    flagged = docs.join(F.broadcast(trusted), docs["doc_id"] == F.col("_id"), "left").select("text", "_trusted")
    counts = (
        ngrams(words(flagged), buckets)
        .select(F.explode_outer("_ngrams").alias("bucket"), "_trusted")  # outer: else the array is computed a second time, below a filter on its size
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    )
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    filled = full.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    sums = filled.groupBy().agg(F.sum("raw").alias("r"), F.sum("target").alias("t"), F.collect_list(F.struct("bucket", "raw", "target")).alias("all"))
    ratio = lambda x: F.ln((x["target"] + 1) / (F.col("t") + buckets)) - F.ln((x["raw"] + 1) / (F.col("r") + buckets))
    return sums.select(F.transform(F.sort_array("all"), lambda x: F.when(F.col("t") > 0, F.round(ratio(x) * 1e6)).otherwise(0).cast("long")).alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.05, buckets: int = 16384, max_trusted: int = 20_000, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``score_micro`` (sum of weights), ``n_ngrams``, ``score``, ``kept``."""
    model = weights(docs, labels, buckets, max_trusted)
    scored = (
        ngrams(base_counts(words(docs.select("doc_id", "text"))), buckets)
        .withColumn("_model", model.scalar())
        .withColumn("n_ngrams", F.size("_ngrams").cast("long"))
        .withColumn("score_micro", F.aggregate("_ngrams", F.lit(0).cast("long"), lambda total, b: total + F.get("_model", b)))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    return (
        scored.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score_micro") >= round(threshold * 1e6) * F.col("n_ngrams")))
        .withColumn("score", F.when(F.col("n_ngrams") > 0, F.col("score_micro") / F.col("n_ngrams") / 1e6))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_ngrams", "score_micro", "score")
    )
