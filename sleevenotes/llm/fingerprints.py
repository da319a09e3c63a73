"""Bottom-k sketches of shingle hashes.

A text's fingerprint holds the k smallest of the 64-bit hashes of its distinct five-word shingles. The fingerprint of a
union is the k smallest of two fingerprints together, so parts of a text (or of a corpus) can be sketched apart and
merged (`merge`). Two fingerprints estimate resemblance (`resemblance`), containment (`containment`) and, alone, the
number of distinct shingles (`distinct`); with fewer than k hashes all three are exact.

`fingerprint_neighbours` compares each document with the one next to it in descending order of id and with an edited
text that joins the two. Neighbours meet without a global sort in one task: quantiles of the ids cut the table into
blocks, each block's first document also goes to the block before it, and every block is walked in order. Texts are
shuffled once; the answer does not depend on where the cuts fall.

Defined cases: a null text is empty; an empty text (no words) has an empty fingerprint, and two of those resemble each
other fully; a text of one to four words is one shingle; ids that repeat are ordered by text, null ids come last; a
single document is its own next document; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, shuffle_partitions, small_batches

K, SHINGLE = 128, 5
FULL = 2.0**64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _FIN
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if there are fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    known = kept(WordHashes, WordHashes)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(h) - size + 1)
    mixed = np.full(n, np.uint64(min(len(h), size)), np.uint64)
    for k in range(min(size, len(h))):
        mixed = _scramble((mixed + h[k : k + n]) * _MIX)
    return mixed


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, in order."""
    if len(hashes) > 4 * k:  # far fewer than all need sorting, unless hashes repeat
        few = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketch(text: str, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes(text.encode("utf-8", "surrogatepass").split()), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all shingles of both."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / FULL)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def _blocks(ids: DataFrame, n: int) -> list[int]:
    """Quantiles of the ids: n - 1 cuts at most, which bound the blocks."""
    row = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 20 * n)))).first() if n > 1 else None
    return sorted(set(row[0] or [])) if row else []


def _placed(df: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds ``block``: one more than the number of cuts below the id, found in two short steps, among every m-th cut and then
    among the m after it; null ids, which come last, have block 0. The cuts are a row of a table, not a part of the
    expression, whose size stays the same however many there are."""
    m = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    table = df.sparkSession.createDataFrame([([g[0] for g in groups], groups)], "heads array<bigint>, groups array<array<bigint>>")
    d = df.withColumns({f"_{c}": table.select(c).scalar() for c in ("heads", "groups")})
    d = d.withColumn("_group", F.size(F.filter("_heads", lambda x: x < F.col("doc_id"))))
    within = F.size(F.filter(F.get("_groups", F.col("_group") - 1), lambda x: x < F.col("doc_id")))
    below = F.when(F.col("_group") == 0, 0).otherwise((F.col("_group") - 1) * m + within)
    return d.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(below + 1).cast("int")).drop("_heads", "_groups", "_group")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, containment_next double, distinct_shingles double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of block and of descending id; the last of each block only closes it."""
    before: tuple | None = None  # block, id, text, sketch
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for block, doc, text, only_next in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text", "only_next")), strict=True):
            own = sketch(text)
            if before is not None and before[0] == block:
                _, last_id, last_text, last = before
                edit = _edited(last_text, text)
                changed = sketch(edit)
                out.append(
                    (last_id, len(last_text), hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), to_text(last), to_text(changed), resemblance(last, changed), resemblance(last, own), containment(last, own), distinct(last))
                )
            before = None if only_next else (block, doc, text, own)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def fingerprint_neighbours(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see `SCHEMA`."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = blocks or 8 * shuffle_partitions(spark)
    cuts = _blocks(narrow.select("doc_id"), n)
    placed = _placed(narrow, cuts)
    # The first document of each block in descending order, which also closes the block above: found by id alone ...
    firsts = placed.groupBy("block").agg(F.max("doc_id").alias("first_id"))
    up = sorted((r["block"], r["first_id"]) for r in firsts.collect())  # at most n + 1 rows, of two numbers each
    if not up:
        return spark.createDataFrame([], SCHEMA)
    closes = {first: up[(i + 1) % len(up)][0] for i, (_, first) in enumerate(up)}
    # ... and among rows of that id, the one whose text comes first. This table has a row for each block.
    closers = spark.createDataFrame(list(closes.items()), "first_id long, target int")
    heads = (
        placed.join(F.broadcast(closers), F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id", "target")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", F.col("target").alias("block"), F.lit(True).alias("only_next"))
    )
    rows = placed.withColumn("only_next", F.lit(False)).unionByName(heads)
    ordered = rows.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "only_next", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_walk, SCHEMA)
