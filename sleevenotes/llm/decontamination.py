"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII. A window is ``size``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document's words inside any
occurrence of a window are hit. `find` reports them; `remove` takes the hit spans, or the whole documents, away.

*Scan.* Words are hashed once and every run of them (of the lengths that windows have, ``size`` at most) by the hashes of
its words. The hashes are looked up in a broadcast hash set of the distinct windows; a hit is verified word by word, in the
same stage. So no window of a document is ever shuffled: what is shuffled is one narrow row for each document, and the hits.

*Bound of the broadcast.* The distinct windows are counted. Up to ``at_once`` of them (some 250 bytes each) are broadcast;
beyond, they are dealt into as many parts by their hash, and the documents are scanned once for each part. The results
are the same. Which items have a window is a table of its own, joined only after the documents' hits are put together:
documents with the same sets of windows share one look-up.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: a null text has no words, and so neither hits nor windows; rows of documents that are equal in id and text
are judged once and returned as often as they occur; rows that share an id but not the text are judged apart, and a null
id is an id like another; items that share an id are one item; an item without an id counts as one and its id reads as
empty; without items nothing is hit; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

SIZE = 10
#: Windows that are broadcast together.
AT_ONCE = 250_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that is not lower-cased.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["doc_id", "_h1", "_h2"]


def words(text: Column | str) -> Column:
    """Words of a text with A-Z lower-cased; of null, none."""
    lowered = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """``hash, length, words, items``: every distinct window of the items (item_id, text), and the ids of the items with it.

    Windows are told apart by their words, so that two that share a hash stay two."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("ws")).filter(F.size("ws") > 0)
    runs = F.when(F.size("ws") <= size, F.array("ws")).otherwise(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size)))
    each = worded.select("item", F.explode(runs).alias("words")).distinct()
    held = each.groupBy("words").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return held.select(_hash(_word_hashes("words")).alias("hash"), F.size("words").alias("length"), "words", "items")


def _word_hashes(ws: str) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _hash(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text, which tell rows that share an id apart."""
    return docs.select("doc_id", "text").withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})


def _hits(docs: DataFrame, part: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns of `KEY`, at (the first word's place, from 0), upto, group: the verified hits of a part of the windows."""
    worded = docs.withColumn("_words", words("text")).withColumn("_hashes", _word_hashes("_words"))
    runs = lambda n: F.when(
        F.size("_hashes") >= n,
        F.transform(F.sequence(F.lit(1), F.size("_hashes") - (n - 1)), lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("n"), _hash(F.slice("_hashes", i, n)).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<at:int,n:int,hash:bigint>>"))
    # The runs are a column before they are exploded: then the rows of a document's runs, its words beside each, exist
    # inside generated code alone. Outer: else the arrays are made a second time, below a filter on their size.
    each = worded.withColumn("_runs", F.concat(*[runs(n) for n in lengths])).select(*KEY, "_words", F.explode_outer("_runs").alias("w"))
    p = part.select(F.col("hash").alias("_hash"), F.col("length").alias("_length"), F.col("words").alias("_window"), "group")
    met = each.join(F.broadcast(p), (F.col("w.hash") == F.col("_hash")) & (F.col("w.n") == F.col("_length")))
    # Neither before nor after: an equation would become a key of the join, which is worked out for every run.
    own = F.slice("_words", F.col("w.at") + 1, F.col("w.n"))
    return met.filter((own <= F.col("_window")) & (own >= F.col("_window"))).select(*KEY, F.col("w.at").alias("at"), (F.col("w.at") + F.col("w.n")).alias("upto"), "group")


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: for every row of ``docs`` (doc_id, text), with
    the two hashes of its text (`KEY`).

    ``spans`` are the maximal runs of hit words, as pairs of the first word's place (from 0) and the place after the last."""
    known = windows(items, size)
    # Windows with the same items are one group: of the windows that a document has, only the groups matter.
    known = settle(known.withColumn("group", F.xxhash64(F.lit("items"), "items")))
    facts = known.agg(F.count("*"), F.sort_array(F.collect_set("length"))).first()  # lengths: `size` numbers at most
    parts = -(-facts[0] // at_once)
    told = keyed(docs)
    none = F.lit(None)
    rows = told.select(*KEY, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_WORD)).cast("long").alias("n_words"), none.cast("int").alias("at"), none.cast("int").alias("upto"), none.cast("long").alias("group"))
    for k in range(parts):
        part = known.filter(F.pmod("hash", F.lit(parts)) == k)
        hits = _hits(told, part, facts[1])
        rows = rows.unionByName(hits.select(*KEY, none.cast("long").alias("n_words"), "at", "upto", "group"))
    # Equal rows have equal hits, which count once. A hit begins a span if no earlier one reaches its first word.
    once = rows.groupBy(*KEY, "at", "upto", "group").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("_rows"))
    earlier = Window.partitionBy(*KEY).orderBy("at", "upto").rowsBetween(Window.unboundedPreceding, -1)
    begun = once.withColumn("_reached", F.max("upto").over(earlier)).withColumn("_new", F.col("_reached").isNull() | (F.col("at") > F.col("_reached")))
    ends = F.concat(F.collect_list(F.when(F.col("_new"), F.col("_reached"))), F.array(F.max("upto")))
    spanned = settle(
        begun.groupBy(*KEY)
        .agg(
            F.max("n_words").alias("n_words"), F.sum("_rows").alias("_rows"), F.sort_array(F.collect_set("group")).alias("_groups"),
            F.arrays_zip(F.sort_array(F.collect_list(F.when(F.col("_new"), F.col("at")))).alias("at"), F.sort_array(ends).alias("upto")).alias("_spans"),
        )
        .withColumn("spans", F.filter("_spans", lambda x: x["at"].isNotNull()))
        .drop("_spans")
    )
    # Documents with the same groups look their items up together.
    sets = spanned.filter(F.size("_groups") > 0).select("_groups").distinct()
    held = known.select("group", "items").dropDuplicates(["group"])
    looked = sets.select("_groups", F.explode("_groups").alias("group")).join(held, "group").select("_groups", F.explode("items").alias("item")).groupBy("_groups").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    digested = looked.select("_groups", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"))
    clean = spanned.filter(F.size("_groups") == 0).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    full = spanned.join(digested, "_groups").unionByName(clean)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["upto"] - s["at"])
    return full.select(*KEY, "n_words", n_hit.alias("n_hit"), "n_items", "items_sha256", (F.size("spans") > 0).alias("contaminated"), "spans", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy")).drop("_copy")


def remove(docs: DataFrame, items: DataFrame, size: int = SIZE, whole: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """``docs`` without what the items contaminate: without the hit spans, or, if ``whole``, without the documents that
    have one.

    A span is cut from the first letter of its first word to the last of its last; all that stands between spans stays as
    it is. Texts without a hit are not touched."""
    found = find(docs, items, size, at_once).filter("contaminated").select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("spans").alias("_spans")).distinct()
    told = docs.withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_t1") == F.col("__h1")) & (F.col("_t2") == F.col("__h2"))
    if whole:
        return told.join(found, same, "left_anti").select(*docs.columns)
    met = told.join(found, same, "left")
    ws, gaps = F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0)), F.split("text", ANY_WORD, -1)
    # A stretch that stays: what stands before its first word, its words and the gaps after them.
    text = lambda first, last: F.concat_ws("", F.transform(F.sequence(first, last), lambda k: F.concat(F.when(k > first, F.get("_ws", k - 1)).otherwise(F.lit("")), F.get("_gaps", k))))
    stays = F.zip_with(F.concat(F.array(F.lit(0)), F.col("_spans.upto")), F.concat(F.col("_spans.at"), F.array(F.size("_ws"))), lambda a, b: text(a, b))
    cut = met.filter(F.col("_spans").isNotNull()).withColumns({"_ws": ws, "_gaps": gaps}).withColumn("text", F.concat_ws("", stays))
    return met.filter(F.col("_spans").isNull()).select(*docs.columns).unionByName(cut.select(*docs.columns))
