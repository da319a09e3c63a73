"""What a folder's tags say about it: gaps, repeats, coverage, and the seven factors of a confidence score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alignment, garbage_reasons, int_prefix, similarity, track_number
from .order import gap_ranges, medians
from .votes import multi_field, plurality

#: Weights of the seven factors, and of fields in tag completeness.
WEIGHTS = {"dominance": 0.40, "tag_coverage": 0.15, "title_quality": 0.12, "filename_consistency": 0.07, "completeness": 0.12, "aa_consistency": 0.06, "folder_alignment": 0.08}
HEURISTIC = 0.60
FIELD_WEIGHTS = {"artist": 0.20, "title": 0.20, "album": 0.15, "albumartist": 0.10, "year": 0.10, "genre": 0.08, "bpm": 0.07, "key": 0.05, "label": 0.03, "isrc": 0.02}


def numbers(df: DataFrame, by: list[str], number: Column) -> DataFrame:
    """Track numbers of a folder: ``gaps`` (every run of missing numbers as "first-last"), ``gap_count`` (how many numbers
    are missing), ``repeats``, ``completeness`` and ``consecutive``.

    Runs are found among distinct numbers (`gap_ranges`); a number out of all reason makes a long run, not a long list."""
    counted = df.select(*by, number.alias("_k")).groupBy(*by, "_k").agg(F.count("*").alias("_n"))
    known = F.col("_k").isNotNull()
    found = counted.groupBy(*by).agg(F.count("_k").alias("_numbers"), F.sort_array(F.collect_list(F.when(known & (F.col("_n") > 1), F.col("_k")))).alias("repeats"))
    runs = gap_ranges(counted, by, F.col("_k")).groupBy(*by).agg(F.sum("missing").alias("gap_count"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    told = F.transform("_runs", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string")))
    out = _joined(found, runs, by).withColumns({"gaps": F.coalesce(told, F.array().cast("array<string>")), "gap_count": F.coalesce("gap_count", F.lit(0).cast("long"))}).drop("_runs")
    score = 1 - F.least(F.lit(0.30), F.col("gap_count") * 0.06) - F.least(F.lit(0.20), F.size("repeats") * 0.07)
    return out.withColumn("completeness", F.greatest(F.lit(0.0), score)).withColumn("consecutive", (F.col("_numbers") > 0) & (F.col("gap_count") == 0) & (F.size("repeats") == 0)).drop("_numbers")


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in right.columns if c not in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, same, "left").drop(*[f"_r_{c}" for c in by])


def _coverage() -> Column:
    return F.avg(F.coalesce("album", "albumartist", "artist", "title").isNotNull().cast("int")).alias("tag_coverage")


def shape(df: DataFrame, by: list[str], stem: Column | None = None) -> DataFrame:
    """Counts, median tempo, formats, years and discs of each folder.

    With ``stem``, the file's name, files without a disc number take it from a three-digit prefix: 213 is track 13 of disc 2.
    """
    disc = F.col("discnumber")
    if stem is not None:
        tagged, prefix = int_prefix(F.coalesce(disc, F.lit(""))), F.regexp_extract(F.trim(stem), r"^(\d{3})", 1).try_cast("int")
        disc = F.when(tagged != 0, tagged).when((prefix >= 100) & (prefix % 100 >= 1), F.floor(prefix / 100).cast("int"))
    formats = df.groupBy(*by, "ext").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "_n")))).alias("formats"))
    year = F.col("year").try_cast("int")
    facts = df.groupBy(*by).agg(
        F.count("*").alias("files"),
        _coverage(),
        F.bool_and(F.col("ext") == ".flac").alias("lossless"),
        (F.max(year) - F.min(year)).alias("year_spread"),
        (F.count_distinct(disc) > 1).alias("multi_disc"),
        (F.count_distinct(F.lower(F.trim("artist"))) / F.count("artist")).alias("unique_artists"),
        F.sum("size").alias("bytes"),
    )
    return _joined(facts.join(formats, by), medians(df, by, F.col("bpm").try_cast("double"), "median_bpm"), by)


def meaningful(c: Column) -> Column:
    """Whether a title looks like one: two characters or more, and no sign of garbage."""
    t = F.coalesce(c, F.lit(""))
    return (F.length(F.trim(t)) >= 2) & (F.size(garbage_reasons(t)) == 0)


def _title_facts() -> list[Column]:
    t = F.col("title")
    return [F.count(F.when(t != "", 1)).alias("_n"), F.sum(F.when((t != "") & meaningful(t), 1).otherwise(0)).alias("_ok"), F.count_distinct(F.when(F.trim(t) != "", F.lower(F.trim(t)))).alias("_distinct")]


def _title_quality() -> Column:
    ratio = F.col("_ok") / F.col("_n")
    capped = F.when((F.col("_distinct") == 1) & (F.col("_n") > 2), F.least(ratio, F.lit(0.30))).otherwise(ratio)
    return F.when(F.col("_n") == 0, 0.5).otherwise(capped).alias("title_quality")


def titles(df: DataFrame, by: list[str]) -> DataFrame:
    """``title_quality``: share of meaningful titles, .30 at most when more than two are all the same; .5 without titles."""
    return df.groupBy(*by).agg(*_title_facts()).select(*by, _title_quality())


def _likeness(stem_title: Column) -> Column:
    both = (F.coalesce(stem_title, F.lit("")) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "")
    neither = (F.coalesce(stem_title, F.lit("")) == "") & (F.trim(F.coalesce("title", F.lit(""))) == "")
    return F.when(both, similarity(stem_title, F.trim("title"))).when(neither, 0.5)


def _consistency() -> Column:
    return F.coalesce(F.avg("_s"), F.lit(0.5)).alias("filename_consistency")


def filename_consistency(df: DataFrame, by: list[str], stem_title: Column) -> DataFrame:
    """Mean likeness of file names' titles to title tags; .5 where there is nothing to compare."""
    return df.withColumn("_s", _likeness(stem_title)).groupBy(*by).agg(_consistency())


def completeness(df: DataFrame, by: list[str]) -> DataFrame:
    """Weighted share of filled fields by file: average and least of each folder."""
    have = [F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) != "", F.lit(w)).otherwise(0.0) for f, w in FIELD_WEIGHTS.items() if f in df.columns]
    total = have[0]
    for h in have[1:]:
        total = total + h
    return df.withColumn("_c", F.round(total, 3)).groupBy(*by).agg(F.avg("_c").alias("avg_completeness"), F.min("_c").alias("min_completeness"))


def presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, present, empty, rate`` over all files; fields that no file has are there with 0."""
    total = F.count("*")
    one = df.agg(*[F.count(F.when(F.coalesce(F.trim(F.col(f)), F.lit("")) != "", 1)).alias(f) for f in fields], total.alias("_total"))
    long = one.unpivot("_total", fields, "field", "present")
    return long.select("field", "present", (F.col("_total") - F.col("present")).alias("empty"), F.when(F.col("_total") > 0, F.col("present") / F.col("_total")).alias("rate"))


def confidence(df: DataFrame, by: list[str], folder_name: Column, proposed: Column, order: str = "file_id", stem_title: Column | None = None, heuristic: Column | None = None) -> DataFrame:
    """The seven factors of every folder, and ``confidence``, their weighted sum.

    The votes on album, artist and album artist come from one pass; ``proposed`` may use ``album`` and ``albumartist``,
    their winners, and so may ``heuristic``: whether the proposal is a guess, which leaves ``HEURISTIC`` of the sum.
    """
    fields = ["album", "albumartist", "artist"]
    won = multi_field(df.select(*by, order, *[F.lower(F.trim(F.col(f))).alias(f) for f in fields]), by, fields, order)
    votes = won.groupBy(*by).pivot("field", fields).agg(F.first("winner").alias("winner"), F.first("share").alias("share"))
    share = {f: F.coalesce(F.col(f"{f}_share"), F.lit(0.0)) for f in fields}
    # Three shuffles of the files: one for all facts of a folder, one for its votes, one for its numbers.
    liked = df.withColumn("_s", _likeness(stem_title if stem_title is not None else F.col("title")))
    facts = liked.groupBy(*by).agg(F.count("*").alias("files"), _coverage(), *_title_facts(), _consistency()).select(*by, "files", "tag_coverage", _title_quality(), "filename_consistency")
    parts = facts.join(votes, by, "left").join(numbers(df, by, track_number(F.col("tracknumber"))), by, "left")
    dominance = F.when(share["albumartist"] > 0, share["album"] * 0.60 + share["albumartist"] * 0.40).otherwise(share["album"] * 0.70 + share["artist"] * 0.30)
    scored = (
        parts.withColumn("dominance", dominance)
        .withColumn("aa_consistency", F.when(share["albumartist"] > 0, share["albumartist"]).otherwise(0.5))
        .withColumn("album", F.coalesce("album_winner", F.lit("")))
        .withColumn("albumartist", F.coalesce("albumartist_winner", "artist_winner", F.lit("")))
    )
    scored = scored.withColumn("proposed_name", proposed).withColumn("folder_name", folder_name)
    scored = scored.withColumn("folder_alignment", alignment(F.col("folder_name"), F.col("proposed_name")))
    total = F.lit(0.0)
    for factor, w in WEIGHTS.items():
        total = total + F.col(factor) * w
    if heuristic is not None:
        total = F.when(heuristic, total * HEURISTIC).otherwise(total)
    return scored.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).select(
        *by, "files", "folder_name", "proposed_name", *WEIGHTS, F.col("gap_count").alias("track_gaps"), F.size("repeats").alias("track_dupes"), "confidence"
    )


def year_pick(df: DataFrame, by: list[str], order: str = "file_id", presence_min: float = 0.50, agreement_min: float = 0.70, low: int = 1900, high: int = 2100) -> DataFrame:
    """``year`` of each folder, or the reason why none is taken."""
    facts = df.groupBy(*by).agg((F.count(F.when(F.coalesce("year", F.lit("")) != "", 1)) / F.count("*")).alias("presence"))
    joined = facts.join(plurality(df, by, "year", order), by, "left")
    value = F.col("winner").try_cast("int")
    reason = (
        F.when(F.col("presence") < presence_min, "presence_ratio_low").when(F.col("winner").isNull(), "no_year_votes").when(F.col("share") < agreement_min, "agreement_low")
        .when(value.isNull(), "year_not_int").when(~value.between(low, high), "year_out_of_range")
    )
    return joined.select(*by, F.when(reason.isNull(), value).alias("picked"), reason.alias("reason"), "presence", F.col("share").alias("agreement"))
