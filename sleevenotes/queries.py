"""Registered queries over the given tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dedupe, learn, order, quality, routing, runs, votes
from .sources import adapters as A
from .sources.adapters import HISTORY_SQL, REVIEWS_SQL, TRACKS_SQL, read, session_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)  # DuckDB reads 0.1 as a decimal
        return f

    return register


FOLDER = ["folder_path"]
VOTED = ["album", "albumartist", "artist", "year", "genre"]


# Votes


@query(f"WITH {TRACKS_SQL} SELECT * FROM {votes.plurality_sql('v_tracks', 'folder_path', 'artist', 'file_id')}")
def a01_plurality_vote(spark: SparkSession, sf: str) -> DataFrame:
    return votes.plurality(A.tracks(spark, sf), FOLDER, "artist", "file_id")


RAW_SQL = f"WITH {TRACKS_SQL}, raw AS (SELECT *, CASE WHEN size % 2000 = 0 THEN upper(genre) ELSE genre || ' [promo]' END AS shown FROM v_tracks), keyed AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(shown)), '[\\(\\[].*?[\\)\\]]', '', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS vote FROM raw)"


@query(
    f"""{RAW_SQL}, won AS (SELECT * FROM {votes.plurality_sql('keyed', 'folder_path', 'vote', 'file_id')}),
    inside AS (SELECT k.folder_path, k.shown, k.file_id FROM keyed k JOIN won w ON k.folder_path = w.folder_path AND k.vote = w.winner)
    SELECT w.*, d.winner AS display FROM won w JOIN {votes.plurality_sql('inside', 'folder_path', 'shown', 'file_id')} d ON w.folder_path = d.folder_path"""
)
def a02_display_form(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.when(F.col("size") % 2000 == 0, F.upper("genre")).otherwise(F.concat("genre", F.lit(" [promo]")))
    keyed = A.tracks(spark, sf).withColumn("shown", shown).withColumn("vote", votes.vote_key(F.col("shown")))
    return votes.display_form(keyed, FOLDER, "shown", "vote", "file_id")


@query(f"WITH {TRACKS_SQL} " + " UNION ALL ".join(f"SELECT folder_path, '{f}' AS field, winner, share, votes FROM {votes.plurality_sql('v_tracks', 'folder_path', f, 'file_id')}" for f in VOTED))
def a03_multi_field_vote(spark: SparkSession, sf: str) -> DataFrame:
    return votes.multi_field(A.tracks(spark, sf), FOLDER, VOTED, "file_id")


# Folder facts


@query(
    f"""WITH {TRACKS_SQL}, f AS (SELECT folder_path, ext, count(*) AS n FROM v_tracks GROUP BY ALL), m AS (SELECT folder_path, string_agg(ext || '=' || n, '|' ORDER BY ext) AS formats FROM f GROUP BY folder_path)
    SELECT folder_path, count(*) AS files, avg(CASE WHEN coalesce(album, albumartist, artist, title) IS NOT NULL THEN 1 ELSE 0 END) AS tag_coverage, median(CAST(bpm AS DOUBLE)) AS median_bpm, bool_and(ext = '.flac') AS lossless,
    max(CAST(year AS INT)) - min(CAST(year AS INT)) AS year_spread, count(DISTINCT discnumber) > 1 AS multi_disc, count(DISTINCT lower(trim(artist))) * 1.0 / count(artist) AS unique_artists, CAST(sum(size) AS BIGINT) AS bytes, any_value(formats) AS formats
    FROM v_tracks JOIN m USING (folder_path) GROUP BY folder_path"""
)
def a04_folder_shape(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return quality.shape(A.tracks(spark, sf), FOLDER).withColumn("formats", listed)


NUMBERS_SQL = """n AS (SELECT folder_path, CAST(regexp_extract(tracknumber, '^\\s*(\\d+)', 1) AS INT) AS k FROM v_tracks), have AS (SELECT folder_path, list_sort(list(DISTINCT k)) AS h FROM n WHERE k <> 0 GROUP BY folder_path),
  rep AS (SELECT folder_path, list_sort(list(k)) AS r FROM (SELECT folder_path, k FROM n WHERE k <> 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY folder_path),
  numbers AS (SELECT folder_path, coalesce(r, []) AS repeats, CASE WHEN len(h) >= 2 THEN list_filter(range(h[1], h[-1] + 1), lambda x: NOT list_contains(h, x)) ELSE [] END AS gaps FROM have LEFT JOIN rep USING (folder_path)),
  scored AS (SELECT *, greatest(0.0, 1 - least(0.30, len(gaps) * 0.06) - least(0.20, len(repeats) * 0.07)) AS completeness FROM numbers)"""


@query(
    f"""WITH {TRACKS_SQL}, {NUMBERS_SQL}, l AS (SELECT folder_path, k + 1 AS a, lead(k) OVER (PARTITION BY folder_path ORDER BY k) - 1 AS b FROM (SELECT DISTINCT folder_path, k FROM n WHERE k <> 0)),
    g AS (SELECT folder_path, list(a || '-' || b ORDER BY a) AS runs, CAST(sum(b - a + 1) AS BIGINT) AS missing FROM l WHERE b >= a GROUP BY folder_path)
    SELECT folder_path, repeats, coalesce(runs, []) AS gaps, coalesce(missing, 0) AS gap_count, completeness, coalesce(missing, 0) = 0 AND len(repeats) = 0 AS consecutive FROM scored LEFT JOIN g USING (folder_path)"""
)
def a08_gaps_and_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numbers(A.tracks(spark, sf), FOLDER, T.track_number(F.col("tracknumber")))


@query(
    f"""WITH {TRACKS_SQL}, n AS (SELECT DISTINCT parent_path, CAST(regexp_extract(isrc, '[0-9]+', 0) AS BIGINT) AS k FROM v_tracks), l AS (SELECT parent_path, k + 1 AS first, lead(k) OVER (PARTITION BY parent_path ORDER BY k) - 1 AS last FROM n)
    SELECT parent_path, first, last, last - first + 1 AS missing FROM l WHERE last >= first"""
)
def a10_gap_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of numbers that a parent's files lack, however long, a row each."""
    return order.gap_ranges(A.tracks(spark, sf), ["parent_path"], F.regexp_extract("isrc", r"\d+", 0).cast("long"))


@query(
    f"""WITH {TRACKS_SQL} SELECT folder_path, CASE WHEN count(DISTINCT lower(trim(title))) = 1 AND count(title) > 2 THEN least(0.3, sum(CASE WHEN length(trim(title)) >= 2 THEN 1 ELSE 0 END) * 1.0 / count(title))
    ELSE sum(CASE WHEN length(trim(title)) >= 2 THEN 1 ELSE 0 END) * 1.0 / count(title) END AS title_quality FROM v_tracks GROUP BY folder_path"""
)
def a11_title_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.titles(A.tracks(spark, sf), FOLDER)


SIMILAR_SQL = """CASE WHEN {a} = {b} THEN 1.0 ELSE greatest(len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' ')))) * 1.0 / len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))),
  len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i])) * 1.0 / greatest(length({a}), length({b}))) END"""


@query(f"WITH {TRACKS_SQL}, s AS (SELECT folder_path, lower(genre) AS a, lower(title) AS b FROM v_tracks) SELECT folder_path, avg({SIMILAR_SQL.format(a='a', b='b')}) AS filename_consistency FROM s GROUP BY folder_path")
def a12_filename_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return quality.filename_consistency(A.tracks(spark, sf), FOLDER, F.col("genre"))


@query(
    f"""WITH {TRACKS_SQL}, c AS (SELECT folder_path, round(CASE WHEN artist <> '' THEN 0.20 ELSE 0 END + CASE WHEN title <> '' THEN 0.20 ELSE 0 END + CASE WHEN album <> '' THEN 0.15 ELSE 0 END + CASE WHEN albumartist <> '' THEN 0.10 ELSE 0 END
    + CASE WHEN year <> '' THEN 0.10 ELSE 0 END + CASE WHEN genre <> '' THEN 0.08 ELSE 0 END + CASE WHEN bpm <> '' THEN 0.07 ELSE 0 END + CASE WHEN isrc <> '' THEN 0.02 ELSE 0 END, 3)::DOUBLE AS c FROM v_tracks)
    SELECT folder_path, avg(c) AS avg_completeness, min(c) AS min_completeness FROM c GROUP BY folder_path"""
)
def a14_tag_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness(A.tracks(spark, sf), FOLDER)


PRESENT = ["album", "albumartist", "artist", "title", "year", "genre", "bpm", "isrc", "compilation"]


@query(f"WITH {TRACKS_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS empty, count({f}) * 1.0 / count(*) AS rate FROM v_tracks" for f in PRESENT))
def a19_field_presence(spark: SparkSession, sf: str) -> DataFrame:
    return quality.presence(A.tracks(spark, sf), PRESENT)


@query(
    f"""WITH {TRACKS_SQL}, s AS (SELECT folder_path, isrc, count(DISTINCT ext) AS n, string_agg(DISTINCT ext, '|' ORDER BY ext) AS formats FROM (SELECT parent_path AS folder_path, isrc, CASE WHEN size % 2000 = 0 THEN '.wav' ELSE ext END AS ext FROM v_tracks) GROUP BY ALL)
    SELECT folder_path, isrc AS stem, formats FROM s WHERE n > 1"""
)
def a07_stems_in_several_formats(spark: SparkSession, sf: str) -> DataFrame:
    files = A.tracks(spark, sf).select(F.col("parent_path").alias("folder_path"), F.col("isrc").alias("stem"), F.when(F.col("size") % 2000 == 0, ".wav").otherwise(F.col("ext")).alias("ext"))
    found = files.groupBy("folder_path", "stem").agg(F.array_sort(F.collect_set("ext")).alias("f"))
    return found.filter(F.size("f") > 1).select("folder_path", "stem", F.array_join("f", "|").alias("formats"))


# Confidence and routing


def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    proposed = F.concat(F.initcap("albumartist"), F.lit(" - "), F.initcap("album"))
    return quality.confidence(A.tracks(spark, sf), FOLDER, F.concat("album", F.lit(" "), F.col("folder_path")), proposed, stem_title=F.col("genre"))


TOKENS_SQL = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1)"
CONFIDENCE_SQL = f"""{TRACKS_SQL}, {NUMBERS_SQL},
  low AS (SELECT *, lower(trim(album)) AS la, lower(trim(albumartist)) AS laa, lower(trim(artist)) AS lar FROM v_tracks),
  va AS (SELECT folder_path, winner, share FROM {votes.plurality_sql('low', 'folder_path', 'la', 'file_id')}), vaa AS (SELECT folder_path, winner, share FROM {votes.plurality_sql('low', 'folder_path', 'laa', 'file_id')}),
  var_ AS (SELECT folder_path, winner, share FROM {votes.plurality_sql('low', 'folder_path', 'lar', 'file_id')}),
  tq AS (SELECT folder_path, count(*) AS files, CASE WHEN count(DISTINCT lower(title)) = 1 AND count(*) > 2 THEN 0.3 ELSE 1.0 END AS title_quality FROM v_tracks GROUP BY folder_path),
  sim AS (SELECT folder_path, lower(genre) AS a, lower(title) AS b FROM v_tracks), fc AS (SELECT folder_path, avg({SIMILAR_SQL.format(a='a', b='b')}) AS filename_consistency FROM sim GROUP BY folder_path),
  named AS (SELECT tq.folder_path, files, 1.0 AS tag_coverage, CASE WHEN vaa.share IS NOT NULL THEN va.share * 0.6 + vaa.share * 0.4 ELSE va.share * 0.7 + var_.share * 0.3 END AS dominance, title_quality, filename_consistency, completeness,
    coalesce(vaa.share, 0.5) AS aa_consistency, va.winner || ' ' || tq.folder_path AS folder_name, array_to_string(list_transform(string_split(coalesce(vaa.winner, var_.winner), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS who,
    array_to_string(list_transform(string_split(va.winner, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS what, len(gaps) AS track_gaps, len(repeats) AS track_dupes
    FROM tq JOIN va USING (folder_path) LEFT JOIN vaa USING (folder_path) JOIN var_ USING (folder_path) JOIN fc USING (folder_path) JOIN scored USING (folder_path)),
  tok AS (SELECT *, who || ' - ' || what AS proposed_name, {TOKENS_SQL.format(x='folder_name')} AS own, {TOKENS_SQL.format(x="who || ' - ' || what")} AS wanted, {TOKENS_SQL.format(x='what')} AS rest FROM named),
  aligned AS (SELECT *, greatest(len(list_filter(wanted, lambda t: list_contains(own, t))) * 1.0 / len(wanted), len(list_filter(rest, lambda t: list_contains(own, t))) * 1.0 / len(rest)) AS folder_alignment FROM tok),
  confident AS (SELECT folder_path, files, folder_name, proposed_name, dominance, tag_coverage, title_quality, filename_consistency, completeness, aa_consistency, folder_alignment, track_gaps, track_dupes,
    least(1.0, dominance * 0.4 + tag_coverage * 0.15 + title_quality * 0.12 + filename_consistency * 0.07 + completeness * 0.12 + aa_consistency * 0.06 + folder_alignment * 0.08) AS confidence FROM aligned)"""


@query(f"WITH {CONFIDENCE_SQL} SELECT * FROM confident")
def c07_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _confidence(spark, sf)


@query(
    f"""WITH {TRACKS_SQL}, facts AS (SELECT folder_path, count(year) * 1.0 / count(*) AS presence FROM v_tracks GROUP BY folder_path), w AS (SELECT * FROM {votes.plurality_sql('v_tracks', 'folder_path', 'year', 'file_id')})
    SELECT folder_path, CASE WHEN share >= 0.7 THEN CAST(winner AS INT) END AS picked, CASE WHEN share < 0.7 THEN 'agreement_low' END AS reason, presence, share AS agreement FROM facts LEFT JOIN w USING (folder_path)"""
)
def c08_year_pick(spark: SparkSession, sf: str) -> DataFrame:
    return quality.year_pick(A.tracks(spark, sf), FOLDER)


ROUTE_SQL = f"""WITH {CONFIDENCE_SQL}, p AS (SELECT folder_path, folder_name, proposed_name || ' ' || CAST(files AS VARCHAR) AS proposed_name, confidence, track_gaps * 0.1 AS unreadable_ratio FROM confident),
  existing AS (SELECT DISTINCT 'Supplier ' || CAST(s_suppkey % 3 AS VARCHAR) || ' - Brand#1' || CAST(s_suppkey % 4 AS VARCHAR) || ' 4' AS name FROM supplier),
  o AS (SELECT *, row_number() OVER (PARTITION BY proposed_name ORDER BY folder_path) AS k, first_value(folder_path) OVER (PARTITION BY proposed_name ORDER BY folder_path) AS first_, EXISTS (SELECT 1 FROM existing WHERE name = proposed_name) AS there FROM p),
  routed AS (SELECT folder_path, folder_name, proposed_name, confidence, unreadable_ratio, CASE WHEN unreadable_ratio > 0.25 THEN 'review' WHEN k > 1 OR there THEN 'duplicate' WHEN confidence < 0.85 THEN 'review' ELSE 'clean' END AS destination,
    list_filter([CASE WHEN confidence < 0.85 THEN 'low_confidence' END, CASE WHEN k > 1 THEN 'duplicate_in_run:' || first_ END, CASE WHEN there THEN 'already_in_clean' END, CASE WHEN unreadable_ratio > 0.25 THEN 'unreadable_ratio_high' END], lambda x: x IS NOT NULL) AS reasons FROM o),
  tiered AS (SELECT *, CASE WHEN list_has_any(reasons, ['already_in_clean', 'unreadable_ratio_high']) THEN CASE WHEN destination = 'review' THEN 'prob' ELSE 'prob' END WHEN confidence >= 0.85 AND destination = 'clean' THEN 'high' WHEN destination = 'review' THEN 'prob' ELSE 'mid' END AS tier FROM routed)"""


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    p = _confidence(spark, sf).select("folder_path", "folder_name", F.concat("proposed_name", F.lit(" "), F.col("files").cast("string")).alias("proposed_name"), "confidence", (F.col("track_gaps") * 0.1).alias("unreadable_ratio"))
    k = F.col("s_suppkey")
    existing = read(spark, sf, "supplier").select(F.concat(F.lit("Supplier "), (k % 3).cast("string"), F.lit(" - Brand#1"), (k % 4).cast("string"), F.lit(" 4")).alias("name"))
    return routing.route(p, existing)


@query(f"{ROUTE_SQL} SELECT folder_path, folder_name, proposed_name, confidence, unreadable_ratio, destination, reasons FROM routed")
def c09_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf)


@query(f"{ROUTE_SQL} SELECT folder_path, destination, tier, confidence, CASE WHEN tier = 'prob' THEN confidence ELSE -confidence END AS tier_order FROM tiered")
def c10_triage(spark: SparkSession, sf: str) -> DataFrame:
    return routing.triage(_routed(spark, sf)).select("folder_path", "destination", "tier", "confidence", "tier_order")


@query(f"{ROUTE_SQL}, e AS (SELECT unnest(reasons) AS r FROM routed) SELECT string_split(r, ':')[1] AS reason, count(*) AS n FROM e GROUP BY 1")
def a33_reason_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select(F.explode("reasons").alias("r")).groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


# Duplicates


@query(
    f"""WITH {TRACKS_SQL}, e AS (SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, 'isrc' AS signal_type, a.isrc AS signal_value, 1.0 AS similarity FROM v_tracks a JOIN v_tracks b ON a.isrc = b.isrc AND a.file_id < b.file_id)
    SELECT signal_type, signal_value, count(*) AS pairs, min(file_id_a) AS first_a, max(file_id_b) AS last_b, min(similarity) AS similarity FROM e GROUP BY ALL"""
)
def j01_same_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.identifier_groups(A.tracks(spark, sf))


@query(
    f"""WITH {TRACKS_SQL}, t AS (SELECT file_id, lower(title) AS v, duration_sec AS d FROM v_tracks), e AS (SELECT a.file_id AS file_id_a, b.file_id AS file_id_b, 'title_duration' AS signal_type, a.v AS signal_value, 0.9 AS similarity
    FROM t a JOIN t b ON a.v = b.v AND a.file_id < b.file_id AND abs(a.d - b.d) < 2.0) SELECT signal_type, signal_value, count(*) AS pairs, min(file_id_a) AS first_a, max(file_id_b) AS last_b, min(similarity) AS similarity FROM e GROUP BY ALL"""
)
def j02_same_title_and_length(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_duration_groups(A.tracks(spark, sf))


@query(
    """WITH i AS (SELECT p_brand AS pair, p_name AS title FROM part WHERE p_partkey % 2 = 0), x AS (SELECT DISTINCT p_brand AS pair, p_name AS title FROM part WHERE p_partkey % 2 = 1),
    w AS (SELECT pair, title, list_distinct(string_split(lower(title), ' ')) AS a FROM i), h AS (SELECT pair, list_distinct(string_split(lower(title), ' ')) AS b FROM x),
    m AS (SELECT w.pair, w.title, max(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b)))) AS best FROM (SELECT DISTINCT * FROM w) w JOIN h ON w.pair = h.pair GROUP BY ALL)
    SELECT i.pair, i.title, coalesce(best, 0.0) AS best, coalesce(best, 0.0) >= 0.9 AS matched FROM i LEFT JOIN m ON i.pair = m.pair AND i.title = m.title"""
)
def j12_best_title_match(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    titled = part.select(F.col("p_brand").alias("pair"), F.col("p_name").alias("title"), (F.col("p_partkey") % 2).alias("odd"))
    return dedupe.best_match(titled.filter("odd = 0"), titled.filter("odd = 1"))


# Runs and logs


@query(
    f"""WITH {session_sql('a', False)}, {session_sql('b', True)} SELECT coalesce(a.proposed_name, b.proposed_name) AS proposed_name, a.destination AS destination_a, a.confidence AS confidence_a, b.destination AS destination_b, b.confidence AS confidence_b,
    CASE WHEN b.destination IS NULL THEN 'only_a' WHEN a.destination IS NULL THEN 'only_b' WHEN a.destination <> b.destination THEN 'destination_changed' WHEN abs(a.confidence - b.confidence) > 0.05 THEN 'confidence_moved' ELSE 'same' END AS change
    FROM a FULL JOIN b ON a.proposed_name = b.proposed_name"""
)
def j09_session_diff(spark: SparkSession, sf: str) -> DataFrame:
    return runs.diff(A.sessions(spark, sf, False), A.sessions(spark, sf, True))


@query(
    f"""WITH {session_sql('a', False)}, {session_sql('b', True)}, m AS (SELECT proposed_name AS name FROM a), d AS (SELECT proposed_name AS name FROM b)
    SELECT coalesce(m.name, d.name) AS name, CASE WHEN d.name IS NULL THEN 'missing_on_disk' WHEN m.name IS NULL THEN 'not_in_manifest' ELSE 'ok' END AS status FROM m FULL JOIN d ON m.name = d.name"""
)
def j13_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("proposed_name").alias("name")
    return runs.reconcile(A.sessions(spark, sf, False).select(name), A.sessions(spark, sf, True).select(name))


@query(f"WITH {session_sql('a', False)}, {session_sql('b', True)} SELECT * FROM a WHERE proposed_name NOT IN (SELECT proposed_name FROM b)")
def j08_resume(spark: SparkSession, sf: str) -> DataFrame:
    return runs.resume(A.sessions(spark, sf, False), A.sessions(spark, sf, True), "proposed_name")


@query(
    f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY original_path) AS k FROM v_history)
    SELECT session_id, min(timestamp) AS first_ts, max(timestamp) AS last_ts, count(*) AS actions, count_if(destination = 'clean') AS clean, count_if(destination = 'review') AS review, count_if(destination = 'duplicate') AS duplicate,
    string_agg(original_path, '|' ORDER BY original_path) FILTER (k <= 3) AS examples FROM r GROUP BY session_id"""
)
def a28_session_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    return runs.roll_up(A.history(spark, sf))


@query(f"WITH {HISTORY_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY timestamp DESC, ord DESC) AS r FROM v_history) WHERE r = 1")
def w06_latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest(A.history(spark, sf), ["target_path"], [F.desc("timestamp"), F.desc("ord")])


@query(f"WITH {HISTORY_SQL} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target_path ORDER BY ord) AS r FROM v_history) WHERE r = 1")
def s14_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return runs.first_only(A.history(spark, sf), ["target_path"], ["ord"])


@query(f"WITH {HISTORY_SQL} SELECT session_id, max(timestamp) AS last_ts FROM v_history GROUP BY session_id ORDER BY last_ts DESC, session_id DESC OFFSET 1 LIMIT 1")
def w05_previous_session(spark: SparkSession, sf: str) -> DataFrame:
    return runs.nth_latest(A.history(spark, sf), 2)


@query(
    f"""WITH {HISTORY_SQL}, t AS (SELECT DISTINCT target_path AS target FROM v_history WHERE destination = 'clean'), p AS (SELECT original_path AS source, target_path AS target FROM v_history WHERE destination <> 'clean' OR ord % 7 = 0),
    n AS (SELECT p.*, row_number() OVER (PARTITION BY p.target ORDER BY source) - CASE WHEN t.target IS NULL THEN 1 ELSE 0 END AS k FROM p LEFT JOIN t ON p.target = t.target)
    SELECT source, target, CASE WHEN k = 0 THEN target ELSE target || ' (' || k || ')' END AS final FROM n"""
)
def w07_free_names(spark: SparkSession, sf: str) -> DataFrame:
    h = A.history(spark, sf)
    plan = h.filter((F.col("destination") != "clean") | (F.col("ord") % 7 == 0)).select(F.col("original_path").alias("source"), F.col("target_path").alias("target"))
    return runs.free_names(plan, h.filter("destination = 'clean'").select(F.col("target_path").alias("target")))


@query(
    """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(min(l_linenumber) AS DOUBLE) AS now FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey), c AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, 2.0 AS t FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT coalesce(l.path, c.path) AS path, CASE WHEN now IS NULL THEN 'evict' WHEN t IS NULL OR abs(now - t) > 0.01 THEN 'read' ELSE 'keep' END AS action FROM l FULL JOIN c ON l.path = c.path"""
)
def s11_incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda c: F.col(c).cast("string").alias("path")
    listing = read(spark, sf, "lineitem").filter("l_linenumber > 1").groupBy(path("l_orderkey")).agg(F.min("l_linenumber").cast("double").alias("mtime"))
    cache = read(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(path("o_orderkey"), F.lit(2.0).alias("mtime"))
    return runs.incremental(listing, cache)


# Learning


LEARN_SQL = f"""WITH {REVIEWS_SQL}, t AS (SELECT {{by}}, count(*) AS total, count_if(verdict = 'accept') AS accepted, count_if(verdict = 'reject') AS rejected, count_if(verdict = 'skip') AS skipped FROM v_reviews GROUP BY ALL),
  r AS (SELECT *, CASE fix_type WHEN 'noise_removal' THEN 'safe' WHEN 'whitespace' THEN 'safe' WHEN 'artist_normalize' THEN 'destructive' ELSE 'moderate' END AS risk_tier, accepted + rejected AS judged FROM t),
  n AS (SELECT *, CASE risk_tier WHEN 'safe' THEN 20 WHEN 'moderate' THEN 50 ELSE 100 END AS needed, CASE risk_tier WHEN 'safe' THEN 0.85 WHEN 'moderate' THEN 0.92 ELSE 0.98 END::DOUBLE AS dflt, CASE WHEN judged > 0 THEN accepted * 1.0 / judged ELSE 0.0 END AS hit_rate FROM r),
  w AS (SELECT *, least(judged / (2.0 * needed), 0.8) AS weight FROM n)
  SELECT * EXCLUDE (dflt), judged >= needed AND hit_rate >= 0.9 AS graduated, round(dflt * (1 - weight) + hit_rate * weight, 4) AS learned_confidence, greatest(0, needed - judged) AS to_graduation FROM w"""


@query(LEARN_SQL.format(by="fix_type"))
def c17_learned_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return learn.learned(A.reviews(spark, sf), ["fix_type"])


@query(LEARN_SQL.format(by="fix_type, source_label"))
def c19_learned_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return learn.learned(A.reviews(spark, sf), ["fix_type", "source_label"])


@query(f"WITH {REVIEWS_SQL} SELECT fix_type, count_if(verdict = 'accept') AS accept, count_if(verdict = 'reject') AS reject, count_if(verdict = 'skip') AS skip FROM v_reviews GROUP BY fix_type")
def a22_verdict_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return A.reviews(spark, sf).groupBy("fix_type").pivot("verdict", ["accept", "reject", "skip"]).count().na.fill(0)


# Expressions


@query(
    f"""WITH {TRACKS_SQL}, b AS (SELECT DISTINCT CAST(bpm AS DOUBLE) + size % 2000 / 2000.0 AS tempo FROM v_tracks) SELECT tempo, CASE WHEN tempo BETWEEN 60 AND 99 THEN 'Downtempo' WHEN tempo BETWEEN 100 AND 119 THEN 'Mid-Tempo' WHEN tempo BETWEEN 120 AND 132 THEN 'House'
    WHEN tempo BETWEEN 133 AND 145 THEN 'Techno' WHEN tempo BETWEEN 160 AND 180 THEN 'D&B / Jungle' ELSE concat(CAST(CAST(floor(tempo / 10) * 10 AS INT) AS VARCHAR), '-', CAST(CAST(floor(tempo / 10) * 10 AS INT) + 9 AS VARCHAR)) END AS zone FROM b"""
)
def f37_tempo_zones(spark: SparkSession, sf: str) -> DataFrame:
    tempo = A.tracks(spark, sf).select((F.col("bpm").cast("double") + F.col("size") % 2000 / 2000.0).alias("tempo")).distinct()
    return tempo.withColumn("zone", T.tempo_zone(F.col("tempo")))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[\\[\\(][^\\[\\]\\(\\)]*[\\]\\)]')) AS brackets, regexp_matches(lower(text), 'www\\.|\\.com\\b|\\.net\\b|\\.org\\b|free\\s+download|promo\\s+only|not\\s+for\\s+sale|leaked|visit\\s+us|check\\s+out|follow\\s+us') AS watermark,
    coalesce(try_cast(regexp_extract(text, '(\\d{2,3})\\s*[bB][pP][mM]', 1) AS INT), -1) AS bpm FROM documents"""
)
def f11_garbage_signs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    bpm = F.regexp_extract(t, r"(\d{2,3})\s*[bB][pP][mM]", 1).try_cast("int")
    return read(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(T.BRACKETED), F.lit(0))).cast("long").alias("brackets"), F.lower(t).rlike(T.WATERMARK).alias("watermark"), F.coalesce(bpm, F.lit(-1)).alias("bpm"))


@query(
    """WITH n AS (SELECT DISTINCT name FROM (SELECT CASE s_suppkey % 4 WHEN 0 THEN s_name || ' & Co' WHEN 1 THEN s_name || ' feat. Co' WHEN 2 THEN upper(s_name) || ' and CO' ELSE s_name || ' + co' END AS name FROM supplier UNION ALL SELECT CASE c_custkey % 2 WHEN 0 THEN c_name ELSE lower(c_name) END FROM customer)),
    k AS (SELECT name, regexp_replace(regexp_replace(lower(trim(name)), '\\s*[&+×]\\s*|\\s+(?:and|vs\\.?|versus|feat\\.?|featuring|ft\\.?)\\s+', ' & ', 'g'), '\\s+', ' ', 'g') AS normalized FROM n)
    SELECT normalized, count(*) AS variants, min(name) AS first_name, max(name) AS last_name FROM k GROUP BY normalized"""
)
def a24_name_variants(spark: SparkSession, sf: str) -> DataFrame:
    s, c = read(spark, sf, "supplier"), read(spark, sf, "customer")
    k, n = F.col("s_suppkey") % 4, F.col("s_name")
    name = F.when(k == 0, F.concat(n, F.lit(" & Co"))).when(k == 1, F.concat(n, F.lit(" feat. Co"))).when(k == 2, F.concat(F.upper(n), F.lit(" and CO"))).otherwise(F.concat(n, F.lit(" + co")))
    names = s.select(name.alias("name")).unionByName(c.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lower("c_name")).alias("name"))).distinct()
    return names.groupBy(T.connected(F.col("name")).alias("normalized")).agg(F.count("*").alias("variants"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
