"""Further registered queries: classification, plans, filters, reports and file layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import classify, containment, dedupe, runs, votes
from .plans import moves
from .queries import FOLDER, ROUTE_SQL, _routed, query
from .sources import adapters as A
from .sources import files
from .sources.adapters import HISTORY_SQL, REVIEWS_SQL, TRACKS_SQL, read

# Classification


@query(
    f"""WITH {TRACKS_SQL}, t AS (SELECT folder_path, lower(albumartist) AS aa, count(*) AS n, min(file_id) AS f FROM v_tracks WHERE albumartist IS NOT NULL GROUP BY ALL),
    top AS (SELECT folder_path, aa AS top_aa FROM (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY n DESC, f, aa) AS r FROM t) WHERE r = 1),
    x AS (SELECT folder_path, count(*) AS files, count(artist) AS artists, count(DISTINCT lower(artist)) AS distinct_artists FROM v_tracks GROUP BY folder_path)
    SELECT x.*, top_aa, CASE WHEN files BETWEEN 2 AND 6 THEN 'ep' WHEN top_aa IS NOT NULL THEN 'album' WHEN artists >= 3 AND distinct_artists * 1.0 / artists >= 0.8 THEN 'mix' ELSE 'album' END AS content_type FROM x LEFT JOIN top USING (folder_path)"""
)
def c03_content_type(spark: SparkSession, sf: str) -> DataFrame:
    return classify.content_type(A.tracks(spark, sf), FOLDER, F.col("folder_path"))


@query(
    f"""WITH {TRACKS_SQL}, k AS (SELECT parent_path, file_id, lower(artist) AS artist_key, lower(album) AS album_key, CAST(string_split(tracknumber, '/')[1] AS INT) AS k FROM v_tracks),
    f AS (SELECT parent_path, artist_key, album_key, count(*) AS tracks, count(k) AS numbered, count(DISTINCT k) AS d, min(k) AS first, max(k) AS last, min(file_id) AS first_file FROM k GROUP BY ALL), g AS (SELECT *, last - first + 1 - d AS gaps FROM f)
    SELECT parent_path, artist_key, album_key, tracks, first, last, gaps, first_file, gaps > 0 OR first > 1 AS partial FROM g WHERE tracks >= 2 AND numbered = d AND gaps <= greatest(1, tracks // 4)"""
)
def c05_embedded_releases(spark: SparkSession, sf: str) -> DataFrame:
    return classify.embedded_releases(A.tracks(spark, sf), ["parent_path"], F.col("artist"), F.col("album"), T.track_number(F.col("tracknumber")), least=2)


@query(
    f"""WITH {TRACKS_SQL} SELECT folder_path, count(*) AS files, least(1.0, count(DISTINCT lower(album)) * 1.0 / count(*)) AS album_diversity, count_if(ext = '.mp3') * 1.0 / count(*) AS low_quality, sum(CASE WHEN v_tracks.compilation = '1' THEN 1 ELSE 0 END) * 1.0 / count(*) AS compilation,
    0.0 AS unnumbered FROM v_tracks GROUP BY folder_path"""
)
def a18_crate_facts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.crate_facts(A.tracks(spark, sf), FOLDER)


# Plans


@query(
    f"""{ROUTE_SQL}, e AS (SELECT folder_path AS source, 'clean/' || proposed_name AS target FROM routed WHERE destination = 'clean'), t AS (SELECT DISTINCT 'clean/' || proposed_name AS target FROM routed WHERE track_ = 1),
    nn AS (SELECT e.*, row_number() OVER (PARTITION BY e.target ORDER BY source) - CASE WHEN t.target IS NULL THEN 1 ELSE 0 END AS k FROM e LEFT JOIN t ON e.target = t.target)
    SELECT source, 'clean' AS destination, CASE WHEN k = 0 THEN target ELSE target || ' (' || k || ')' END AS final, NULL AS skipped FROM nn
    UNION ALL SELECT folder_path, destination, NULL, 'destination_' || destination FROM routed WHERE destination <> 'clean'""".replace("WHERE track_ = 1", "WHERE destination = 'review'")
)
def c30_move_plan(spark: SparkSession, sf: str) -> DataFrame:
    routed = _routed(spark, sf)
    return moves.move_plan(routed, routed.filter("destination = 'review'").select(F.concat(F.lit("clean/"), "proposed_name").alias("target")), "clean")


@query(
    f"""WITH {HISTORY_SQL}, s AS (SELECT session_id FROM v_history GROUP BY session_id ORDER BY max(timestamp) DESC, session_id DESC LIMIT 1), l AS (SELECT h.* FROM v_history h JOIN s USING (session_id)), t AS (SELECT DISTINCT original_path AS target FROM v_history WHERE ord % 5 = 0),
    n AS (SELECT l.*, row_number() OVER (PARTITION BY original_path ORDER BY ord) - CASE WHEN t.target IS NULL THEN 1 ELSE 0 END AS k FROM l LEFT JOIN t ON original_path = t.target)
    SELECT action_id, target_path AS source, CASE WHEN k = 0 THEN original_path ELSE original_path || ' (UNDO' || k || ')' END AS final, timestamp FROM n"""
)
def c21_undo_plan(spark: SparkSession, sf: str) -> DataFrame:
    h = A.history(spark, sf)
    last = h.join(runs.nth_latest(h, 1).select("session_id"), "session_id")
    return moves.undo_plan(last, h.filter("ord % 5 = 0").select(F.col("original_path").alias("target"))).drop("skipped")


@query(
    f"""WITH {HISTORY_SQL}, l AS (SELECT action_id, timestamp, ord, target_path AS source, original_path[:4] || 'x.mp3' AS target FROM v_history WHERE contains(original_path, 'in/1')), t AS (SELECT DISTINCT original_path[:4] || 'x.mp3' AS target FROM v_history WHERE ord % 5 = 0),
    h AS (SELECT DISTINCT target_path AS source FROM v_history WHERE ord % 3 > 0 AND destination <> 'duplicate'), n AS (SELECT l.*, row_number() OVER (PARTITION BY l.target ORDER BY ord) - CASE WHEN t.target IS NULL THEN 1 ELSE 0 END AS k FROM l SEMI JOIN h USING (source) LEFT JOIN t USING (target))
    SELECT action_id, source, CASE WHEN k = 0 THEN target ELSE target[:len(target) - 4] || ' (UNDO' || k || ').mp3' END AS final, timestamp, NULL AS skipped FROM n
    UNION ALL SELECT action_id, source, NULL, timestamp, 'missing' FROM l ANTI JOIN h USING (source)"""
)
def c21_undo_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Moves undone by a part of their path: what is not there any more is skipped, what is taken again gets a number before its extension."""
    h = A.history(spark, sf)
    short = F.concat(F.substring("original_path", 1, 4), F.lit("x.mp3"))
    some = moves.chosen(h, path="in/1").withColumn("original_path", short)
    there = h.filter("ord % 3 > 0 AND destination <> 'duplicate'").select(F.col("target_path").alias("source"))
    return moves.undo_plan(some, h.filter("ord % 5 = 0").select(short.alias("target")), there)


@query(
    f"""WITH {HISTORY_SQL}, s AS (SELECT session_id AS apply_session_id, original_path AS file_path, destination AS field_name, CAST(ord AS VARCHAR) AS original_value, CAST(ord + 1 AS VARCHAR) AS new_value, ord, ord % 4 > 0 AS written, ord % 9 = 0 AS undone FROM v_history)
    SELECT file_path[:4] AS file_path, field_name, arg_min(original_value, ord) AS restored, arg_max(new_value, ord) AS found, count(*) AS changes FROM s WHERE written AND NOT undone AND contains(file_path, '/2') GROUP BY ALL"""
)
def c21_undo_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag changes taken back by a part of the files' paths: each field gets its oldest value again."""
    n = F.col("ord")
    snapshots = A.history(spark, sf).filter(F.col("original_path").contains("/2")).select(
        F.col("session_id").alias("apply_session_id"), F.substring("original_path", 1, 4).alias("file_path"), F.col("destination").alias("field_name"), n.cast("string").alias("original_value"), (n + 1).cast("string").alias("new_value"), "ord", (n % 4 > 0).alias("written"), (n % 9 == 0).alias("undone")
    )
    return moves.undo_tags(snapshots)


# Filters and joins


@query(
    f"""WITH {TRACKS_SQL}, keep AS (SELECT folder_path FROM v_tracks WHERE ext IN ('.mp3', '.flac') GROUP BY folder_path HAVING count(*) >= 3)
    SELECT file_id, folder_path, ext FROM v_tracks WHERE ext IN ('.mp3', '.flac') AND mtime >= DATE '1996-01-01' AND NOT starts_with(folder_path, 'o99') AND NOT regexp_matches(folder_path, '^o1[0-9]$') AND folder_path IN (SELECT folder_path FROM keep)"""
)
def p01_candidate_files(spark: SparkSession, sf: str) -> DataFrame:
    """Extension list, least tracks of a folder, modified since, ignored names and prefixes."""
    files_ = A.tracks(spark, sf).filter(F.col("ext").isin(".mp3", ".flac"))
    enough = files_.groupBy("folder_path").count().filter("count >= 3").select("folder_path")
    kept = files_.filter((F.col("mtime") >= F.lit("1996-01-01").cast("date")) & ~F.col("folder_path").startswith("o99") & ~F.col("folder_path").rlike("^o1[0-9]$"))
    return kept.join(enough, "folder_path", "left_semi").select("file_id", "folder_path", "ext")


FIELDS = ["album", "albumartist", "artist", "genre", "compilation"]


@query(f"WITH {TRACKS_SQL} " + " UNION ALL ".join(f"SELECT file_id, '{f}' AS field_name, trim({f}) AS raw_value, CAST(length(trim({f})) AS INT) AS value_length FROM v_tracks WHERE trim({f}) <> ''" for f in FIELDS))
def p09_wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    long = A.tracks(spark, sf).unpivot("file_id", FIELDS, "field_name", "raw_value").withColumn("raw_value", F.trim("raw_value"))
    return long.filter("raw_value != ''").withColumn("value_length", F.length("raw_value"))


@query(f"WITH {TRACKS_SQL} SELECT file_id, album, albumartist, artist, genre, compilation FROM v_tracks")
def p08_long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    return p09_wide_to_long(spark, sf).groupBy("file_id").pivot("field_name", FIELDS).agg(F.first("raw_value"))


@query(
    """SELECT page_id, regexp_matches(lower(url), '(www\\.|https?://|\\.(com|net|org)\\b)') AS garbage, CAST(len(string_split(url, '/')) - 1 AS INT) AS depth, length(url) > 60 AS too_long,
    CASE WHEN ends_with(lower(url), '.html') THEN 'keep' WHEN contains(url, '?') THEN 'quarantine' WHEN contains(url, '#') THEN 'ignore' ELSE 'unknown' END AS disposition FROM pages"""
)
def p12_path_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Garbage values, depth, over-long paths and disposition."""
    u = F.col("url")
    kind = F.when(F.lower(u).endswith(".html"), "keep").when(u.contains("?"), "quarantine").when(u.contains("#"), "ignore").otherwise("unknown")
    return read(spark, sf, "pages").select("page_id", F.lower(u).rlike(r"(www\.|https?://|\.(com|net|org)\b)").alias("garbage"), (F.size(F.split(u, "/")) - 1).alias("depth"), (F.length(u) > 60).alias("too_long"), kind.alias("disposition"))


@query(f"WITH {HISTORY_SQL} SELECT action_id, session_id, date_diff('day', CAST(timestamp AS DATE), (SELECT max(CAST(timestamp AS DATE)) FROM v_history)) AS age_days FROM v_history WHERE destination = 'review' AND contains(target_path, 'view') AND date_diff('day', CAST(timestamp AS DATE), (SELECT max(CAST(timestamp AS DATE)) FROM v_history)) > 7")
def p17_review_age(spark: SparkSession, sf: str) -> DataFrame:
    """Entries under review for over a week, by path and age."""
    h = A.history(spark, sf)
    newest = h.agg(F.max(F.to_date("timestamp")).alias("newest"))
    aged = h.filter((F.col("destination") == "review") & F.col("target_path").contains("view")).withColumn("age_days", F.date_diff(newest.scalar(), F.to_date("timestamp")))
    return aged.filter("age_days > 7").select("action_id", "session_id", F.col("age_days").cast("long").alias("age_days"))


@query(
    """WITH a AS (SELECT n_name AS alias, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0), c AS (SELECT c_custkey, upper(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, coalesce(canonical, name) AS name FROM c LEFT JOIN a ON lower(name) = lower(alias)"""
)
def j04_alias_look_up(spark: SparkSession, sf: str) -> DataFrame:
    """Names by a dictionary, without regard to case; those not in it stay."""
    nation, region, customer = (read(spark, sf, t) for t in ("nation", "region", "customer"))
    aliases = nation.filter("n_nationkey % 2 = 0").join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.lower("n_name").alias("alias"), F.col("r_name").alias("canonical"))
    named = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.upper("n_name").alias("raw"))
    return named.join(aliases, F.lower("raw") == F.col("alias"), "left").select("c_custkey", F.coalesce("canonical", "raw").alias("name"))


@query(
    """WITH k AS (SELECT p_partkey, ['Am','A minor','am','F#','C major','Bbm','E','x'][p_partkey % 8 + 1] AS key FROM part) SELECT p_partkey, key, CASE key WHEN 'Am' THEN '8A' WHEN 'A minor' THEN '8A' WHEN 'am' THEN '8A' WHEN 'F#' THEN '2B' WHEN 'C major' THEN '8B' WHEN 'Bbm' THEN '3A' WHEN 'E' THEN '12B' ELSE '' END AS wheel FROM k"""
)
def j06_key_to_wheel(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.array(*map(F.lit, ["Am", "A minor", "am", "F#", "C major", "Bbm", "E", "x"]))
    keyed = read(spark, sf, "part").select("p_partkey", F.get(keys, F.col("p_partkey").cast("int") % 8).alias("key"))
    return keyed.withColumn("wheel", T.camelot(F.col("key")))


@query(f"WITH {TRACKS_SQL}, d AS (SELECT a.isrc, count(*) AS pairs, count(DISTINCT a.folder_path) AS folders, max(b.folder_path) AS last_folder FROM v_tracks a JOIN v_tracks b ON a.isrc = b.isrc AND a.file_id < b.file_id GROUP BY a.isrc) SELECT * FROM d")
def j16_duplicates_with_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates with the folders of both sides, by identifier; counted, not paired."""
    return dedupe.identifier_folders(A.tracks(spark, sf))


@query(
    f"""WITH {TRACKS_SQL}, p AS (SELECT DISTINCT parent_path, folder_path, album FROM v_tracks), x AS (SELECT a.folder_path, max(CASE WHEN contains(b.album, a.album) THEN 1 ELSE 0 END) AS hit FROM p a JOIN p b ON a.parent_path = b.parent_path AND a.folder_path <> b.folder_path GROUP BY a.folder_path)
    SELECT folder_path, hit = 1 AS sibling_has_it FROM x"""
)
def j19_sibling_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Whether another folder of the same parent has a folder's album in its own (J19). A parent's albums are few or many:
    they meet through an index of pieces, and a folder's own album is told by counting."""
    p = A.tracks(spark, sf).select("parent_path", "folder_path", "album").distinct()
    scope = F.col("parent_path").alias("scope")
    found = containment.hits(p.select(scope, F.col("album").alias("needle")), p.select(scope, F.col("album").alias("name")))
    alone = p.select("parent_path", "folder_path").distinct().groupBy("parent_path").agg(F.count("*").alias("folders")).filter("folders > 1")
    own = p.alias("x").join(p.alias("y"), (F.col("x.parent_path") == F.col("y.parent_path")) & (F.col("x.folder_path") == F.col("y.folder_path")))  # a folder's own albums
    inside = own.groupBy("x.parent_path", "x.folder_path", "x.album").agg(F.count(F.when(F.contains("y.album", "x.album"), 1)).alias("inside"))
    met = inside.join(found.select(F.col("scope").alias("parent_path"), F.col("needle").alias("album"), "hits"), ["parent_path", "album"], "left").join(alone, "parent_path")
    return met.groupBy("folder_path").agg(F.bool_or(F.coalesce(F.col("hits") > F.col("inside"), F.lit(False))).alias("sibling_has_it"))


# Reports


@query(f"WITH {HISTORY_SQL} SELECT *, actions * 1.0 / sum(actions) OVER (PARTITION BY session_id) AS share FROM (SELECT session_id, destination, count(*) AS actions FROM v_history GROUP BY ALL)")
def a29_actions_by_session(spark: SparkSession, sf: str) -> DataFrame:
    counts = A.history(spark, sf).groupBy("session_id", "destination").agg(F.count("*").alias("actions"))
    return counts.withColumn("share", F.col("actions") / F.sum("actions").over(Window.partitionBy("session_id")))


@query(f"WITH {TRACKS_SQL} SELECT ext, count(*) AS files, count(*) * 1.0 / sum(count(*)) OVER () AS share, CAST(sum(size) AS BIGINT) AS bytes FROM v_tracks GROUP BY ext")
def a31_format_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.tracks(spark, sf).groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return totals.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy()))


@query(
    f"""WITH {TRACKS_SQL}, p AS (SELECT parent_path || '/' || folder_path || '/' || file_id AS path, parent_path, folder_path, size FROM v_tracks) SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files
    FROM (SELECT parent_path AS folder, size FROM p UNION ALL SELECT parent_path || '/' || folder_path, size FROM p UNION ALL SELECT '', size FROM p) GROUP BY folder"""
)
def a32_bytes_by_ancestor(spark: SparkSession, sf: str) -> DataFrame:
    """Sums are made by folder first, and only those are spread over the folders above."""
    t = A.tracks(spark, sf).groupBy("parent_path", "folder_path").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    above = F.explode(F.array(F.lit(""), F.col("parent_path"), F.concat("parent_path", F.lit("/"), "folder_path")))
    return t.select(above.alias("folder"), "size", "n").groupBy("folder").agg(F.sum("size").alias("bytes"), F.sum("n").alias("files"))


@query(f"WITH {TRACKS_SQL}, e AS (SELECT unnest([albumartist, artist]) AS a, album FROM v_tracks) SELECT lower(a) AS artist, count(DISTINCT album) AS albums, count(*) AS tracks FROM e WHERE a IS NOT NULL GROUP BY 1")
def a38_library_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Albums and tracks by artist, for first and second artists alike."""
    spread = A.tracks(spark, sf).select(F.explode(F.array("albumartist", "artist")).alias("a"), "album").filter("a IS NOT NULL")
    return spread.groupBy(F.lower("a").alias("artist")).agg(F.count_distinct("album").alias("albums"), F.count("*").alias("tracks"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), s AS (SELECT name, string_split(name, ' ')[-1] AS suffix, string_split(name, ' ')[1] AS prefix FROM n)
    SELECT 'suffix' AS kind, suffix AS word, count(*) AS members FROM s GROUP BY suffix HAVING count(*) >= 2 UNION ALL SELECT 'prefix', prefix, count(*) FROM s GROUP BY prefix HAVING count(*) >= 2"""
)
def a35_naming_patterns(spark: SparkSession, sf: str) -> DataFrame:
    names = read(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    ends = F.inline(F.array(F.struct(F.lit("suffix").alias("kind"), F.substring_index("name", " ", -1).alias("word")), F.struct(F.lit("prefix").alias("kind"), F.substring_index("name", " ", 1).alias("word"))))
    return names.select(ends).groupBy("kind", "word").agg(F.count("*").alias("members")).filter("members >= 2")


NOISE = (("url", r"https?://\S+"), ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"), ("copyright", r"\([cC]\)\s*\d{4}"), ("promo", r"[Ff]or\s+promotional\s+use\s+only"), ("shouting", r"[A-Z]{4,}!!"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS found, min(regexp_extract(text, '{p}', 0)) AS example FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) >= 3" for c, p in NOISE))
def a25_noise_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Noise hits by category with an example, three or more."""
    docs = read(spark, sf, "documents")
    hits = F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 0)).alias("hit")) for c, p in NOISE]))
    return docs.select(hits).filter("hit IS NOT NULL").groupBy("category").agg(F.count("*").alias("found"), F.min("hit").alias("example")).filter("found >= 3")


@query(
    f"""WITH {REVIEWS_SQL}, d AS (SELECT CAST(doc_id AS VARCHAR) AS proposal_id, length(text) AS n FROM documents), c AS (SELECT fix_type, verdict, count(*) AS k, avg(n) AS mean_length FROM v_reviews JOIN d USING (proposal_id) GROUP BY ALL) SELECT * FROM c"""
)
def a21_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("proposal_id"), F.length("text").alias("n"))
    return A.reviews(spark, sf).join(d, "proposal_id").groupBy("fix_type", "verdict").agg(F.count("*").alias("k"), F.avg("n").alias("mean_length"))


@query(f"WITH {HISTORY_SQL} SELECT * FROM (SELECT session_id, target_path, count(*) AS n, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, target_path) AS r FROM v_history GROUP BY session_id, target_path) WHERE r <= 2")
def o05_top_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The two most frequent targets of each session."""
    counts = A.history(spark, sf).groupBy("session_id", "target_path").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("n"), "target_path"))).filter("r <= 2")


@query("SELECT line, side FROM (SELECT DISTINCT p_name AS line, 'removed' AS side FROM part WHERE p_partkey % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 1) UNION ALL SELECT DISTINCT p_name, 'added' FROM part WHERE p_partkey % 2 = 1 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0))")
def u01_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of only one of two snapshots."""
    part = read(spark, sf, "part")
    old, new = (part.filter(f"p_partkey % 2 = {k}").select(F.col("p_name").alias("line")) for k in (0, 1))
    return old.subtract(new).withColumn("side", F.lit("removed")).unionByName(new.subtract(old).withColumn("side", F.lit("added")))


# File layouts


@query(
    f"""{ROUTE_SQL} SELECT folder_path, proposed_name, destination, round(confidence, 3) AS confidence, array_to_string(reasons, '|') AS reasons, CASE WHEN destination = 'clean' THEN 'yes' ELSE 'no' END AS accepted FROM routed"""
)
def s06_session_report(spark: SparkSession, sf: str) -> DataFrame:
    return files.session_report(_routed(spark, sf))


@query(
    f"""WITH {TRACKS_SQL}, p AS (SELECT DISTINCT parent_path || '/' || folder_path || '/' || isrc || ext AS path, parent_path, folder_path, ext FROM v_tracks)
    SELECT 'FILE' AS kind, 2 AS depth, ext, path FROM p UNION ALL SELECT DISTINCT 'DIR', 0, '', parent_path FROM p UNION ALL SELECT DISTINCT 'DIR', 1, '', parent_path || '/' || folder_path FROM p"""
)
def s10_tree_dump(spark: SparkSession, sf: str) -> DataFrame:
    return files.tree_dump(A.tracks(spark, sf).select(F.concat("parent_path", F.lit("/"), "folder_path", F.lit("/"), "isrc", "ext").alias("path")))


@query(f"WITH {TRACKS_SQL} SELECT * FROM {votes.plurality_sql('v_tracks', 'parent_path', 'genre', 'file_id')}")
def a03_parent_genre(spark: SparkSession, sf: str) -> DataFrame:
    return votes.plurality(A.tracks(spark, sf), ["parent_path"], "genre", "file_id")
