"""Registered queries of the smaller operators: filters, look-ups, registries, overviews."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import tags as G
from .functions import text as T
from .naming_queries import FOLDERS, STEMS
from .operators import classify, naming, proposals, runs
from .operators.order import PART, positions
from .operators.votes import plurality
from .queries import ROUTE_SQL, _routed, query
from .scanner_queries import _q
from .sources import adapters as A
from .sources import buckets
from .sources.adapters import HISTORY_SQL, TRACKS_SQL, read
from .sources.raw import RAW_SQL, pick, raw_files
from .tables import shared_folder

TREE_SQL = "tree AS (SELECT DISTINCT folder_path AS path, 'lib/' || parent_name AS parent, folder_name AS name FROM v_raw UNION SELECT DISTINCT 'lib/' || parent_name, 'lib', parent_name FROM v_raw UNION SELECT DISTINCT 'inbox/' || parent_name, 'inbox', parent_name FROM v_raw)"


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    f = raw_files(spark, sf)
    above = F.concat(F.lit("lib/"), "parent_name")
    rows = [f.select(F.col("folder_path").alias("path"), above.alias("parent"), F.col("folder_name").alias("name")), f.select(above.alias("path"), F.lit("lib").alias("parent"), F.col("parent_name").alias("name"))]
    rows.append(f.select(F.concat(F.lit("inbox/"), "parent_name").alias("path"), F.lit("inbox").alias("parent"), F.col("parent_name").alias("name")))
    return rows[0].union(rows[1]).union(rows[2]).distinct()


@query(f"WITH {RAW_SQL}, {TREE_SQL} SELECT path FROM tree WHERE path NOT IN (SELECT parent FROM tree) AND name NOT IN ('Ann Lee 0', 'Ann Lee 6', 'Ana Lopez 5')")
def p04_leaf_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf folders, without those named as category roots."""
    tree = _tree(spark, sf)
    leaves = tree.join(tree.select(F.col("parent").alias("path")).distinct(), "path", "left_anti")
    roots = F.array_union(F.array(F.lit("Ann Lee 0"), F.lit("Ann Lee 6")), F.array(F.lit("Ana Lopez 5"), F.lit("Ann Lee 0")))  # defaults and configured ones (U05)
    return leaves.filter(~F.array_contains(roots, F.col("name"))).select("path")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_clerk END, o_orderstatus) AS value FROM orders".replace("o_clerk", "o_orderpriority"))
def p10_first_present(spark: SparkSession, sf: str) -> DataFrame:
    """The first key of a list that a map of tags has (P10)."""
    key = F.col("o_orderkey")
    tags = F.map_filter(F.create_map(F.lit("TPE1"), F.when(key % 3 == 0, F.col("o_orderpriority")), F.lit("artist"), F.when(key % 2 == 0, F.col("o_orderpriority")), F.lit("author"), F.col("o_orderstatus")), lambda k, v: v.isNotNull())
    return read(spark, sf, "orders").select("o_orderkey", F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in ("TPE1", "artist", "author")]).alias("value"))


@query(f"WITH {HISTORY_SQL} SELECT action_id, target_path FROM v_history WHERE NOT (starts_with(target_path, 'out/view/') OR starts_with(target_path, 'out/purchase/'))")
def p18_outside_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Targets outside the allowed roots."""
    roots = F.array(F.lit("out/view/"), F.lit("out/purchase/"))
    return A.history(spark, sf).filter(~F.exists(roots, lambda r: F.col("target_path").startswith(r))).select("action_id", "target_path")


FOREIGN = ["/en/", ".org", "?", "#"]


@query(" UNION ALL ".join(f"SELECT {_q(p)} AS pattern, count(*) AS found FROM pages WHERE contains(lower(url), {_q(p)}) HAVING count(*) > 0" for p in FOREIGN))
def p19_foreign_files(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a listing by the patterns of other programs' files."""
    hits = F.explode(F.filter(F.array(*map(F.lit, FOREIGN)), lambda p: F.lower("url").contains(p))).alias("pattern")
    return read(spark, sf, "pages").select("url", hits).groupBy("pattern").agg(F.count("*").alias("found"))


@query(
    f"""WITH {TRACKS_SQL}, v AS (SELECT folder_path, album, count(*) AS n, min(file_id) AS f FROM v_tracks WHERE coalesce(album, '') <> '' GROUP BY ALL), w AS (SELECT folder_path, album, n * 1.0 / sum(n) OVER (PARTITION BY folder_path) AS share, row_number() OVER (PARTITION BY folder_path ORDER BY n DESC, f, album) AS r FROM v),
    o AS (SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS folder_path, o_orderkey % 20 = 0 AS skip, CASE WHEN o_orderkey % 15 = 0 THEN 'By hand' END AS album, CASE WHEN o_orderkey % 10 = 0 THEN 0.25 END AS boost FROM orders WHERE o_orderkey % 5 = 0)
    SELECT w.folder_path, coalesce(o.album, w.album) AS album, least(1.0, share + coalesce(boost, 0.0)) AS confidence FROM w LEFT JOIN o USING (folder_path) WHERE r = 1 AND NOT coalesce(skip, false)"""
)
def p25_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Folders' albums with what was set by hand: skipped, named, trusted more (P25)."""
    won = plurality(A.tracks(spark, sf), ["folder_path"], "album", "file_id")
    key = F.col("o_orderkey")
    by_hand = read(spark, sf, "orders").filter(key % 5 == 0).select(
        F.concat(F.lit("o"), key.cast("string")).alias("folder_path"), (key % 20 == 0).alias("skip"), F.when(key % 15 == 0, "By hand").alias("album"), F.when(key % 10 == 0, 0.25).alias("boost")
    )
    met = won.join(by_hand, "folder_path", "left").filter(~F.coalesce("skip", F.lit(False)))
    return met.select("folder_path", F.coalesce("album", "winner").alias("album"), F.least(F.lit(1.0), F.col("share") + F.coalesce("boost", F.lit(0.0))).alias("confidence"))


@query(
    f"""WITH {HISTORY_SQL}, s AS (SELECT session_id, max(timestamp) AS last_ts FROM v_history GROUP BY session_id ORDER BY last_ts DESC, session_id DESC LIMIT 10), l AS (SELECT target_path, arg_max(action_id, (timestamp, ord)) AS action_id, arg_max(confidence, (timestamp, ord)) AS confidence FROM v_history JOIN s USING (session_id) GROUP BY target_path),
    f AS (SELECT DISTINCT target_path FROM v_history WHERE destination = 'review') SELECT f.target_path, l.action_id, l.confidence FROM f LEFT JOIN l USING (target_path)"""
)
def j21_latest_proposal(spark: SparkSession, sf: str) -> DataFrame:
    """Folders under review with the latest proposal of their name in the ten newest sessions."""
    h = A.history(spark, sf)
    last = h.groupBy("session_id").agg(F.max("timestamp").alias("last_ts")).orderBy(F.desc("last_ts"), F.desc("session_id")).limit(10)
    newest = h.join(last, "session_id", "left_semi").groupBy("target_path").agg(F.max_by("action_id", F.struct("timestamp", "ord")).alias("action_id"), F.max_by("confidence", F.struct("timestamp", "ord")).alias("confidence"))
    return h.filter("destination = 'review'").select("target_path").distinct().join(newest, "target_path", "left")


@query(f"WITH {TRACKS_SQL} SELECT file_id FROM v_tracks a WHERE ext = '.m4a' AND EXISTS (SELECT 1 FROM v_tracks b WHERE b.parent_path = a.parent_path AND b.album = a.album AND b.ext <> '.m4a')")
def j22_paired_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets with audio of the same stem in the same folder."""
    t = A.tracks(spark, sf)
    return t.filter("ext = '.m4a'").join(t.filter("ext != '.m4a'").select("parent_path", "album").distinct(), ["parent_path", "album"], "left_semi").select("file_id")


@query(f"WITH {HISTORY_SQL}, s AS (SELECT *, ord % 50 AS slot FROM v_history WHERE destination = 'clean'), u AS (SELECT DISTINCT session_id, ord % 50 AS slot FROM v_history WHERE destination = 'duplicate') SELECT s.action_id, s.session_id, s.original_path FROM s ANTI JOIN u USING (session_id, slot)")
def j25_not_undone(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of a session that were written and not undone."""
    h = A.history(spark, sf).withColumn("slot", F.col("ord") % 50)
    return h.filter("destination = 'clean'").join(h.filter("destination = 'duplicate'").select("session_id", "slot").distinct(), ["session_id", "slot"], "left_anti").select("action_id", "session_id", "original_path")


@query(f"WITH {HISTORY_SQL}, n AS (SELECT max(timestamp) AS newest FROM v_history) SELECT destination AS area, count(DISTINCT target_path) AS folders, count(*) AS tracks, count_if(confidence < 0.5) AS pending, count_if(timestamp > newest - INTERVAL 1 DAY) AS new_since FROM v_history, n GROUP BY destination")
def a30_area_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Folders and tracks by area, what is pending and what is new."""
    h = A.history(spark, sf)
    newest = h.agg(F.max("timestamp")).scalar()
    return h.groupBy(F.col("destination").alias("area")).agg(
        F.count_distinct("target_path").alias("folders"), F.count("*").alias("tracks"), F.count(F.when(F.col("confidence") < 0.5, 1)).alias("pending"), F.count(F.when(F.col("timestamp") > newest - F.expr("INTERVAL 1 DAY"), 1)).alias("new_since")
    )


DATABASES = ["/view/1", "purchase/3", "_Serato_", "click/4"]


@query(
    f"""WITH {HISTORY_SQL}, d AS (SELECT original_path, target_path, destination FROM v_history) SELECT 'area' AS section, destination AS name, count(DISTINCT target_path) AS folders, count(*) AS n FROM d GROUP BY destination
    UNION ALL SELECT 'manifest', 'accepted', count(DISTINCT target_path), count(*) FROM d WHERE destination = 'clean' """
    + " ".join(f"UNION ALL SELECT 'database', {_q(p)}, count(DISTINCT target_path), count(*) FROM d WHERE contains(target_path, {_q(p)}) HAVING count(*) > 0" for p in DATABASES)
)
def c35_status(spark: SparkSession, sf: str) -> DataFrame:
    """The areas, what is accepted, and the databases of other programs among the files, in one pass."""
    d = A.history(spark, sf).select("target_path", "destination")
    row = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    found = [F.when(F.col("target_path").contains(p), row("database", F.lit(p))) for p in DATABASES]
    said = F.array_compact(F.array(row("area", F.col("destination")), F.when(F.col("destination") == "clean", row("manifest", F.lit("accepted"))), *found))
    return d.select("target_path", F.inline(said)).groupBy("section", "name").agg(F.count_distinct("target_path").alias("folders"), F.count("*").alias("n"))


COVER = {"genre-bpm-key": ["genre", "bpm", "key"], "label": ["label"], "dated": ["year"]}


@query(f"WITH {RAW_SQL}, f AS (SELECT folder_path, " + ", ".join(f"max(nullif({t}, '')) AS {t}" for t in ("genre", "bpm", "key", "label", "year")) + " FROM v_raw GROUP BY folder_path) " + " UNION ALL ".join(f"SELECT '{name}' AS template, '{t}' AS token, avg(CASE WHEN {t} IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM f" for name, ts in COVER.items() for t in ts))
def a36_template_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of folders that have what each template needs."""
    tokens = ("genre", "bpm", "key", "label", "year")
    folders = raw_files(spark, sf).groupBy("folder_path").agg(*[F.max(F.nullif(F.col(t), F.lit(""))).alias(t) for t in tokens])
    shares = folders.agg(*[F.avg(F.col(t).isNotNull().cast("double")).alias(t) for t in tokens])
    rows = [F.struct(F.lit(name).alias("template"), F.lit(t).alias("token"), F.col(t).alias("coverage")) for name in COVER for t in ("genre", "bpm", "key", "label", "year") if t in naming.TEMPLATES[name].replace("bpm_range", "bpm").replace("camelot_key", "key")]
    return shares.select(F.inline(F.array(*rows)))


@query(f"WITH {RAW_SQL}, p AS (SELECT folder_path || '/' || filename AS path FROM v_raw), d AS (SELECT DISTINCT folder_path AS path FROM v_raw UNION SELECT DISTINCT 'lib/' || parent_name FROM v_raw UNION SELECT 'lib') SELECT 'files' AS kind, count(DISTINCT path) AS n FROM p UNION ALL SELECT 'folders', count(*) FROM d")
def a41_tree_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files and folders of a tree."""
    f = raw_files(spark, sf)
    path = f.select(F.concat_ws("/", "folder_path", "filename").alias("path")).distinct().agg(F.lit("files").alias("kind"), F.count("*").alias("n"))
    above = f.select(F.explode(F.array(F.col("folder_path"), F.concat(F.lit("lib/"), "parent_name"), F.lit("lib"))).alias("path")).distinct()
    return path.unionByName(above.agg(F.lit("folders").alias("kind"), F.count("*").alias("n")))


@query(f"{ROUTE_SQL} SELECT folder_path, proposed_name, round(confidence, 3) AS confidence, len(reasons) AS n_reasons, coalesce(reasons[1], '-') AS first_reason, destination FROM routed")
def s05_nested_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Nested proposals written as JSON and read again by their schema."""
    schema = "folder_path string, proposed_name string, decision struct<confidence: double, reasons: array<string>, destination: string>"
    nested = _routed(spark, sf).select(F.struct("folder_path", "proposed_name", F.struct("confidence", "reasons", "destination").alias("decision")).alias("p"))
    again = nested.select(F.from_json(F.to_json("p"), schema).alias("p"))
    return again.select("p.folder_path", "p.proposed_name", F.round("p.decision.confidence", 3).alias("confidence"), F.size("p.decision.reasons").cast("long").alias("n_reasons"), F.coalesce(F.get("p.decision.reasons", F.lit(0)), F.lit("-")).alias("first_reason"), "p.decision.destination")


UPSERT_SQL = "WITH {h}, e AS (SELECT *, ord % 2 AS new FROM v_history), r AS (SELECT {key}, confidence, timestamp, row_number() OVER (PARTITION BY {key} ORDER BY timestamp DESC, new DESC, ord DESC) AS r FROM e) SELECT {key}, confidence, timestamp FROM r WHERE r = 1"


@query(UPSERT_SQL.format(h=HISTORY_SQL, key="target_path"))
def s12_manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest after changes: the newest entry of each name."""
    h = A.history(spark, sf).withColumn("stamp", F.struct("timestamp", F.col("ord") % 2, "ord"))
    return runs.upsert(h.filter("ord % 2 = 0"), h.filter("ord % 2 = 1"), ["target_path"], "stamp").select("target_path", "confidence", "timestamp")


@query("WITH {h}, r AS (SELECT target_path, confidence, timestamp, ord, row_number() OVER (PARTITION BY target_path ORDER BY timestamp DESC, ord DESC) AS r FROM v_history) SELECT target_path, confidence, timestamp, ord FROM r WHERE r = 1".format(h=HISTORY_SQL))
def s12_bucketed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest kept in hash buckets, after two upserts that rewrote only the buckets they touched."""
    h = A.history(spark, sf).select("target_path", "confidence", "timestamp", "ord")
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    order = [F.desc("timestamp"), F.desc("ord")]
    buckets.write(runs.latest(h.filter("ord % 3 = 0"), ["target_path"], order), path, ["target_path"], 16)
    for k in (1, 2):
        buckets.upsert(h.filter(f"ord % 3 = {k}"), path, ["target_path"], order, 16)
    return buckets.read(spark, path)


@query(UPSERT_SQL.format(h=HISTORY_SQL, key="session_id, destination"))
def s13_rules_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rules merged on two keys, the newest of each stays."""
    h = A.history(spark, sf).withColumn("stamp", F.struct("timestamp", F.col("ord") % 2, "ord"))
    return runs.upsert(h.filter("ord % 2 = 0"), h.filter("ord % 2 = 1"), ["session_id", "destination"], "stamp").select("session_id", "destination", "confidence", "timestamp")


@query(
    f"""{ROUTE_SQL}, c AS (SELECT r.*, dominance, title_quality, completeness FROM routed r JOIN confident USING (folder_path)), w AS (SELECT *, list_filter([CASE WHEN dominance < 0.5 THEN 'dominance ' || CAST(CAST(round(dominance * 100) AS INT) AS VARCHAR) || '%' END, CASE WHEN title_quality < 0.5 THEN 'title_quality ' || CAST(CAST(round(title_quality * 100) AS INT) AS VARCHAR) || '%' END,
      CASE WHEN completeness < 0.5 THEN 'completeness ' || CAST(CAST(round(completeness * 100) AS INT) AS VARCHAR) || '%' END], lambda x: x IS NOT NULL) AS weak FROM c)
    SELECT folder_path, round(dominance, 3) AS dominance, round(completeness, 3) AS completeness, array_to_string(list_transform(reasons, lambda r: replace(string_split(r, ':')[1], '_', ' ')), ', ') || CASE WHEN len(weak) > 0 THEN '; weak: ' || array_to_string(weak, ', ') ELSE '' END || '; confidence ' || CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR) || '%' AS summary FROM w"""
)
def s15_review_rationale(spark: SparkSession, sf: str) -> DataFrame:
    """Why a folder is where it is, in words."""
    from .queries import _confidence

    factors = _confidence(spark, sf).select("folder_path", "dominance", "title_quality", "completeness")
    d = _routed(spark, sf).join(factors, "folder_path")
    told = naming.review_summary(F.col("reasons"), {c: F.col(c) for c in ("dominance", "title_quality", "completeness")}, F.col("confidence"))
    return d.select("folder_path", F.round("dominance", 3).alias("dominance"), F.round("completeness", 3).alias("completeness"), told.alias("summary"))


@query(f"WITH {HISTORY_SQL} SELECT session_id AS scan_id, min(timestamp) AS started, max(timestamp) AS finished, count(*) AS files, count(DISTINCT target_path) AS folders, string_split(session_id, '-')[1] AS label, CASE WHEN count_if(destination = 'duplicate') > 0 THEN 'partial' ELSE 'done' END AS status FROM v_history GROUP BY session_id")
def s16_scan_registry(spark: SparkSession, sf: str) -> DataFrame:
    """One row per scan: start, finish, counts, label, status."""
    bad = F.count(F.when(F.col("destination") == "duplicate", 1)) > 0
    return A.history(spark, sf).groupBy(F.col("session_id").alias("scan_id")).agg(
        F.min("timestamp").alias("started"), F.max("timestamp").alias("finished"), F.count("*").alias("files"), F.count_distinct("target_path").alias("folders"), F.min(F.substring_index("session_id", "-", 1)).alias("label"), F.when(bad, "partial").otherwise("done").alias("status")
    )


@query(
    f"""WITH {RAW_SQL}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY file_id) AS r FROM v_raw) WHERE r <= 20), f AS (SELECT folder_path, folder_name, least(1.0, (count(DISTINCT lower(trim(album))) FILTER (coalesce(lower(trim(album)), '') NOT IN ('', 'unknown', 'unknown album', 'untitled')) + count_if(coalesce(lower(trim(album)), '') IN ('', 'unknown', 'unknown album', 'untitled'))) * 1.0 / count(*)) AS diversity FROM s GROUP BY ALL),
    c AS (SELECT folder_name, diversity FROM f WHERE diversity >= 0.5), w AS (SELECT folder_name, unnest([{{'sep': ' - ', 'kind': 'prefix', 'word': string_split(folder_name, ' - ')[1]}}, {{'sep': ' - ', 'kind': 'suffix', 'word': string_split(folder_name, ' - ')[-1]}}, {{'sep': ' ', 'kind': 'prefix', 'word': string_split(folder_name, ' ')[1]}}, {{'sep': ' ', 'kind': 'suffix', 'word': string_split(folder_name, ' ')[-1]}}, {{'sep': '_', 'kind': 'prefix', 'word': string_split(folder_name, '_')[1]}}, {{'sep': '_', 'kind': 'suffix', 'word': string_split(folder_name, '_')[-1]}}]) AS u FROM c)
    SELECT u.sep AS sep, u.kind AS kind, lower(u.word) AS word, count(DISTINCT folder_name) AS members, max(CASE WHEN regexp_matches(folder_name, {_q(proposals.SET_NAME)}) THEN 1 ELSE 0 END) = 1 AS any_set FROM w WHERE contains(folder_name, u.sep) GROUP BY ALL HAVING count(DISTINCT folder_name) >= 2"""
)
def c23_crate_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What the names of crates have in common, from twenty files of each folder at most."""
    files = raw_files(spark, sf).withColumn("tracknumber", F.col("track_number"))
    first = Window.partitionBy("folder_path").orderBy("file_id")
    some = files.withColumn("r", F.row_number().over(first)).filter("r <= 20")
    crates = classify.crate_facts(some, ["folder_path", "folder_name"]).filter("album_diversity >= 0.5")
    name = F.col("folder_name")
    ends = [F.struct(F.lit(s).alias("sep"), F.lit(k).alias("kind"), F.lower(F.substring_index(name, s, 1 if k == "prefix" else -1)).alias("word")) for s in (" - ", " ", "_") for k in ("prefix", "suffix")]
    spread = crates.select("folder_name", F.inline(F.array(*ends))).filter(F.contains("folder_name", "sep"))
    return spread.groupBy("sep", "kind", "word").agg(F.count_distinct("folder_name").alias("members"), F.bool_or(name.rlike(proposals.SET_NAME)).alias("any_set")).filter("members >= 2")


@query(f"WITH {TRACKS_SQL}, r AS (SELECT quantile_disc(mtime, 0.5) AS last_run FROM v_tracks) SELECT file_id, folder_path FROM v_tracks, r WHERE mtime > last_run".replace("quantile_disc(mtime, 0.5)", "max(mtime) - 365"))
def x04_since_last_run(spark: SparkSession, sf: str) -> DataFrame:
    """Files changed since the last successful run."""
    t = A.tracks(spark, sf)
    last_run = t.agg(F.date_sub(F.max("mtime"), 365)).scalar()
    return t.filter(F.col("mtime") > last_run).select("file_id", "folder_path")


NUMBERS = ["3/12", "A2", "b12", "07", "0", "x", "213", "12", None, "D1/8"]


@query(
    rf"""WITH x AS (SELECT p_partkey, {pick(NUMBERS, 'p_partkey')} AS t, {pick(STEMS, 'p_partkey')} AS stem, {pick(FOLDERS, 'p_partkey')} AS name FROM part)
    SELECT p_partkey, try_cast(regexp_extract(t, '^\s*(\d{{1,9}})', 1) AS INT) AS number, CASE WHEN regexp_matches(t, '^[A-Da-d]\d{{1,2}}$') THEN (ascii(upper(t[1])) - 65) * 8 + CAST(t[2:] AS INT) END AS vinyl, CASE WHEN try_cast(regexp_extract(t, '^\s*\d+\s*/\s*(\d+)', 1) AS INT) <> 0 THEN try_cast(regexp_extract(t, '^\s*\d+\s*/\s*(\d+)', 1) AS INT) END AS total,
      nullif(regexp_extract(stem, '^(\d)-\d{{2}}\s', 1), '') AS disc, try_cast(nullif(regexp_extract(name, '\d{{4}}', 0), '') AS INT) AS year, coalesce(try_cast(regexp_extract(name, '\d{{4}}', 0) AS INT) BETWEEN 1900 AND 2100, false) AS plausible, regexp_matches(name, '(?i)\bEP\b') AS is_ep, regexp_matches(name, {_q(classify.MIX_NAME)}) AS is_mix FROM x"""
)
def f35_numbers_and_names(spark: SparkSession, sf: str) -> DataFrame:
    """Track numbers in all notations, years, EP and mix names."""
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(NUMBERS, 'p_partkey')} AS t", f"{pick(STEMS, 'p_partkey')} AS stem", f"{pick(FOLDERS, 'p_partkey')} AS name")
    t, name = F.col("t"), F.col("name")
    year = F.regexp_extract(name, r"\d{4}", 0).try_cast("int")
    return d.select(
        "p_partkey", F.when(t.isNotNull(), T.int_prefix(t)).alias("number"), F.when(t.isNotNull(), T.vinyl_number(t)).alias("vinyl"), F.when(t.isNotNull(), T.track_total(t)).alias("total"), F.nullif(F.regexp_extract("stem", r"^(\d)-\d{2}\s", 1), F.lit("")).alias("disc"),
        year.alias("year"), F.coalesce(year.between(1900, 2100), F.lit(False)).alias("plausible"), name.rlike(classify.EP_NAME).alias("is_ep"), name.rlike(classify.MIX_NAME).alias("is_mix"),
    )


@query(
    f"""WITH {RAW_SQL}, v AS (SELECT DISTINCT artist FROM v_raw WHERE artist IS NOT NULL), r AS (SELECT artist, {"replace(" * len(G.MISREAD)}artist{"".join(f", {_q(a)}, {_q(b)})" for a, b in G.MISREAD.items())} AS text FROM v)
    SELECT artist, text <> artist AS misread, regexp_matches(artist, '[ÃÂ][\\x{{80}}-\\x{{ff}}]') AS looks_misread, CASE WHEN text <> artist THEN text END AS repaired FROM r"""
)
def f13_repaired_names(spark: SparkSession, sf: str) -> DataFrame:
    """Misencoded names told and put right."""
    values = raw_files(spark, sf).select("artist").distinct().filter("artist IS NOT NULL")
    fixed = G.repaired(F.col("artist"))["text"]
    return values.select("artist", fixed.isNotNull().alias("misread"), F.col("artist").rlike("[ÃÂ][\\x80-\\xff]").alias("looks_misread"), fixed.alias("repaired"))


@query(f"WITH n AS (SELECT n_name AS k, r_name AS v FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT lower(n_name) AS k, n_name || ' (mine)' AS v FROM nation WHERE n_nationkey % 5 = 0), c AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, coalesce(m.v, n.v, c.n_name) AS name FROM c LEFT JOIN m ON lower(c.n_name) = m.k LEFT JOIN n ON lower(c.n_name) = lower(n.k)")
def s09_dictionaries(spark: SparkSession, sf: str) -> DataFrame:
    """Look-up in two dictionaries, the own one first."""
    nation, region, customer = (read(spark, sf, t) for t in ("nation", "region", "customer"))
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("k"), F.col("r_name").alias("reference"))
    mine = nation.filter("n_nationkey % 5 = 0").select(F.lower("n_name").alias("k"), F.concat("n_name", F.lit(" (mine)")).alias("own"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.lower("n_name").alias("k"))
    return named.join(mine, "k", "left").join(both, "k", "left").select("c_custkey", F.coalesce("own", "reference", "n_name").alias("name"))


@query(f"{ROUTE_SQL} SELECT folder_path, proposed_name, destination, row_number() OVER (ORDER BY folder_path) AS place FROM routed")
def o01_first_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """All proposals with their places in the canonical order."""
    return positions(_routed(spark, sf).select("folder_path", "proposed_name", "destination"), ["folder_path"]).drop(PART)
