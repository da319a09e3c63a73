"""Registered queries of names: artists, albums, titles, files and folders cleaned and taken apart, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .operators import alike, naming
from .queries import query
from .scanner_queries import _q
from .sources.adapters import read
from .sources.raw import pick

FOLDERS = [
    "Ann Lee - Night Drive (1999)", "ANN LEE - NIGHT DRIVE", "ann lee - night drive", "va - summer hits [2004] [FLAC]", "Best New Hype Techno_ March 2021", "Artist--Album_Name", "!!!Loud Band!!! - Live!!", "ABC123D Artist - Album",
    "[CAT-001] Artist - Album", "Artist - Album (self-released)", "Great Mashup Album", "Artist Discography (320kbps)", "Artist - 1994. Album", "Artist_-_Album-WEB-2023-GRP", "Artist ~ Album", "Artist - Album {note}", "Artist - Album [warp 12]",
    "Artist - Album [box set]", "Artist - Album (FLAC) [24Bit 96]", "1999 - Album (1999)", "Artist - (2001) Album", "Artist [1988] - Album", "Deep Records - 2003 - Artist - Album", "Artist%20Name - Album+One", "Сlub Artist - Album", "Album CD1",
    "Artist - Album (Deluxe Edition)", "Chart_ 2020-07", "._Hidden", "Artist - Album -", "Album1999", "Beatport.Top.Tracks", "2004 - Artist - Album [2004]", "The Ox & Fox - Harvest EP", "Artist - Album cd 320kbps abc", "Artist - Album (AB123)", "plain name",
]
FIRST = ["Ann Lee", "ANN LEE", "ann lee", "The Ox & Fox", "Fox and The Ox", "Lee, Ann & Bo", "jay z", "DJ QUICK OF THE HILL", "a b", "Some–One", "One × Two", "the band of joy", "Élan vital", "", "one two three four five six seven eight nine ten eleven twelve thirteen"]
SECOND = ["ann lee", "Ann Lee", "Bo", "Ox + Fox", "The Ox & Fox", "Bo, Lee & Ann", "Jay-Z", "dj quick of the hill", "A B", "Some-One", "Two & One", "Band of Joy", "élan vital", "x", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]
ALBUMS = [
    "Night Drive [Official Video]", "Night Drive (lyrics)", "Night Drive - CD 2", "Night Drive (Disc 1)", "Night Drive [cd3]", "Night Drive [hd] (320) [free download]", "Deep Records", "unknown album", "  ", "Night Drive EP", "Night Drive [E.P.]", "Night Drive LP!", "www.site.com", "F#m",
    "Night Drive www.some.site.com", "Night Drive (some.site.net)", "Night Drive (1999)", "Night Drive (Club Mix)", "Night Drive [remastered]", "a: b/c? *", "CON", "con.txt", "Bright Music Ltd", "Harvest 1999 Moon",
]
TITLES = [
    "some_title_here", "Song (Official Video)", "Song (Live Version)", "Song - free download", "Song @handle", "Song_1234567890", "Song (Club Mix)", "Song - Dub Version", "Song - Radio, Edit", "song (hd) - audio", "Song www.my.site.com", "Song . ", "Song -", "Song (feat. Bo) (Remix)",
]
STEMS = [
    "01 - Ann Lee - Song", "1-02 Ann Lee - Song", "A1 - Ann Lee - Song", "Song - Ann, Bo (Club Mix)", " Song - Ann", "128 bpm Song", "124 - Am - Song", "Ann_-_Song_Two", "[promo] 03. Ann - Song", "Ann - Song - xyz", "Song", "07 Song", "Ann-Song", "8A - Song - x", "12 Ann - Ann - Song", "(x) 3a Ann - Song", "B2 Ann - - Song",
]
WORDS = ["Beyoncé", "café crème", "Motörhead", "plain", "São Paulo", "naïve", "Ångström"]


def fold_sql(x: str, patterns: list[str], by: str = "") -> str:
    return reduce(lambda text, p: f"trim(regexp_replace({text}, {_q(p)}, '{by}', 'g'))", patterns, x)


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


EDGE = "[^\\p{L}\\p{N}_]"


def title_sql(x: str) -> str:
    ws = words_sql(x)
    lettered = f"list_filter({ws}, lambda w: regexp_matches(w, '\\p{{L}}'))"
    core = f"regexp_replace(w, '^{EDGE}+|{EDGE}+$', '', 'g')"
    caps = f"list_transform({ws}, lambda w, i: CASE WHEN i = 1 OR NOT list_contains({_list(N.SMALL)}, lower(w)) THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END)"
    shown = f"CASE WHEN list_contains({_list(N.ALWAYS_UPPER)}, {core}) THEN upper({core}) WHEN i = 1 OR i = len({ws}) OR NOT list_contains({_list(N.SMALL_IN_LOWER)}, {core}) THEN upper(({core})[1]) || ({core})[2:] ELSE {core} END"
    small = f"list_transform({ws}, lambda w, i: CASE WHEN {core} = '' THEN w ELSE regexp_extract(w, '^{EDGE}*', 0) || {shown} || regexp_extract(w, '{EDGE}*$', 0) END)"
    return f"""CASE WHEN len({lettered}) = 0 THEN {x} WHEN len(list_filter({lettered}, lambda w: length(w) > 1 AND NOT (w = upper(w) AND w <> lower(w)))) = 0 THEN array_to_string({caps}, ' ')
      WHEN len(list_filter({lettered}, lambda w: NOT (w = lower(w) AND w <> upper(w)))) = 0 THEN array_to_string({small}, ' ') ELSE {x} END"""


CONNECT = r"(?i)\s*[&+×]\s*|\s+(?:and|vs\.?|versus|feat\.?|featuring|ft\.?)\s+"
LOW = lambda x: f"regexp_replace(trim(regexp_replace(lower(trim({x})), {_q(CONNECT)}, ' & ', 'g')), '^the\\s+', '')"
KEY = lambda x: f"list_sort(list_filter(list_transform(regexp_split_to_array({LOW(x)}, '\\s*[,&]\\s*'), lambda p: trim(p)), lambda p: p <> ''))"


def display_sql(x: str) -> str:
    ws = words_sql(f"trim({x})")
    small = _list(N.SMALL_IN_NAMES)
    caps = f"CASE WHEN len(list_filter({ws}, lambda w: length(w) > 2 AND NOT (w = upper(w) AND w <> lower(w)))) = 0 THEN array_to_string(list_transform({ws}, lambda w, i: CASE WHEN i = 1 OR NOT list_contains({small}, lower(w)) THEN upper(w[1]) || lower(w[2:]) ELSE lower(w) END), ' ') ELSE trim({x}) END"
    return f"(SELECT regexp_replace(regexp_replace(trim(regexp_replace({title_sql('y')}, {_q(CONNECT)}, ' & ', 'g')), '\\s*&\\s*', ' & ', 'g'), '[–—‐−]', '-', 'g') FROM (SELECT {caps} AS y))"


def same_sql(a: str, b: str) -> str:
    """Whether two names are one artist's."""
    x, y = (f"list_distinct({words_sql(LOW(c))})" for c in (a, b))
    return f"({LOW(a)} = {LOW(b)} OR {KEY(a)} = {KEY(b)} OR (len({x}) > 0 AND len({y}) > 0 AND len(list_intersect({x}, {y})) >= 0.92 * len(list_distinct(list_concat({x}, {y})))))"


@query(
    f"""WITH n AS (SELECT doc_id, array_to_string(string_split_regex(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')[1:14], ' ') || CASE doc_id % 4 WHEN 0 THEN ' & The Ox' WHEN 1 THEN ' and the ox' ELSE '' END AS name FROM documents),
    w AS (SELECT doc_id, name, {LOW('name')} AS low, {KEY('name')} AS parts, list_distinct({words_sql(LOW('name'))}) AS ws FROM n), a AS (SELECT DISTINCT name, low, parts, ws FROM w WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT name, low, parts, ws FROM w WHERE doc_id % 2 = 1)
    SELECT a.name AS a, b.name AS b FROM a JOIN b ON a.low = b.low OR a.parts = b.parts OR (len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) >= 0.92 * len(list_distinct(list_concat(a.ws, b.ws))))"""
)
def j15_same_artists(spark: SparkSession, sf: str) -> DataFrame:
    """Names of two catalogs that are one artist's, joined by keys and by rare words."""
    plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    tail = F.when(F.col("doc_id") % 4 == 0, " & The Ox").when(F.col("doc_id") % 4 == 1, " and the ox").otherwise("")
    names = read(spark, sf, "documents").select("doc_id", F.concat(F.array_join(F.slice(F.split(plain, " "), 1, 14), " "), tail).alias("name"))
    return alike.same_artists(names.filter("doc_id % 2 = 0"), names.filter("doc_id % 2 = 1"))


MARKED = ["Be\u0301la & Co", "sigur ro\u0301s", "AMADOU ET MARIAM", "the Bjo\u0308rks", "\u1e69 \u01ed"]


@query(f"WITH n AS (SELECT s_suppkey, nfc_normalize({pick(MARKED, 's_suppkey')}) AS a FROM supplier), m AS (SELECT s_suppkey, replace(replace(a, 'ö', 'oe'), 'MARIAM', 'Mariama') AS a FROM n) SELECT s_suppkey, {display_sql('a')} AS display FROM m")
def f04_composed_names(spark: SparkSession, sf: str) -> DataFrame:
    """Display forms of names with marks apart from their letters, and with letters of the user's."""
    d = read(spark, sf, "supplier").selectExpr("s_suppkey", f"{pick(MARKED, 's_suppkey')} AS a")
    return d.select("s_suppkey", N.artist_display(F.col("a"), letters={"ö": "oe", "MARIAM": "Mariama"}).alias("display"))


@query(
    f"""WITH n AS (SELECT s_suppkey, {pick(FIRST, 's_suppkey')} AS a, {pick(SECOND, 's_suppkey')} AS b, {pick(SECOND, 's_suppkey + 1')} AS c FROM supplier),
    al AS (SELECT * FROM (VALUES ('jay z', 'Jay-Z')) v(alias, canonical)),
    w AS (SELECT *, list_distinct({words_sql(LOW('a'))}) AS wa, list_distinct({words_sql(LOW('b'))}) AS wb, list_distinct({words_sql(LOW('c'))}) AS wc FROM n)
    SELECT s_suppkey, {title_sql('a')} AS title_case, CASE WHEN a = '' THEN a ELSE coalesce(canonical, {display_sql('a')}) END AS display, array_to_string({KEY('a')}, '|') AS key,
      {LOW('a')} = {LOW('b')} OR {KEY('a')} = {KEY('b')} OR (len(wa) > 0 AND len(wb) > 0 AND len(list_intersect(wa, wb)) >= 0.92 * len(list_distinct(list_concat(wa, wb)))) AS same_b,
      {LOW('a')} = {LOW('c')} OR {KEY('a')} = {KEY('c')} OR (len(wa) > 0 AND len(wc) > 0 AND len(list_intersect(wa, wc)) >= 0.92 * len(list_distinct(list_concat(wa, wc)))) AS same_c
    FROM w LEFT JOIN al ON lower(a) = alias"""
)
def f04_artist_names(spark: SparkSession, sf: str) -> DataFrame:
    """Display forms of artists, and which names are one artist's."""
    d = read(spark, sf, "supplier").selectExpr("s_suppkey", f"{pick(FIRST, 's_suppkey')} AS a", f"{pick(SECOND, 's_suppkey')} AS b", f"{pick(SECOND, 's_suppkey + 1')} AS c")
    a, alias = F.col("a"), F.when(F.lower("a") == "jay z", "Jay-Z")
    return d.select(
        "s_suppkey", N.title_case(a).alias("title_case"), N.artist_display(a, alias).alias("display"), F.array_join(N.artist_key(a), "|").alias("key"), N.same_artist(a, F.col("b")).alias("same_b"), N.same_artist(a, F.col("c")).alias("same_c")
    )


def bracket_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(trim({x}), {_q(p)}) THEN '{k}'" for k, p in N.BRACKET_KINDS) + " ELSE 'unknown' END"


def brackets_sql(x: str) -> str:
    inner = f"regexp_extract(t, {_q(N.LAST_BRACKET)}, 1)"
    return f"list_reduce(list_prepend(trim({x}), ['', '', '', '', '', '', '', '']), lambda t, k: CASE WHEN regexp_matches(t, {_q(N.LAST_BRACKET)}) AND ({bracket_sql(inner)}) IN ('noise', 'promo', 'format') THEN trim(regexp_replace(t, {_q(N.LAST_BRACKET)}, '')) ELSE t END)"


def safe_sql(x: str) -> str:
    return f"""trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({x}, '[/\\\\]', ' ', 'g'), '[:*?"<>|]', ' - ', 'g'), '\\s+', ' ', 'g')), '[. ]+$', ''))"""


@query(
    rf"""WITH n AS (SELECT p_partkey, {pick(ALBUMS, 'p_partkey')} AS a FROM part)
    SELECT p_partkey, {fold_sql(fold_sql('a', N.DISPLAY_NOISE), N.DISC)} AS plain, {bracket_sql(f"regexp_extract(a, {_q(N.LAST_BRACKET)}, 1)")} AS kind, {brackets_sql('a')} AS unbracketed, {fold_sql('trim(a)', N.TRAILING_DOMAINS)} AS without_domain,
      regexp_matches(a, {_q(N.LABEL_LIKE)}) AS label_like, lower(trim(a)) IN ('', 'unknown album', 'untitled') AS unknown, trim(regexp_replace(regexp_replace({fold_sql('lower(trim(a))', N.CLUSTER_TAILS)}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS cluster_key,
      regexp_matches(trim(a), {_q(N.GARBAGE_URL)}) OR (list_contains({_list(N.KEY_NAMES)}, lower(trim(a))) AND length(trim(a)) <= 4) AS garbage, {safe_sql('a')} AS safe,
      CASE WHEN list_contains({_list(N.RESERVED)}, upper(regexp_replace(a, '^(.+)\.[^.]+$', '\1'))) THEN a || '_' ELSE a END AS unreserved, {fold_sql('trim(a)', [N.LABEL_TAIL] * 3)} AS label,
      substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(a)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) AS slug FROM n"""
)
def f07_album_names(spark: SparkSession, sf: str) -> DataFrame:
    """Albums without noise, brackets, domains; keys and safe forms."""
    a = F.col("a")
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(ALBUMS, 'p_partkey')} AS a")
    return d.select(
        "p_partkey", N.fold(a, [*N.DISPLAY_NOISE, *N.DISC]).alias("plain"), N.bracket_kind(F.regexp_extract(a, N.LAST_BRACKET, 1)).alias("kind"), N.without_brackets(a).alias("unbracketed"), N.fold(N.strip(a), N.TRAILING_DOMAINS).alias("without_domain"),
        a.rlike(N.LABEL_LIKE).alias("label_like"), N.unknown_album(a).alias("unknown"), N.cluster_key(a).alias("cluster_key"), N.garbage(a).alias("garbage"), N.safe_name(a).alias("safe"), N.unreserved(a).alias("unreserved"),
        N.label_name(a).alias("label"), N.slug(a).alias("slug"),
    )


def clean_title_sql(x: str) -> str:
    phrases, keep = _q("(?i)" + "|".join(N.TRAILING_PHRASES)), _q("(?i)" + "|".join(N.PROTECTED))
    start = f"trim(regexp_replace(regexp_replace({fold_sql(f'''replace(trim({x}), '_', ' ')''', N.TRAILING_DOMAINS)}, '(\\s*[-–—]\\s*)?@[\\w.-]+\\s*$', ''), {_q(N.LONG_ID)}, ''))"
    cases = ""
    for p in (r"\s*[\(\[]([^)\]]+)[\)\]]\s*$", r"\s*[-–—]\s*([^-–—]+)\s*$"):
        inner = f"regexp_extract(t, {_q(p)}, 1)"
        cases += f" WHEN {inner} <> '' AND regexp_matches({inner}, {phrases}) AND NOT regexp_matches({inner}, {keep}) THEN trim(regexp_replace(t, {_q(p)}, ''))"
    looped = f"list_reduce(list_prepend({start}, ['', '', '', '', '', '']), lambda t, k: CASE{cases} ELSE t END)"
    end = f"regexp_replace(trim(regexp_replace(trim(regexp_replace({looped}, '\\s+', ' ', 'g')), '[. ]+$', '')), '\\s*[-–—]+\\s*$', '')"
    lettered = f"list_filter({words_sql('z')}, lambda w: regexp_matches(w, '\\p{{L}}'))"
    return f"(SELECT CASE WHEN len({lettered}) > 0 AND len(list_filter({lettered}, lambda w: NOT (w = lower(w) AND w <> upper(w)))) = 0 THEN {title_sql('trim(z)')} ELSE trim(z) END FROM (SELECT {end} AS z))"


MIXES = _q("(?i)" + "|".join(N.MIX_WORDS))
BRACKET_MIX, DASH_MIX = r"\s*(\(([^)]+)\))\s*$", r"\s*[-–—]\s*([^-–—]+)\s*$"


@query(
    f"""WITH n AS (SELECT p_partkey, {pick(TITLES, 'p_partkey')} AS t FROM part), m AS (SELECT *, regexp_extract(t, {_q(BRACKET_MIX)}, 2) AS b, trim(regexp_extract(t, {_q(DASH_MIX)}, 1)) AS d FROM n)
    SELECT p_partkey, {clean_title_sql('t')} AS clean, CASE WHEN b <> '' AND regexp_matches(b, {MIXES}) THEN trim(regexp_replace(t, {_q(BRACKET_MIX)}, '')) WHEN d <> '' AND regexp_matches(d, {MIXES}) AND NOT contains(d, ',') AND length(d) <= 60 THEN trim(regexp_replace(t, {_q(DASH_MIX)}, '')) ELSE t END AS without_mix,
      CASE WHEN b <> '' AND regexp_matches(b, {MIXES}) THEN ' ' || regexp_extract(t, {_q(BRACKET_MIX)}, 1) WHEN d <> '' AND regexp_matches(d, {MIXES}) AND NOT contains(d, ',') AND length(d) <= 60 THEN ' (' || d || ')' ELSE '' END AS mix FROM m"""
)
def f15_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles cleaned, and their mixes."""
    t = F.col("t")
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(TITLES, 'p_partkey')} AS t")
    return d.select("p_partkey", N.clean_title(t).alias("clean"), N.mix_suffix(t)["title"].alias("without_mix"), N.mix_suffix(t)["suffix"].alias("mix"))


def stems_ctes(source: str, key: str) -> str:
    """CTEs from ``source`` (``key``, stem, folder) to ``stems``: what the file's name says."""
    cut = lambda p: f"list_filter(list_transform(regexp_split_to_array(s, '{p}'), lambda x: trim(x)), lambda x: x <> '')"
    few = _list(["mix", "rmx", "vip", "dub", "edit", "live", "demo", "ost", "dj", "va", "lp"])
    three, two = r"^(.+?)\s*[-–]\s*(.+?)\s*[-–]\s*(.+)$", r"^(.+?)\s*[-–]\s*(.+)$"
    return rf"""st_a AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(ltrim(stem), '^\d-\d{{2}}\s+', ''), '^[A-Da-d]\d{{1,2}}\s*[-–—]?\s+', ''), '\s+', ' ', 'g')) AS bare, regexp_extract(stem, {_q(N.STORE_MULTI)}, 1) AS st, regexp_extract(stem, {_q(N.STORE_MULTI)}, 2) AS sa,
      regexp_extract(trim(stem), {_q(N.STORE_MIX)}, 1) AS smix, trim(regexp_replace(trim(stem), {_q(N.STORE_MIX)}, '')) AS srest FROM {source}),
    st_b AS (SELECT *, stem <> ltrim(stem) OR regexp_matches(lower(folder), '^(beatport|traxsource)') OR (contains(sa, ',') AND NOT contains(st, ',') AND NOT regexp_matches(st, '^\d{{1,3}}[\s-]')) AS store, regexp_matches(bare, {_q(N.DJ_ENCODED)}) AS encoded,
      regexp_extract(srest, '^(.*?)\s+-\s+(.*)$', 1) AS xt, regexp_extract(srest, '^(.*?)\s+-\s+(.*)$', 2) AS xa,
      regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(replace(replace(bare, '_-_', ' - '), '_', ' '), '\s+', ' ', 'g')), {_q(N.LONG_ID)}, '')), '^[\[\(][^\]\)]+[\]\)]\s*', ''), '^\(?\d{{1,3}}\)?\s*[-–—.]\s*', ''), '^\d{{1,3}}\s+', '') AS s FROM st_a),
    st_c AS (SELECT *, CASE WHEN len({cut(chr(92) + 's+[-–—]' + chr(92) + 's+')}) >= 2 THEN {cut(chr(92) + 's+[-–—]' + chr(92) + 's+')} ELSE {cut(chr(92) + 's*[-–—]' + chr(92) + 's*')} END AS p0, CASE WHEN xt = '' THEN srest ELSE trim(string_split(xa, ',')[1]) END AS store_artist, trim(xt) AS store_title FROM st_b),
    st_d AS (SELECT *, CASE WHEN len(p0) >= 3 AND regexp_matches(p0[-1], '^[a-z]{{2,5}}$') AND NOT list_contains({few}, p0[-1]) THEN p0[:len(p0) - 1] ELSE p0 END AS p,
      trim(regexp_replace(replace(trim(regexp_replace(trim(regexp_replace(stem, '^\[.*?\]\s*', '')), '^\(.*?\)\s*', '')), '_', ' '), '\s{{2,}}', ' ', 'g')) AS q FROM st_c),
    st_e AS (SELECT *, CASE WHEN regexp_matches(q, '^(1[0-2]|[1-9])[ABabdDmM]\s*[-–.\s]') THEN trim(regexp_replace(q, '^\d{{1,3}}[\s.-]+(\d)', '\1')) ELSE trim(regexp_replace(q, '^\d{{1,3}}[a-zA-Z]?[\s.-]+', '')) END AS q2 FROM st_d),
    st_f AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(q2, '^[A-Z]\d{{1,2}}[\s.-]+([A-Z])', '\1')), '[-–]\s*[-–]', '-', 'g')), '^\s*[-–]\s*', '')) AS dump FROM st_e),
    st_g AS (SELECT *, trim(regexp_extract(dump, {_q(three)}, 1)) AS d1, trim(regexp_extract(dump, {_q(three)}, 2)) AS d2, trim(regexp_extract(dump, {_q(two)}, 1)) AS lone FROM st_f),
    st_h AS (SELECT *, CASE WHEN length(d1) <= 3 AND regexp_matches(d1, '^\d+[a-zA-Z]?$') THEN d2 ELSE d1 END AS chosen FROM st_g),
    stems AS (SELECT {key}, store, encoded, CASE WHEN store AND store_artist <> '' AND store_title <> '' THEN store_artist WHEN encoded THEN NULL WHEN len(p) >= 2 THEN p[1] END AS artist,
      CASE WHEN store AND store_artist <> '' AND store_title <> '' THEN store_title WHEN encoded THEN NULL WHEN len(p) >= 2 THEN array_to_string(p[2:], ' - ') WHEN len(p) = 1 THEN p[1] END AS title, dump,
      CASE WHEN regexp_matches(dump, {_q(three)}) AND length(chosen) > 1 AND NOT regexp_matches(chosen, '^\d+$') THEN chosen WHEN regexp_matches(dump, {_q(two)}) AND length(lone) > 1 AND NOT regexp_matches(lone, '^\d+$') THEN lone END AS dump_artist FROM st_h)"""


@query(f"WITH n AS (SELECT p_partkey, {pick(STEMS, 'p_partkey')} AS stem, {pick(['Beatport 1', 'x', 'x'], 'p_partkey')} AS folder FROM part), {stems_ctes('n', 'p_partkey')} SELECT * FROM stems")
def f17_file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Artists and titles that file names give."""
    s, f = F.col("stem"), F.col("folder")
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(STEMS, 'p_partkey')} AS stem", f"{pick(['Beatport 1', 'x', 'x'], 'p_partkey')} AS folder").withColumn("dump", N.dump_stem(s))
    bare = F.regexp_replace(N.strip(F.regexp_replace(F.regexp_replace(F.ltrim(s), r"^\d-\d{2}\s+", ""), r"^[A-Da-d]\d{1,2}\s*[-–—]?\s+", "")), r"\s+", " ")
    return d.select("p_partkey", N.store_format(s, f).alias("store"), bare.rlike(N.DJ_ENCODED).alias("encoded"), N.file_parts(s, f)["artist"].alias("artist"), N.file_parts(s, f)["title"].alias("title"), "dump", N.dump_artist(F.col("dump")).alias("dump_artist"))


def folders_ctes(source: str, name: str, key: str) -> str:
    """CTEs from ``source`` (with ``key`` and ``name``) to ``cleaned`` (key, clean_name, name_year, name_type, name_label, scene)."""
    steps: list[str] = []

    def step(value: str, year: str = "y", type_: str = "ty", label: str = "la", scene: str = "sc") -> None:
        before = f"s{len(steps) - 1}" if steps else "s_"
        steps.append(f"s{len(steps)} AS (SELECT {key}, {value} AS n, {year} AS y, {type_} AS ty, {label} AS la, {scene} AS sc FROM {before})")

    rep = lambda p, by="", x="n", g="'g'": f"regexp_replace({x}, {_q(p)}, '{by}', {g})"
    ex = lambda p, k, x="n": f"regexp_extract({x}, {_q(p)}, {k})"
    has = lambda p, x="n": f"regexp_matches({x}, {_q(p)})"
    one = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    step("url_decode(n)")
    step(rep(r"^\._"))
    step(f"trim({rep(r'\s*!{2,}$', x=rep(r'^!{2,}\s*'))})")
    step(f"trim({rep(r'^[A-Z]{2,8}[0-9]{2,8}[A-Z0-9]*\s+(.+)$', '\\1')})")
    bracket = r"^\[([^\]]+)\]\s*(.*)$"
    step(f"CASE WHEN {has(chr(92) + 'd', ex(bracket, 1))} AND {ex(bracket, 2)} <> '' THEN trim({ex(bracket, 2)}) ELSE n END")
    step(f"trim({rep(r'(?i)\s*\(self[- ]?released(?:\s+cd)?\)\s*', ' ')})")
    mashup = r"(?i)\bmashup\s+album\b"
    step(f"CASE WHEN {has(mashup)} THEN {one(rep(mashup))} ELSE n END", type_=f"CASE WHEN {has(mashup)} THEN 'mashup' END")
    step(rep(r"(?i)^Best\s+New\s+(?:Hype\s+)?", x=f"CASE WHEN {has(r'^Beatport\.[A-Za-z]')} THEN replace(n, '.', ' ') ELSE n END"))
    month = f"({_list(naming.MONTHS)})[try_cast({ex(naming.DATE_TAIL, 2)} AS INT)]"
    named = ex(naming.MONTH_TAIL, 1)
    step(f"CASE WHEN {named} <> '' THEN trim({rep(naming.MONTH_TAIL)}) || ' (' || upper(({named})[1]) || lower(({named})[2:]) || ' ' || {ex(naming.MONTH_TAIL, 2)} || ')' WHEN {month} IS NOT NULL THEN trim({rep(naming.DATE_TAIL)}) || ' (' || {month} || ' ' || {ex(naming.DATE_TAIL, 1)} || ')' ELSE n END")
    step(f"trim(regexp_replace(trim(regexp_replace(n, '  +', ' ', 'g')), '^[. _]+|[. _]+$', '', 'g'))")
    step(f"CASE WHEN {has(naming.DISCOGRAPHY)} THEN trim({rep(naming.BITRATE, ' ')}) ELSE n END", type_=f"CASE WHEN {has(naming.DISCOGRAPHY)} THEN 'discography' ELSE ty END")
    d = naming.DOTTED_YEAR
    step(f"CASE WHEN {ex(d, 2)} <> '' THEN trim({ex(d, 1)}) || ' - ' || trim({ex(d, 3)}) ELSE n END", year=f"nullif({ex(d, 2)}, '')")
    step(one("n"))
    spread = "CASE WHEN contains(n, '_') AND NOT contains(n, ' ') THEN replace(n, '_', ' ') END"
    wide = f"coalesce({has(naming.SCENE, spread)}, false)"
    step(f"CASE WHEN {wide} THEN regexp_replace(trim({rep(naming.SCENE, x=spread)}), '[- ]+$', '') WHEN {has(naming.SCENE)} THEN regexp_replace(trim({rep(naming.SCENE)}), '[-_ ]+$', '') ELSE n END", scene=f"{wide} OR {has(naming.SCENE)}")
    step(f"CASE WHEN contains(n, '--') THEN {one("replace(" + rep("--+", " - ") + ", '_', ' ')")} ELSE n END")
    step(f"trim({rep(r'\s*\{[^}]{1,40}\}\s*', ' ', x=rep(r'\s*~\s*', ' - '))})")
    step(fold_sql("n", [naming.LABEL_BRACKET, naming.TYPE_BRACKET]))
    step(fold_sql("n", naming.FORMAT_TAILS * 4))
    step(fold_sql("n", [naming.DISC_RATE, naming.CATALOG_TAIL]))
    for p in naming.TWICE_DATED:
        rest = f"trim(regexp_replace(trim({ex(p, 2)}), '[-–]+$', ''))"
        joined = one(f"(CASE WHEN contains(({rest})[:3], '-') THEN {ex(p, 1)} || {rest} ELSE {ex(p, 1)} || ' - ' || {rest} END)")
        step(f"CASE WHEN {ex(p, 1)} <> '' THEN {joined} ELSE n END", year=f"coalesce(y, nullif({ex(p, 1)}, ''))")
    step(f"CASE WHEN {has(naming.MID_PAREN)} THEN {one(rep(naming.MID_PAREN, ' - '))} ELSE n END", year=f"coalesce(y, nullif({ex(naming.MID_PAREN, 1)}, ''))")
    p = naming.MID_BRACKET
    step(f"CASE WHEN {ex(p, 2)} <> '' THEN trim({ex(p, 1)}) || ' - ' || trim({ex(p, 3)}) ELSE n END", year=f"coalesce(y, nullif({ex(p, 2)}, ''))")
    p = naming.LABEL_FIRST
    led = has(N.LABEL_LIKE, ex(p, 1))
    step(f"CASE WHEN {led} THEN trim({ex(p, 3)}) || ' - ' || {ex(p, 2)} || ' - ' || trim({ex(p, 4)}) ELSE n END", label=f"CASE WHEN {led} THEN trim({ex(p, 1)}) END", year=f"coalesce(y, CASE WHEN {led} THEN {ex(p, 2)} END)")
    step(f"trim(regexp_replace({one('n')}, '[-– ]+$', ''))")
    step(one(f"regexp_replace(trim({rep(r'(?i)([a-z])(?:19|20)\d{2}\s*$', '\\1')}), '[-– ]+$', '')"))
    start = f"s_ AS (SELECT {key}, trim(regexp_replace(translate({name}, '{naming.CYRILLIC}', '{naming.LATIN}'), '  +', ' ', 'g')) AS n, CAST(NULL AS VARCHAR) AS y, CAST(NULL AS VARCHAR) AS ty, CAST(NULL AS VARCHAR) AS la, false AS sc FROM {source})"
    return f"{start}, {', '.join(steps)}, cleaned AS (SELECT {key}, n AS clean_name, y AS name_year, ty AS name_type, la AS name_label, sc AS scene FROM s{len(steps) - 1})"


def parsed_ctes(key: str) -> str:
    """CTEs from ``cleaned`` to ``heuristic`` (its columns and heuristic_artist, heuristic_album, heuristic_year)."""
    led, pair = _q(r"^[\[\(]?(19\d{2}|20\d{2})[\]\)]?\s*[-–]\s*(.+?)\s*[-–]\s*(.+)$"), _q(r"^(.+?)\s*[-–]\s*(.+)$")
    return rf"""full_ AS (SELECT *, trim(regexp_replace(replace(replace(trim(regexp_replace({title_sql('clean_name')}, '(?i)\s*\[[A-Z0-9.\s]+\]\s*$', '')), '_-_', ' - '), '_', ' '), '\s+', ' ', 'g')) AS f FROM cleaned),
    bare_ AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(f, '[\[\(]\s*(19\d{{2}}|20\d{{2}})\s*[\]\)]', '', 'g')), '\b(19\d{{2}}|20\d{{2}})\b', '', 'g')), '\s+', ' ', 'g')), '[-–]+$', '')) AS b FROM full_),
    parts_ AS (SELECT *, CASE WHEN regexp_matches(f, {led}) THEN trim(regexp_extract(f, {led}, 2)) WHEN regexp_matches(b, {pair}) THEN trim(regexp_extract(b, {pair}, 1)) END AS ha,
      CASE WHEN regexp_matches(f, {led}) THEN trim(regexp_replace(regexp_extract(f, {led}, 3), '\s*[\(\[](19\d{{2}}|20\d{{2}})[\]\)]\s*$', '')) WHEN regexp_matches(b, {pair}) THEN regexp_replace(trim(regexp_extract(b, {pair}, 2)), '[-– ]+$', '') WHEN b <> '' THEN b END AS hb FROM bare_),
    heuristic AS (SELECT {key}, clean_name, name_year, name_type, name_label, scene, {title_sql('ha')} AS heuristic_artist, {title_sql('hb')} AS heuristic_album, coalesce(name_year, nullif(regexp_extract(f, '\b(19\d{{2}}|20\d{{2}})\b', 1), '')) AS heuristic_year FROM parts_)"""


@query(f"WITH named AS (SELECT p_partkey, {pick(FOLDERS, 'p_partkey')} AS name FROM part), {folders_ctes('named', 'name', 'p_partkey')}, {parsed_ctes('p_partkey')} SELECT * FROM heuristic")
def f21_folder_names(spark: SparkSession, sf: str) -> DataFrame:
    """Folder names cleaned in steps, and what they say of artist, album and year."""
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(FOLDERS, 'p_partkey')} AS name")
    return naming.parse_folders(d, "name").drop("name")


PATH_FIELDS = {
    "artist": pick(["Ann Lee", "", "A: B", "Bo."], "p_partkey"), "album": pick(["Night Drive", "", "Tides/Two"], "p_partkey"), "year": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 1970 + p_size END", "genre": pick(["House", "", None], "p_partkey"),
    "bpm": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(60 + 2 * p_size AS DOUBLE) END", "key": pick(["Am", "F# major", "", None, "bb minor"], "p_partkey"), "label": pick(["Bright Music Ltd", None, "Deep Records"], "p_partkey"),
    "is_va": "p_partkey % 11 = 0", "is_mix": "p_partkey % 13 = 0", "is_single": "p_partkey % 17 = 0", "is_flac": "p_partkey % 3 = 0",
}
WHEEL_SQL = "CASE WHEN key = 'Am' THEN '8A' WHEN key = 'F# major' THEN '2B' WHEN key = 'bb minor' THEN '3A' ELSE '_Unknown Key' END"
ZONE_SQL = "CASE WHEN bpm IS NULL THEN '_Unknown BPM' WHEN bpm BETWEEN 60 AND 99 THEN 'Downtempo' WHEN bpm BETWEEN 100 AND 119 THEN 'Mid-Tempo' WHEN bpm BETWEEN 120 AND 132 THEN 'House' WHEN bpm BETWEEN 133 AND 145 THEN 'Techno' WHEN bpm BETWEEN 160 AND 180 THEN 'D&B / Jungle' ELSE CAST(CAST(floor(bpm / 10) * 10 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(bpm / 10) * 10 AS INT) + 9 AS VARCHAR) END"


@query(
    f"""WITH x AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in PATH_FIELDS.items())} FROM part), y AS (SELECT *, {safe_sql("CASE WHEN artist = '' THEN '_Unknown' ELSE artist END")} AS a, {safe_sql("CASE WHEN album = '' THEN '_Untitled' ELSE album END")} AS b,
      CASE WHEN coalesce(genre, '') = '' THEN '_Unsorted' ELSE genre END AS g, {ZONE_SQL} AS z, {WHEEL_SQL} AS w, CASE WHEN year IS NULL THEN '_Unknown Era' ELSE CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's' END AS dec,
      coalesce(nullif({fold_sql('trim(label)', [N.LABEL_TAIL] * 3)}, ''), '_Unknown Label') AS l FROM x),
    t AS (SELECT *, CASE WHEN year IS NULL THEN b ELSE b || ' (' || CAST(year AS VARCHAR) || ')' END AS dated FROM y),
    p AS (SELECT p_partkey, unnest([{{'template': 'genre-bpm-key', 'path': g || '/' || z || '/' || w || '/' || a || ' - ' || b}}, {{'template': 'dated', 'path': a || '/' || coalesce(CAST(year AS VARCHAR), '') || ' - ' || b}}, {{'template': 'label', 'path': l || '/' || a || ' - ' || b}}, {{'template': 'decade', 'path': dec || '/' || g || '/' || a || ' - ' || b}}]) AS u, is_mix, is_va, is_single, is_flac, a, b, dated FROM t)
    SELECT p_partkey, u.template AS template, 'clean/' || CASE WHEN is_mix THEN '_Mixes/' || dated WHEN is_va THEN '_Various Artists/' || dated WHEN is_single THEN a || '/Singles' WHEN is_flac THEN a || '/FLAC/' || b ELSE u.path END AS path FROM p"""
)
def f40_library_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Target paths by four templates."""
    d = read(spark, sf, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in PATH_FIELDS.items()])
    each = [F.struct(F.lit(t).alias("template"), naming.library_path("clean", naming.TEMPLATES[t], flac_apart=True).alias("path")) for t in ("genre-bpm-key", "dated", "label", "decade")]
    return d.select("p_partkey", F.inline(F.array(*each)))


EP = r"(?i)\s*[\(\[]\s*E\.?P\.?\s*[\]\)]\s*$|\s+E\.?P\.?\s*$"


@query(
    rf"""WITH x AS (SELECT p_partkey, {pick(ALBUMS, 'p_partkey')} AS album, CASE WHEN p_partkey % 3 = 0 THEN 1999 WHEN p_partkey % 3 = 1 THEN 2004 END AS year, p_partkey % 2 = 0 AS ep, {pick(['.mp3', '.flac'], 'p_size')} AS e1, {pick(['.flac', '.m4a', '.flac'], 'p_size')} AS e2 FROM part),
    y AS (SELECT *, CASE WHEN ep THEN trim(regexp_replace(album, {_q(EP)}, '')) || ' [EP]' ELSE album END AS w FROM x),
    z AS (SELECT *, regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(w, '\s*[\(\[]\s*' || CAST(year AS VARCHAR) || '\s*[\)\]]\s*', ' ', 'g')), '(?:^|\s+)' || CAST(year AS VARCHAR) || '(?:\s+|$)', ' ', 'g')), '^\s*' || CAST(year AS VARCHAR) || '\s*[-–—]\s*', '', 'g')), '^[ –—-]+|[ –—-]+$', '', 'g') AS v FROM y),
    k AS (SELECT *, CASE WHEN year IS NULL OR v = '' THEN w ELSE v END AS named FROM z)
    SELECT p_partkey, named, CASE WHEN e1 = e2 AND e1 <> '.mp3' THEN named || ' [' || upper(e1[2:]) || ']' ELSE named END AS suffixed, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' - ' || named || e1 AS file_name FROM k"""
)
def f42_names_for_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Albums as they stand in folder names, format suffixes, numbered file names."""
    d = read(spark, sf, "part").selectExpr(
        "p_partkey", f"{pick(ALBUMS, 'p_partkey')} AS album", "CASE WHEN p_partkey % 3 = 0 THEN 1999 WHEN p_partkey % 3 = 1 THEN 2004 END AS year", "p_partkey % 2 = 0 AS ep", f"{pick(['.mp3', '.flac'], 'p_size')} AS e1", f"{pick(['.flac', '.m4a', '.flac'], 'p_size')} AS e2"
    )
    d = d.withColumn("named", naming.album_for_name(F.col("album"), F.col("year"), F.col("ep")))
    number = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    return d.select("p_partkey", "named", naming.format_suffix(F.col("named"), F.array_distinct(F.array("e1", "e2"))).alias("suffixed"), F.concat(number, F.lit(" - "), "named", "e1").alias("file_name"))


@query(f"WITH x AS (SELECT p_partkey, {pick(WORDS, 'p_partkey')} || ' ' || p_name AS t FROM part) SELECT p_partkey, strip_accents(t) AS folded, nfc_normalize(t) AS composed, to_json([t, CAST(p_partkey AS VARCHAR)]) AS json FROM x")
def f50_folded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Accents folded, Unicode composed, arrays as JSON text."""
    d = read(spark, sf, "part").selectExpr("p_partkey", f"{pick(WORDS, 'p_partkey')} || ' ' || p_name AS t")
    return d.select("p_partkey", N.ascii_fold(F.col("t")).alias("folded"), N.composed(F.col("t")).alias("composed"), F.to_json(F.array("t", F.col("p_partkey").cast("string"))).alias("json"))
