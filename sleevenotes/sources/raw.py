"""Files with raw, untidy tags over the given tables, for the operators that find and mend what is wrong with them.

The expressions are SQL that Spark and DuckDB read alike; the operators under test have SQL of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapters import read, read_spread

ARTISTS = ["Ann Lee", "DJ Shadow Lane", "Big Sound Crew", "Miles of Blue", "The Ox & Fox", "Ana Lopez"]
TAILS = ["", " [Official Video]", " (FREE DL)", " - Original Mix", " 124 BPM", " 8A", "  (Original Mix)", " key: Am", " [FLAC]", " OUT NOW", " F# minor", "  x", " (feat. Guest)"]
BEFORE = ["", "10B - ", "", "", "  ", "", "13A - ", "", "CafÃ© ", "", "", ""]
AFTER = ["", "", " ft. Guest", " featuring Guest", " ", " & Friend", "", " 128 BPM", "", "", "", " and Friend"]
COMMENTS = [
    None, "Purchased at Beatport", "visit www.example.com now", "for promotional use only 128 bpm", "Encoded by LAME 3.99", "a b  c", "mail dj@example.com", "DJ City", "from bandcamp", "(c) 2004 key: Bbm", "itunes",
]
ENCODERS = [None, "LAME 3.99", "iTunes 12", "yt-dlp 2021"]


def pick(values: list[str | None], k: str) -> str:
    """SQL of the k-th value, counted round."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE ({k}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


O, N, P, S = "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
GROUP = f"CAST(floor({O} / 40) AS BIGINT)"
HOLDER = f"({GROUP} + CASE WHEN {O} % 4 = 0 THEN 1 ELSE 0 END)"
BY = pick(ARTISTS, f"{HOLDER} + CASE WHEN {P} % 10 < 2 OR {O} % 9 = 3 THEN {N} ELSE 0 END")
FORM = f"({P} * 3 + {S})"
ALBUM = f"{pick(['Night Drive', 'Blue River', 'Harvest', 'Signals', 'Tides'], O)} || ' ' || CAST({O} AS STRING)"
PARENT = f"{pick(ARTISTS, GROUP)} || ' ' || CAST({GROUP} AS STRING)"
LEAF = f"""CASE {O} % 8 WHEN 0 THEN {pick(ARTISTS, HOLDER)} || ' - ' || {ALBUM} || ' (1999)' WHEN 1 THEN {pick(ARTISTS, HOLDER)} || ' - ' || {ALBUM} WHEN 2 THEN 'Unsorted ' || CAST({O} AS STRING) WHEN 3 THEN 'club set ' || CAST({O} AS STRING)
  WHEN 4 THEN {ALBUM} || ' [2001]' WHEN 5 THEN 'House - ' || {ALBUM} WHEN 6 THEN 'VA - ' || {ALBUM} ELSE {pick(ARTISTS, HOLDER)} || ' – ' || {ALBUM} END"""
BASE = f"{pick(['Night Drive', 'Blue River', 'Golden', 'Last Call'], P)} || ' ' || CAST({P} AS STRING)"
EXT = f"CASE {P} % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' ELSE '.m4a' END"
NUMBER = f"lpad(CAST({N} AS STRING), 2, '0')"
FIELDS = {
    "file_id": f"concat_ws('-', CAST({O} AS STRING), CAST({N} AS STRING), CAST({P} AS STRING), CAST({S} AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))",
    "parent_name": PARENT,
    "folder_name": LEAF,
    "folder_path": f"'lib/' || {PARENT} || '/' || {LEAF}",
    "filename": f"""CASE ({P} + 3 * {N}) % 7 WHEN 0 THEN {NUMBER} || ' - ' || {BASE} WHEN 1 THEN 'youtube_abcdefghijk_audio ' || CAST({P} AS STRING) WHEN 2 THEN {BASE} || ' [YouConvert.net]' WHEN 3 THEN 'www.site.com ' || {BASE}
      WHEN 4 THEN '12345678_' || {BASE} WHEN 5 THEN {NUMBER} || ' ' || {BASE} ELSE {BY} || ' - ' || {BASE} END || {EXT}""",
    "ext": EXT,
    "title": f"{BASE} || {pick(TAILS, f'{P} + {N}')}",
    "artist": f"CASE {FORM} % 12 WHEN 9 THEN NULL WHEN 10 THEN upper({BY}) WHEN 11 THEN lower({BY}) || ' and friend' ELSE {pick(BEFORE, FORM)} || {BY} || {pick(AFTER, FORM)} END",
    "album": f"CASE WHEN {P} % 13 = 0 THEN NULL WHEN {O} % 5 = 0 THEN {ALBUM} || ' ' || CAST({N} AS STRING) ELSE {ALBUM} END",
    "album_artist": f"CASE WHEN {P} % 3 = 0 THEN NULL WHEN {O} % 9 = 3 THEN 'Various Artists' ELSE {pick(ARTISTS, HOLDER)} END",
    "year": f"CASE WHEN {P} % 11 = 0 THEN NULL ELSE CAST(1990 + {O} % 30 + CASE WHEN {P} % 7 = 0 THEN 1 ELSE 0 END AS STRING) END",
    "track_number": f"CASE WHEN {S} % 6 = 0 THEN NULL ELSE CAST({N} AS STRING) || '/7' END",
    "genre": pick(["House", "Techno", None, "Jazz"], S),
    "bpm": f"CASE WHEN {P} % 4 = 0 THEN CAST(90 + {P} % 60 AS STRING) END",
    "key": f"CASE WHEN {P} % 5 = 0 THEN 'Am' END",
    "label": pick([None, "Deep Records", "Bright Music Ltd"], S),
    "isrc": f"'P' || CAST({P} AS STRING)",
    "comment": pick(COMMENTS, f"{P} + 2 * {S}"),
    "encoder": pick(ENCODERS, f"{P} + {N} * 3"),
    "compilation": f"CASE WHEN {O} % 9 = 3 THEN '1' END",
    "size": "CAST(l_quantity * 1000 AS BIGINT)",
}
RAW_SQL = "v_raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM lineitem)"


def raw_files(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """One row per file: its place, its name and its tags as they were found. One scan, no joins. ``heavy``: for much work
    on every file (`read_spread`)."""
    return (read_spread if heavy else read)(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in FIELDS.items()])
