"""Registered queries of the organiser: proposals from end to end, crates, duplicates, renames, dumps, library upkeep."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import text as T
from .naming_queries import BRACKET_MIX, DASH_MIX, KEY, MIXES, _list, clean_title_sql, display_sql, fold_sql, folders_ctes, parsed_ctes, safe_sql, same_sql, stems_ctes, title_sql
from .operators import classify, context, library, patterns, proposals, routing
from .operators.classify import EP_NAME, MIX_NAME, VARIOUS
from .queries import SIMILAR_SQL, query
from .scanner_queries import CONTEXT_SQL, _q
from .sources.adapters import read
from .sources.raw import FIELDS, RAW_SQL, pick, raw_files
from .tables import settled

# DuckDB forms


def vote_key_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[\(\[].*?[\)\]]', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def garbage_sql(x: str) -> str:
    return f"coalesce(regexp_matches(trim({x}), {_q(N.GARBAGE_URL)}) OR (list_contains({_list(N.KEY_NAMES)}, lower(trim({x}))) AND length(trim({x})) <= 4), false)"


def unknown_sql(x: str) -> str:
    return f"(coalesce(lower(trim({x})), '') IN ('', 'unknown album', 'untitled'))"


def tokens_sql(x: str) -> str:
    every = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
    year = f"list_position(list_transform({every}, lambda t: regexp_matches(t, '^(19|20)[0-9]{{2}}$')), true)"
    return f"list_filter(CASE WHEN coalesce({year}, 0) > 0 THEN ({every})[:{year}] ELSE {every} END, lambda t: length(t) > 1 AND NOT list_contains({_list(T.NOISE_TOKENS)}, t))"


def safe_path_sql(artist: str, album: str, year: str) -> str:
    a, b = safe_sql(f"CASE WHEN coalesce({artist}, '') = '' THEN '_Unknown' ELSE {artist} END"), safe_sql(f"CASE WHEN coalesce({album}, '') = '' THEN '_Untitled' ELSE {album} END")
    dated = f"CASE WHEN {year} IS NULL THEN {b} ELSE {b} || ' (' || CAST({year} AS VARCHAR) || ')' END"
    return f"'clean/' || CASE WHEN is_mix THEN '_Mixes/' || {dated} WHEN is_va THEN '_Various Artists/' || {dated} ELSE {a} || '/' || {b} END"


def proposals_ctes(as_album: bool = False, tail: str = "") -> str:
    """CTEs from ``v_raw`` to ``proposed{tail}``, by joins and aggregates of their own."""
    t = tail
    various = _list(VARIOUS)
    clean = lambda c: f"CASE WHEN NOT {garbage_sql(c)} THEN trim({c}) END"
    album = fold_sql(clean("album"), [*N.DISPLAY_NOISE, *N.DISC])
    feat = _q(proposals.FEATURED)
    fields = {
        "album": (vote_key_sql(album), album), "aa": (vote_key_sql(clean("album_artist")), clean("album_artist")), "artist": (vote_key_sql(clean("artist")), clean("artist")),
        "prim": (f"trim(regexp_replace({vote_key_sql(clean('artist'))}, {_q(proposals.JOINED)}, ''))", clean("artist")), "genre": ("trim(genre)", "genre"), "label": ("trim(label)", "label"), "key": ("trim(key)", "key"),
        "year": ("regexp_extract(year, '[0-9]{4}', 0)", "regexp_extract(year, '[0-9]{4}', 0)"),
    }
    long = " UNION ALL ".join(f"SELECT folder_path, file_id, '{f}' AS field, {k} AS k, {raw} AS raw FROM v_raw" for f, (k, raw) in fields.items())
    wide = ", ".join(f"max(k) FILTER (field = '{f}') AS {f}_k, max(shown) FILTER (field = '{f}') AS {f}_shown, coalesce(max(share) FILTER (field = '{f}'), 0.0) AS {f}_share, max(alls) FILTER (field = '{f}') AS {f}_all, max(kinds) FILTER (field = '{f}') AS {f}_kinds" for f in fields)
    number = "try_cast(regexp_extract(track_number, '^([0-9]+)', 1) AS INT)"
    any_tag = ", ".join(f"nullif({c}, '')" for c in ("title", "artist", "album", "album_artist", "year", "genre", "bpm", "key", "label", "track_number"))
    yes = "true" if as_album else "false"
    keyword, plain = f"coalesce(list_contains({various}, aa_k), false)", f"(aa_k IS NOT NULL AND NOT coalesce(list_contains({various}, aa_k), false))"
    main = lambda c: f"trim(regexp_replace({c}, {feat}, ''))"
    main_shown = lambda c: f"coalesce(nullif({main(c)}, ''), {c})"
    check = f"CASE WHEN {plain} THEN aa_share ELSE artist_share END"
    remix = _q(proposals.REMIX)
    rules = f"""CASE WHEN {plain} AND aa_k = artist_k AND aa_share >= 0.75 AND artist_share >= 0.75 THEN 'A' WHEN {plain} AND aa_share >= 0.90 AND (artist_k IS NULL OR (artist_share >= 0.75 AND artist_k = aa_k)) THEN 'A2'
      WHEN {plain} AND aa_share >= 0.60 AND length(aa_shown) >= 3 AND contains(lower(trim(folder_name)), lower(aa_shown)) THEN 'B' WHEN aa_k IS NULL AND artist_share >= 0.70 AND length(artist_k) >= 3 AND contains(lower(trim(folder_name)), artist_k) THEN 'C'
      WHEN aa_k IS NULL AND artist_share >= 0.95 THEN 'E' WHEN {plain} AND {main('aa_k')} = {main('artist_k')} AND aa_share >= 0.70 AND artist_share >= 0.70 THEN 'F' WHEN ({check}) >= 0.60 AND starts_with(lower(trim(parent_name)), checked) THEN 'G'
      WHEN ({check}) >= 0.60 AND sibling THEN 'H' WHEN (coalesce(regexp_matches(album_shown, {remix}), false) OR regexp_matches(folder_name, {remix})) AND ({plain} OR (aa_k IS NULL AND heuristic_artist IS NOT NULL)) THEN 'I' END"""
    crate_on = "crate_type IS NOT NULL" if not as_album else "false"
    bare = fold_sql("trim(album_d0)", N.TRAILING_DOMAINS)
    y = "CAST(year_picked AS VARCHAR)"
    unyear = rf"regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(w, '\s*[\(\[]\s*' || {y} || '\s*[\)\]]\s*', ' ', 'g')), '(?:^|\s+)' || {y} || '(?:\s+|$)', ' ', 'g')), '^\s*' || {y} || '\s*[-–—]\s*', '', 'g')), '^[ –—-]+|[ –—-]+$', '', 'g')"
    reserved = lambda x: f"CASE WHEN list_contains({_list(N.RESERVED)}, upper(regexp_replace({x}, '^(.+)\\.[^.]+$', '\\1'))) THEN {x} || '_' ELSE {x} END"
    covered = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 0.5 ELSE len(list_filter({a}, lambda t: list_contains({b}, t))) * 1.0 / len({a}) END"
    first = f"""pf_long AS ({long}), pf_sp AS (SELECT folder_path, field, k, raw, count(*) AS n, min(file_id) AS o FROM pf_long WHERE coalesce(k, '') <> '' GROUP BY ALL),
    pf_keys AS (SELECT folder_path, field, k, sum(n) AS n, min(o) AS o, arg_min(raw, (-n, o, raw)) AS shown FROM pf_sp GROUP BY ALL),
    pf_won AS (SELECT folder_path, field, k, shown, n * 1.0 / sum(n) OVER g AS share, sum(n) OVER g AS alls, count(*) OVER g AS kinds, row_number() OVER (PARTITION BY folder_path, field ORDER BY n DESC, o, k) AS r FROM pf_keys WINDOW g AS (PARTITION BY folder_path, field)),
    pf_wide AS (SELECT folder_path, {wide} FROM pf_won WHERE r = 1 GROUP BY folder_path),
    pf_facts AS (SELECT folder_path, folder_name, parent_name, count(*) AS files, count_if(coalesce({any_tag}) IS NULL) AS unreadable, median(try_cast(regexp_replace(bpm, '[^0-9.]', '', 'g') AS DOUBLE)) AS bpm_m, list_sort(list(DISTINCT ext)) AS extensions,
      count_if(coalesce(compilation, '') <> '') AS flagged, count_if({unknown_sql('album')}) AS unknown, count_if({unknown_sql('album')} OR lower(trim(album)) = lower(trim(folder_name))) AS poor, count(DISTINCT {vote_key_sql('album')}) FILTER (NOT {unknown_sql('album')}) AS real,
      count({number}) AS numbered, count(DISTINCT {number}) AS numbers, min({number}) AS lo, max({number}) AS hi FROM v_raw GROUP BY ALL),
    pf_named AS (SELECT folder_path, folder_name FROM pf_facts), {folders_ctes('pf_named', 'folder_name', 'folder_path')}, {parsed_ctes('folder_path')},
    pf_votes AS (SELECT f.*, w.* EXCLUDE (folder_path), h.heuristic_artist, h.heuristic_album, least(1.0, (real + unknown) * 1.0 / files) AS diversity, poor * 1.0 / files AS poor_share, (files - flagged) * 1.0 / files AS unflagged, coalesce(hi - lo + 1 - numbers, 0) AS gaps,
      CASE WHEN regexp_matches(lower(folder_name), {_q("|".join(proposals.CRATE_WORDS))}) THEN 1.0 ELSE 0.0 END AS word FROM pf_facts f LEFT JOIN pf_wide w USING (folder_path) JOIN heuristic h USING (folder_path)),
    pf_loose AS (SELECT *, CASE WHEN numbered = 0 THEN 1.0 WHEN files >= 3 THEN least(1.0, (gaps + numbered - numbers + files - numbered) * 1.0 / files) ELSE 0.5 END AS loose FROM pf_votes),
    pf_veto AS (SELECT *, diversity * 0.35 + poor_share * 0.20 + loose * 0.15 + word * 0.15 + unflagged * 0.15 AS score, CASE WHEN files < 3 THEN 'too_few_tracks' WHEN regexp_matches(folder_name, {_q(proposals.SET_NAME)}) THEN 'set_prep_pattern_match'
      WHEN album_share >= 0.6 AND album_k IS NOT NULL AND NOT {unknown_sql('album_k')} THEN 'album_coherence_veto' WHEN flagged * 1.0 / files >= 0.7 AND album_share >= 0.5 THEN 'compilation_flag_veto' WHEN {keyword} AND aa_share >= 0.8 AND album_share >= 0.5 THEN 'properly_tagged_va'
      WHEN numbered >= 0.8 * files AND files >= 3 AND numbered = numbers AND gaps = 0 AND numbered > 0 THEN 'sequential_tracks_veto' END AS veto FROM pf_loose),
    pf_crate AS (SELECT *, CASE WHEN veto = 'set_prep_pattern_match' THEN 'set' WHEN veto IS NULL AND round(score, 9) >= CASE WHEN coalesce(regexp_matches(album_k, {_q(N.LABEL_LIKE)}), false) THEN 0.85 ELSE 0.55 END THEN 'singles' END AS crate_type,
      CASE WHEN veto = 'set_prep_pattern_match' THEN 0.9 WHEN veto IS NOT NULL THEN 0.0 ELSE round(score + 1e-9, 4) END AS crate_score, lower(CASE WHEN {plain} THEN aa_k ELSE artist_k END) AS checked FROM pf_veto),
    pf_sib AS (SELECT a.folder_path, count_if(contains(lower(trim(b.folder_name)), a.checked)) > 0 AS sibling FROM pf_crate a JOIN pf_crate b ON a.parent_name = b.parent_name AND a.folder_path <> b.folder_path WHERE a.checked <> '' GROUP BY a.folder_path),
    pf_base AS (SELECT c.*, coalesce(sibling, false) AS sibling FROM pf_crate c LEFT JOIN pf_sib USING (folder_path)),
    pf_st AS (SELECT file_id, folder_path, title AS tag_title, regexp_replace(filename, '[.][^.]*$', '') AS stem, '' AS folder FROM v_raw), {stems_ctes('pf_st', 'file_id, folder_path, tag_title')},
    pf_like AS (SELECT folder_path, tag_title, regexp_replace(lower(trim(title)), '\\s+', ' ', 'g') AS a, regexp_replace(lower(trim(tag_title)), '\\s+', ' ', 'g') AS b FROM stems),
    pf_fc AS (SELECT folder_path, avg(CAST(CASE WHEN a <> '' AND b <> '' THEN {SIMILAR_SQL.format(a='a', b='b')} WHEN coalesce(a, '') = '' AND coalesce(b, '') = '' THEN 0.5 END AS DECIMAL(20, 12))) AS fc FROM pf_like GROUP BY folder_path),
    pf_k AS (SELECT folder_path, {number} AS k, title, lower(trim(album_artist)) AS aa FROM v_raw), pf_rep AS (SELECT folder_path, count(*) AS repeats FROM (SELECT folder_path, k FROM pf_k WHERE k <> 0 GROUP BY ALL HAVING count(*) > 1) GROUP BY folder_path),
    pf_tq AS (SELECT folder_path, count_if(trim(title) <> '') AS tn, count_if(length(trim(title)) >= 2 AND NOT regexp_matches(lower(title), 'free\\s+download|promo\\s+only|www[.]|[.]com\\b|[.]net\\b|[.]org\\b')) AS tok, count(DISTINCT nullif(lower(trim(title)), '')) AS td, max(nullif(k, 0)) - min(nullif(k, 0)) + 1 - count(DISTINCT nullif(k, 0)) AS g FROM pf_k GROUP BY folder_path),
    pf_aa AS (SELECT folder_path, max(n) * 1.0 / sum(n) AS aac FROM (SELECT folder_path, aa, count(*) AS n FROM pf_k WHERE coalesce(aa, '') <> '' GROUP BY ALL) GROUP BY folder_path),
    pf_factors AS (SELECT folder_path, CASE WHEN tn = 0 THEN 0.5 WHEN td = 1 AND tn > 2 THEN least(tok * 1.0 / tn, 0.30) ELSE tok * 1.0 / tn END AS title_quality, coalesce(fc, 0.5) AS filename_consistency, greatest(0.0, 1 - least(0.30, coalesce(g, 0) * 0.06) - least(0.20, coalesce(repeats, 0) * 0.07)) AS completeness,
      coalesce(aac, 0.5) AS aa_consistency FROM pf_tq LEFT JOIN pf_fc USING (folder_path) LEFT JOIN pf_rep USING (folder_path) LEFT JOIN pf_aa USING (folder_path))""" if not tail else ""
    second = f"""va_0{t} AS (SELECT *, {rules} AS rule, {keyword} OR (aa_k IS NULL AND coalesce(prim_kinds * 1.0 / prim_all >= 0.75 AND prim_share < 0.40, false)) AS flagged_va, regexp_matches(folder_name, {_q(proposals.VA_NAME)}) AS forced,
      coalesce(regexp_matches(aa_shown, {_q(N.LABEL_LIKE)}), false) AND artist_share >= 0.70 AS labelled FROM pf_base),
    va_1{t} AS (SELECT *, CASE WHEN {yes} THEN false WHEN crate_type IS NOT NULL THEN false WHEN forced THEN true WHEN labelled THEN false ELSE flagged_va AND rule IS NULL END AS is_va, labelled AND NOT forced AS swapped,
      CASE WHEN {yes} THEN 'as_album' WHEN crate_type IS NOT NULL THEN 'crate' WHEN forced THEN 'folder_name' WHEN labelled THEN 'D' WHEN flagged_va AND rule IS NOT NULL THEN rule WHEN {keyword} THEN 'keyword' WHEN flagged_va THEN 'many_artists' ELSE 'one_artist' END AS va_rule, {crate_on} AS is_crate FROM va_0{t}),
    pr_0{t} AS (SELECT *, coalesce(album_shown, heuristic_album, CASE WHEN is_crate THEN folder_name END) AS alb, {main_shown(f"coalesce(CASE WHEN swapped OR ({yes} AND {keyword}) THEN artist_k END, aa_shown, CASE WHEN va_rule = 'I' THEN heuristic_artist END)")} AS who1, {main_shown('artist_shown')} AS who2 FROM va_1{t}),
    pr_00{t} AS (SELECT *, {display_sql('who1')} AS d1, {display_sql('who2')} AS d2, regexp_split_to_array(heuristic_artist, '(?i)\\s+(?:and|&)\\s+') AS hp, {display_sql("array_to_string(regexp_split_to_array(heuristic_artist, '(?i)\\s+(?:and|&)\\s+'), ' & ')")} AS dh FROM pr_0{t}),
    pr_1{t} AS (SELECT *, {fold_sql(title_sql('alb'), N.DISPLAY_NOISE)} AS album_d0, CASE WHEN is_va THEN 'VA' ELSE coalesce(CASE WHEN who1 IS NULL AND len(hp) >= 2 AND trim(d2) <> '' AND len(list_filter(hp, lambda p: contains(lower(p), lower(trim(d2))))) > 0 THEN dh END, d1, d2, CASE WHEN is_crate THEN 'VA' END) END AS artist_display,
      CASE WHEN coalesce(year_all, 0) * 1.0 / files >= 0.50 AND year_share >= 0.70 AND try_cast(year_k AS INT) BETWEEN 1900 AND 2100 THEN try_cast(year_k AS INT) END AS year_picked, files BETWEEN 2 AND 6 OR regexp_matches(folder_name, {_q(EP_NAME)}) AS is_ep FROM pr_00{t}),
    pr_2{t} AS (SELECT *, CASE WHEN {bare} <> '' THEN {bare} ELSE album_d0 END AS album_display, NOT is_ep AND regexp_matches(folder_name, {_q(MIX_NAME)}) AS is_mix FROM pr_1{t}),
    pr_3{t} AS (SELECT *, CASE WHEN is_ep THEN trim(regexp_replace(album_display, '(?i)\\s*[\\(\\[]\\s*E\\.?P\\.?\\s*[\\)\\]]\\s*$|\\s+E\\.?P\\.?\\s*$', '')) || ' [EP]' ELSE album_display END AS w FROM pr_2{t}),
    pr_4{t} AS (SELECT *, CASE WHEN year_picked IS NULL OR {unyear} = '' THEN w ELSE {unyear} END AS v FROM pr_3{t}),
    pr_5{t} AS (SELECT *, {safe_sql(f"artist_display || ' - ' || v || CASE WHEN year_picked IS NULL THEN '' ELSE ' (' || {y} || ')' END")} AS sn FROM pr_4{t}),
    pr_6{t} AS (SELECT *, {reserved('sn')} || CASE WHEN len(extensions) = 1 AND extensions[1] <> '.mp3' THEN ' [' || upper(extensions[1][2:]) || ']' ELSE '' END AS proposed_name, {safe_path_sql('artist_display', 'album_display', 'year_picked')} || coalesce('/CD' || nullif(regexp_extract(folder_name, '(?i)(?:disc|cd|disk)\\s*(\\d+)', 1), ''), '') AS target_path FROM pr_5{t}),
    pr_7{t} AS (SELECT *, {tokens_sql('folder_name')} AS own_t, {tokens_sql('proposed_name')} AS want_t, CASE WHEN instr(proposed_name, ' - ') > 0 THEN {tokens_sql("substr(proposed_name, instr(proposed_name, ' - ') + 3)")} END AS rest_t FROM pr_6{t}),
    pr_8{t} AS (SELECT p.*, title_quality, filename_consistency, f.completeness, aa_consistency, (files - unreadable) * 1.0 / files AS tag_coverage, unreadable * 1.0 / files AS unreadable_ratio,
      CASE WHEN album_k IS NULL THEN CASE WHEN aa_share > 0 THEN 0.50 * 0.60 + aa_share * 0.40 ELSE 0.50 * 0.70 + artist_share * 0.30 END WHEN aa_share > 0 THEN album_share * 0.60 + aa_share * 0.40 ELSE album_share * 0.70 + artist_share * 0.30 END AS dominance,
      CASE WHEN lower(trim(folder_name)) = lower(trim(proposed_name)) THEN 1.0 WHEN len(want_t) = 0 OR len(own_t) = 0 THEN 0.5 ELSE greatest({covered('want_t', 'own_t')}, coalesce(CASE WHEN rest_t IS NOT NULL THEN {covered('rest_t', 'own_t')} END, 0.0)) END AS al FROM pr_7{t} p JOIN pf_factors f USING (folder_path)),
    pr_9{t} AS (SELECT *, CASE WHEN is_va AND forced THEN greatest(al, 0.5) ELSE al END AS folder_alignment FROM pr_8{t}),
    pr_s{t} AS (SELECT *, dominance * 0.40 + tag_coverage * 0.15 + title_quality * 0.12 + filename_consistency * 0.07 + completeness * 0.12 + aa_consistency * 0.06 + folder_alignment * 0.08 AS total FROM pr_9{t}),
    proposed{t} AS (SELECT folder_path, folder_name, files, album_k AS album_vote, album_share, aa_k AS aa_vote, aa_share, artist_k AS artist_vote, artist_share, is_va, va_rule, CASE WHEN is_crate THEN 'crate_' || crate_type WHEN is_va AND NOT is_mix THEN 'va' WHEN is_ep THEN 'ep' WHEN is_mix THEN 'mix' ELSE 'album' END AS folder_type,
      is_ep, is_crate, crate_type, album_k IS NULL AS used_heuristic, album_display, artist_display, year_picked, proposed_name, target_path, dominance, tag_coverage, title_quality, filename_consistency, completeness, aa_consistency, folder_alignment, unreadable_ratio,
      round(CASE WHEN is_crate THEN crate_score ELSE least(1.0, CASE WHEN album_k IS NULL THEN total * 0.60 ELSE total END) END + 1e-9, 6) AS confidence FROM pr_s{t} WHERE album_display <> '' AND artist_display <> '')"""
    return f"{first}, {second}" if first else second


PROPOSED_SQL = f"{RAW_SQL}, {proposals_ctes()}"


@query(f"WITH {PROPOSED_SQL} SELECT * FROM proposed")
def c01_folder_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Folders' proposals from end to end."""
    return proposals.propose(raw_files(spark, sf, heavy=True))


@query(
    f"""WITH {PROPOSED_SQL}, there AS (SELECT DISTINCT proposed_name AS name FROM proposed WHERE files = 5), o AS (SELECT *, row_number() OVER (PARTITION BY proposed_name ORDER BY folder_path) AS k, first_value(folder_path) OVER (PARTITION BY proposed_name ORDER BY folder_path) AS holder, proposed_name IN (SELECT name FROM there) AS known,
      confidence < 0.85 AS low, list_contains({_list(routing.GENERIC_NAMES)}, lower(trim(regexp_replace(trim(folder_name), '^[_ -]+|[_ -]+$', '', 'g')))) AS generic FROM proposed),
    p AS (SELECT *, CASE WHEN unreadable_ratio > 0.25 THEN 'review' WHEN k > 1 OR known THEN 'duplicate' WHEN low OR generic OR used_heuristic THEN 'review' ELSE 'clean' END AS place FROM o)
    SELECT folder_path, proposed_name, CASE WHEN is_crate THEN 'review' ELSE place END AS destination, CASE WHEN generic THEN least(confidence, 0.85 - 0.05) ELSE confidence END AS confidence,
      list_filter([CASE WHEN low THEN 'low_confidence' END, CASE WHEN generic THEN 'generic_folder_name' END, CASE WHEN k > 1 THEN 'duplicate_in_run:' || holder[:40] END, CASE WHEN known THEN 'already_in_clean' END, CASE WHEN unreadable_ratio > 0.25 THEN 'unreadable_ratio_high' END,
        CASE WHEN used_heuristic THEN 'heuristic_fallback' END, CASE WHEN is_ep THEN 'ep' END, CASE WHEN folder_type = 'mix' AND place = 'clean' THEN 'mix_folder' END, CASE WHEN is_crate THEN CASE WHEN crate_type = 'set' THEN 'djcrate_set' ELSE 'djcrate_singles' END END], lambda x: x IS NOT NULL) AS reasons FROM p"""
)
def c09_proposals_routed(spark: SparkSession, sf: str) -> DataFrame:
    """Folders' proposals from their tags to their destination, with all that a proposal says of itself: guesses, EPs, mixes, crates, unreadable files."""
    made = settled(proposals.propose(raw_files(spark, sf, heavy=True))).withColumn("is_mix", F.col("folder_type") == "mix")
    routed = routing.route(made, made.filter("files = 5").select(F.col("proposed_name").alias("name")))
    return routed.select("folder_path", "proposed_name", "destination", "confidence", "reasons")


@query(
    f"""WITH {PROPOSED_SQL}, parts AS (SELECT *, list_filter([CASE WHEN diversity * 0.35 > 0.15 THEN 'album_diversity(' || printf('%.2f', diversity) || ')' END, CASE WHEN poor_share * 0.20 > 0.10 THEN 'album_quality(' || printf('%.2f', poor_share) || ')' END, CASE WHEN loose * 0.15 > 0.07 THEN 'track_incoherence(' || printf('%.2f', loose) || ')' END,
      CASE WHEN word > 0 THEN 'folder_keyword_match' END, CASE WHEN unflagged * 0.15 > 0.10 THEN 'no_compilation_flags' END], lambda x: x IS NOT NULL) AS told FROM pf_crate)
    SELECT folder_path, crate_type, crate_score, CASE WHEN veto IS NOT NULL THEN veto WHEN crate_type = 'singles' THEN CASE WHEN len(told) > 0 THEN array_to_string(told, ', ') ELSE 'score_above_threshold' END ELSE 'score_below_threshold' END AS crate_reason FROM parts"""
)
def c04_crates(spark: SparkSession, sf: str) -> DataFrame:
    """Loose collections: vetoes, score and reasons."""
    return proposals.crate(proposals.tag_votes(raw_files(spark, sf))).select("folder_path", "crate_type", "crate_score", "crate_reason")


#: A user's patterns: sets, loose collections, vetoes learned from reviews, folders to ignore.
OWN_PATTERNS = [("set", "(?i)^[0-9]+ .*feat"), ("set", "Ox \\[")] + [("crate", "(?i)vol[.]? ?[0-9]"), ("crate", "Lee 1"), ("crate", "([")] + [("veto", "Ann Lee - 19[0-9][0-9]"), ("veto", "(?i)live|x9$")] + [("ignore", "Ann *3"), ("ignore", "[!A]*7"), ("ignore", "Mix (1999)")]
OWN_SQL = f"own AS (SELECT * FROM (VALUES {', '.join(f'({_q(k)}, {_q(p)})' for k, p in OWN_PATTERNS if p != '([')}) v(kind, pattern))"


@query(
    f"""WITH {PROPOSED_SQL}, {OWN_SQL}, said AS (SELECT folder_path, bool_or(kind = 'set') AS o_set, bool_or(kind = 'crate') AS o_crate, bool_or(kind = 'veto') AS o_veto FROM pf_loose JOIN own ON kind <> 'ignore' AND regexp_matches(folder_name, pattern) GROUP BY folder_path),
    w0 AS (SELECT * REPLACE (CASE WHEN o_crate THEN 1.0 ELSE word END AS word) FROM pf_loose LEFT JOIN said USING (folder_path)), w1 AS (SELECT *, diversity * 0.35 + poor_share * 0.20 + loose * 0.15 + word * 0.15 + unflagged * 0.15 AS score FROM w0),
    w2 AS (SELECT w1.* , CASE WHEN files < 3 THEN 'too_few_tracks' WHEN o_veto THEN 'learned_veto_pattern' WHEN o_set OR c.veto = 'set_prep_pattern_match' THEN 'set_prep_pattern_match' ELSE c.veto END AS veto FROM w1 JOIN (SELECT folder_path, veto FROM pf_veto) c USING (folder_path)),
    w3 AS (SELECT *, CASE WHEN veto = 'set_prep_pattern_match' THEN 'set' WHEN veto IS NULL AND round(score, 9) >= CASE WHEN coalesce(regexp_matches(album_k, {_q(N.LABEL_LIKE)}), false) THEN 0.85 ELSE 0.55 END THEN 'singles' END AS crate_type FROM w2)
    SELECT folder_path, crate_type, CASE WHEN veto = 'set_prep_pattern_match' THEN 0.9 WHEN veto IS NOT NULL THEN 0.0 ELSE round(score + 1e-9, 4) END AS crate_score, coalesce(veto, '-') AS veto FROM w3"""
)
def c04_own_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Loose collections with the user's own patterns: sets, keywords, learned vetoes."""
    own = spark.createDataFrame(OWN_PATTERNS, "kind string, pattern string")
    judged = proposals.crate(proposals.tag_votes(raw_files(spark, sf)), own=own)
    reason = F.col("crate_reason")
    veto = F.when(F.col("crate_type").eqNullSafe("singles") | (reason == "score_below_threshold"), "-").otherwise(reason)
    return judged.select("folder_path", "crate_type", "crate_score", veto.alias("veto"))


@query(f"WITH {RAW_SQL}, {OWN_SQL} SELECT DISTINCT folder_path, folder_name FROM v_raw WHERE NOT (folder_name = 'Mix (1999)' OR folder_name GLOB 'Ann *3' OR regexp_matches(folder_name, '^[^A].*7$'))")
def p02_not_ignored(spark: SparkSession, sf: str) -> DataFrame:
    """Folders that none of the user's names and globs leaves out."""
    own = spark.createDataFrame(OWN_PATTERNS, "kind string, pattern string")
    folders = settled(raw_files(spark, sf, heavy=True).select("folder_path", "folder_name").distinct())
    return patterns.without_ignored(folders, "folder_name", own)


@query(
    f"""WITH {PROPOSED_SQL}, {proposals_ctes(True, '_a')} SELECT coalesce(n.folder_path, a.folder_path) AS folder_path, n.folder_type, n.proposed_name, n.confidence, a.folder_type AS folder_type_as_album, a.proposed_name AS proposed_name_as_album, a.confidence AS confidence_as_album,
    CASE WHEN n.confidence IS NULL THEN 'new' WHEN a.confidence IS NULL THEN 'lost' WHEN n.proposed_name <> a.proposed_name THEN 'renamed' ELSE 'same' END AS change, coalesce(a.confidence >= 0.85 AND NOT coalesce(n.confidence >= 0.85, false), false) AS promoted
    FROM proposed n FULL JOIN proposed_a a ON n.folder_path = a.folder_path"""
)
def c28_what_if_album(spark: SparkSession, sf: str) -> DataFrame:
    """Every folder judged as it is and as one artist's album."""
    return proposals.what_if(raw_files(spark, sf, heavy=True))


EXPLAIN = ["dominance", "tag_coverage", "title_quality", "filename_consistency", "completeness", "aa_consistency", "folder_alignment"]
DECISIONS = ["folder_type", "va_rule", "artist_display", "album_display", "year_picked", "proposed_name", "target_path"]


@query(
    f"WITH {PROPOSED_SQL}, cut AS (SELECT * FROM proposed) "
    + " UNION ALL ".join(
        [f"SELECT folder_path, 'vote' AS section, '{f}' AS name, coalesce({f}_vote, '-') || ' ' || printf('%.4f', {f}_share) AS value FROM cut" for f in ("album", "aa", "artist")]
        + [f"SELECT folder_path, 'factor', '{f}', printf('%.4f', round({f}, 9)) FROM cut" for f in EXPLAIN]
        + [f"SELECT folder_path, 'decision', '{f}', coalesce(CAST({f} AS VARCHAR), '-') FROM cut" for f in DECISIONS]
    )
)
def c34_explained(spark: SparkSession, sf: str) -> DataFrame:
    """Votes, factors and decisions of every folder as rows."""
    return proposals.explain(proposals.propose(raw_files(spark, sf, heavy=True)))


# Duplicates: all files arrive again; the library holds the numbered ones, some folders of it in another format.

WORDS_SQL = lambda x: rf"list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '^\d+[.\-_\s]+', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')), ' ')), lambda w: w <> '')"
SIDES_SQL = f"""{RAW_SQL}, inc AS (SELECT folder_path AS pair, title, filename, ext, size FROM v_raw), exi AS (SELECT folder_path AS pair, title, CASE WHEN length(folder_name) % 4 = 0 THEN regexp_replace(filename, '[.][^.]*$', '.mp3') ELSE filename END AS filename, CASE WHEN length(folder_name) % 4 = 0 THEN '.mp3' ELSE ext END AS ext, size FROM v_raw WHERE track_number IS NOT NULL)"""
COMPARED_SQL = f"""{SIDES_SQL}, iw AS (SELECT DISTINCT pair, list_sort({WORDS_SQL('title')}) AS w FROM inc), ew AS (SELECT DISTINCT pair, list_sort({WORDS_SQL('title')}) AS w FROM exi),
  bw AS (SELECT iw.pair, iw.w, coalesce(max(len(list_intersect(iw.w, ew.w)) * 1.0 / len(list_distinct(list_concat(iw.w, ew.w)))), 0) >= 0.9 AS hit FROM iw LEFT JOIN ew ON iw.pair = ew.pair GROUP BY ALL), mt AS (SELECT pair, count_if(hit) AS matched, count_if(NOT hit) AS missing FROM bw GROUP BY pair),
  fi AS (SELECT pair, count(*) AS n, sum(size) AS b, list_sort(list(DISTINCT ext)) AS f, count(DISTINCT list_sort({WORDS_SQL('title')})) AS t FROM inc GROUP BY pair), fe AS (SELECT pair, count(*) AS n, sum(size) AS b, list_sort(list(DISTINCT ext)) AS f, count(DISTINCT list_sort({WORDS_SQL('title')})) AS t FROM exi GROUP BY pair),
  compared AS (SELECT mt.pair, CASE WHEN list_contains(fi.f, '.flac') AND NOT list_contains(fe.f, '.flac') AND matched >= greatest(1, fi.t - 1) THEN 'format_upgrade' WHEN list_contains(fe.f, '.flac') AND NOT list_contains(fi.f, '.flac') AND matched >= greatest(1, fi.t - 1) THEN 'lower_quality_mp3'
    WHEN missing = 0 AND fi.f = fe.f THEN CASE WHEN fe.b = 0 OR abs(fi.b - fe.b) * 1.0 / greatest(fe.b, 1) <= 0.01 THEN 'exact_duplicate' ELSE 'partial_overlap' END WHEN missing > 0 AND matched > 0 THEN 'missing_tracks' ELSE 'partial_overlap' END AS outcome,
    matched, missing, fe.t - matched AS unmatched_existing, array_to_string(fi.f, '|') AS incoming_formats, array_to_string(fe.f, '|') AS existing_formats, fi.n AS incoming_files, fe.n AS existing_files FROM mt JOIN fi USING (pair) JOIN fe USING (pair))"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = raw_files(spark, sf)
    other = F.length("folder_name") % 4 == 0
    pair = F.col("folder_path").alias("pair")
    incoming = files.select(pair, "title", "filename", "ext", "size")
    existing = files.filter("track_number IS NOT NULL").select(pair, "title", F.when(other, F.regexp_replace("filename", r"\.[^.]*$", ".mp3")).otherwise(F.col("filename")).alias("filename"), F.when(other, ".mp3").otherwise(F.col("ext")).alias("ext"), "size")
    return incoming, existing


@query(
    f"""WITH {COMPARED_SQL} SELECT *, CASE outcome WHEN 'missing_tracks' THEN 'merged' WHEN 'format_upgrade' THEN 'flac_upgrade' ELSE outcome END AS resolution, CASE outcome WHEN 'missing_tracks' THEN 'merged' WHEN 'format_upgrade' THEN 'clean' ELSE 'duplicate' END AS destination FROM compared"""
)
def c11_duplicate_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming folders against the library, and what becomes of them."""
    return library.resolve(library.compare_folders(*_sides(spark, sf)), flac_apart=True)


@query(
    f"""WITH {COMPARED_SQL}, lack AS (SELECT pair, w FROM bw WHERE NOT hit), asked AS (SELECT inc.*, list_sort({WORDS_SQL('title')}) AS w FROM inc JOIN compared USING (pair) WHERE outcome = 'missing_tracks'), there AS (SELECT DISTINCT pair, filename FROM exi)
    SELECT a.pair, a.title, a.filename, CASE WHEN t.filename IS NULL THEN a.filename ELSE regexp_replace(a.filename, '([.][^.]*)$', '_merged\\1') END AS final FROM asked a JOIN lack USING (pair, w) LEFT JOIN there t ON a.pair = t.pair AND a.filename = t.filename"""
)
def j26_missing_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks to merge into the folders that lack them."""
    incoming, existing = _sides(spark, sf)
    return library.merge_plan(incoming, existing, library.compare_folders(incoming, existing))


DIFFER = ["p_brand", "p_type", "p_size"]


@query(
    "WITH a AS (SELECT p_name AS name, min(p_brand) AS p_brand, min(p_type) AS p_type, min(p_size) AS p_size FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), b AS (SELECT p_name AS name, max(p_brand) AS p_brand, max(p_type) AS p_type, min(p_size) AS p_size FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1) "
    "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'common' END AS side, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL AND a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in DIFFER)
    + "], lambda x: x IS NOT NULL), '|') AS differ FROM a FULL JOIN b ON a.name = b.name"
)
def j10_folder_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Two folders' tracks side by side, with the tags that differ."""
    part = read(spark, sf, "part")
    a = part.filter("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("p_brand"), F.min("p_type").alias("p_type"), F.min("p_size").alias("p_size"))
    b = part.filter("p_partkey % 3 <> 1").groupBy(F.col("p_name").alias("name")).agg(F.max("p_brand").alias("p_brand"), F.max("p_type").alias("p_type"), F.min("p_size").alias("p_size"))
    return library.tag_differences(a, b, "name", DIFFER)


# Crates, dumps, renames

K_SQL = "CASE WHEN try_cast(regexp_extract(track_number, '^\\s*([0-9]+)', 1) AS INT) <> 0 THEN try_cast(regexp_extract(track_number, '^\\s*([0-9]+)', 1) AS INT) END"


@query(
    f"""WITH {RAW_SQL}, rel AS (SELECT folder_path, lower(trim(artist)) AS ak, lower(trim(album)) AS bk, count(*) AS n, count({K_SQL}) AS numbered, count(DISTINCT {K_SQL}) AS d, min({K_SQL}) AS lo, max({K_SQL}) AS hi, arg_min(trim(album), file_id) AS display FROM v_raw WHERE trim(artist) <> '' AND trim(album) <> '' GROUP BY ALL),
    kept AS (SELECT * FROM rel WHERE n >= 2 AND numbered = d AND numbered > 0 AND coalesce(hi - lo + 1 - d, 0) <= greatest(1, n // 4)),
    m AS (SELECT r.*, coalesce(trim(artist), '') AS a, coalesce(trim(title), '') AS t, {K_SQL} AS k, display FROM v_raw r LEFT JOIN kept ON kept.folder_path = r.folder_path AND ak = lower(trim(artist)) AND bk = lower(trim(album))),
    g AS (SELECT *, a <> '' AND NOT {garbage_sql('a')} AS ga, t <> '' AND NOT {garbage_sql('t')} AS gt, display IS NOT NULL AND k IS NOT NULL AS rel FROM m),
    s AS (SELECT *, round(least(1.0, CASE WHEN a <> '' THEN 0.30 ELSE 0 END + CASE WHEN t <> '' THEN 0.25 ELSE 0 END + CASE WHEN coalesce(genre, '') <> '' THEN 0.10 ELSE 0 END + CASE WHEN coalesce(year, '') <> '' THEN 0.05 ELSE 0 END + CASE WHEN coalesce(bpm, '') <> '' THEN 0.05 ELSE 0 END
      + CASE WHEN ga THEN 0.15 ELSE 0 END + CASE WHEN gt THEN 0.10 ELSE 0 END + CASE WHEN rel THEN 0.10 ELSE 0 END) + 1e-9, 4) AS c FROM g),
    e AS (SELECT *, CASE WHEN c >= 0.85 AND (rel OR (a <> '' AND t <> '')) THEN 'clean' ELSE 'review' END AS dest FROM s)
    SELECT file_id, dest AS destination, dest || '/' || CASE WHEN a <> '' THEN {display_sql('a')} ELSE '_Unsorted' END || '/' || CASE WHEN rel THEN {safe_sql('display')} ELSE 'Singles' END || '/' || CASE WHEN t = '' THEN filename WHEN rel THEN lpad(CAST(k AS VARCHAR), 2, '0') || ' - ' || {safe_sql('t')} || ext ELSE {safe_sql('t')} || ext END AS target_path, c AS confidence,
      CASE WHEN rel THEN 'embedded_release: ' || display ELSE coalesce(nullif(array_to_string(list_filter([CASE WHEN a = '' THEN 'no_artist' END, CASE WHEN t = '' THEN 'no_title' END, CASE WHEN NOT ga THEN 'noisy_artist' END, CASE WHEN NOT gt THEN 'noisy_title' END], lambda x: x IS NOT NULL), ', '), ''), 'ok') END AS reason, CASE WHEN rel THEN k END AS track_number FROM e"""
)
def c06_crate_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Where each track of a crate goes."""
    files = raw_files(spark, sf, heavy=True)
    found = classify.embedded_releases(files, ["folder_path"], F.col("artist"), F.col("album"), T.track_number(F.col("track_number")), least=2, shown=F.trim("album"))
    return library.crate_plan(files, found.select("folder_path", "artist_key", "album_key", "display"), to_review=False)


#: Titles that begin with an artist, and discs, for the guards of the rename plan.
LED_TITLE = "CASE WHEN size % 3000 = 0 THEN coalesce(artist, '') || ' - ' || title WHEN size % 5000 = 0 THEN coalesce(album_artist, '') || ' - ' || title ELSE title END"
DISC = "CASE WHEN size % 4000 = 0 THEN '2/2' ELSE '1' END"
LED_SQL = PROPOSED_SQL.replace(RAW_SQL, RAW_SQL.replace("v_raw AS (", "v_raw_0 AS (", 1) + f", v_raw AS (SELECT * REPLACE ({LED_TITLE} AS title), {DISC} AS disc_number FROM v_raw_0)", 1)


def rename_sql(guarded: bool = False) -> str:
    own, told = "lower(strip_accents(trim(who)))", "lower(strip_accents(cl))"
    gap = rf"regexp_extract(({told})[length({own}) + 1:], '^\s*-\s*', 0)"
    led = f"{own} <> '' AND starts_with({told}, {own}) AND {gap} <> '' AND length({own}) + length({gap}) < length({told})"
    cut = f"SELECT * EXCLUDE (cl), CASE WHEN {led} THEN coalesce(nullif(trim(cl[length({own}) + length({gap}) + 1:]), ''), cl) ELSE cl END AS cl FROM (SELECT *, coalesce(CASE kind WHEN 'album' THEN owner WHEN 'various' THEN a END, '') AS who FROM r1)"
    number = "CASE WHEN discs OR (tagk IS NULL AND fk >= 100 AND fk % 100 >= 1) THEN coalesce(CAST(coalesce(disc, CASE WHEN tagk IS NULL AND fk >= 100 AND fk % 100 >= 1 THEN fk // 100 END) AS VARCHAR) || '-', '') ELSE '' END" if guarded else "CASE WHEN tagk IS NULL AND fk >= 100 AND fk % 100 >= 1 THEN CAST(fk // 100 AS VARCHAR) || '-' ELSE '' END"
    disc = "try_cast(regexp_extract(disc_number, '^[0-9]+', 0) AS INT)" if guarded else "NULL"
    discs = f"(SELECT folder_path, count(DISTINCT {disc}) > 1 AS discs FROM v_raw GROUP BY folder_path)" if guarded else "(SELECT DISTINCT folder_path, false AS discs FROM v_raw)"
    return rf"""WITH {LED_SQL if guarded else PROPOSED_SQL}, kd AS (SELECT folder_path, discs, artist_display AS owner, CASE WHEN is_va THEN 'various' WHEN album_share < 0.75 THEN 'mixed' WHEN artist_share < 0.50 THEN CASE WHEN coalesce(aa_vote, '') <> '' AND starts_with(artist_vote, aa_vote) THEN 'album' ELSE 'various' END ELSE 'album' END AS kind FROM proposed JOIN {discs} USING (folder_path)),
    rs AS (SELECT file_id AS fid, folder_path, folder_name AS folder, regexp_replace(filename, '[.][^.]*$', '') AS stem FROM v_raw), {re.sub(r"[|]st_", "rn_", re.sub(r"(?<![a-z])st_", "|st_", stems_ctes('rs', 'fid'))).replace('stems AS', 'rstems AS')},
    r0 AS (SELECT r.file_id, r.folder_path, kind, owner, discs, {disc} AS disc, lower(ext) AS ext, {K_SQL} AS tagk, try_cast(regexp_extract(trim(filename), '^(\d{{1,3}})', 1) AS INT) AS fk, CASE WHEN length(trim(r.title)) >= 2 THEN trim(r.title) ELSE coalesce(s.title, trim(r.title)) END AS t, CASE WHEN length(trim(r.artist)) >= 2 THEN trim(r.artist) ELSE coalesce(s.artist, trim(r.artist)) END AS a0
      FROM v_raw r JOIN kd USING (folder_path) JOIN rstems s ON s.fid = r.file_id),
    r1 AS (SELECT *, {clean_title_sql('t')} AS cl, coalesce(tagk, CASE WHEN fk >= 100 AND fk % 100 >= 1 THEN fk % 100 ELSE fk END) AS n, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(a0, '(?i)\b(featuring|feat\.?|ft\.?)([\s,]|$)', 'feat.\2', 'g'), '\s{{2,}}', ' ', 'g'), '\s+$', '')), '') AS a FROM r0),
    r2 AS (SELECT *, regexp_extract(cl, {_q(BRACKET_MIX)}, 2) AS b, trim(regexp_extract(cl, {_q(DASH_MIX)}, 1)) AS d FROM ({cut})),
    r3 AS (SELECT *, b <> '' AND regexp_matches(b, {MIXES}) AS m1, d <> '' AND regexp_matches(d, {MIXES}) AND NOT contains(d, ',') AND length(d) <= 60 AS m2 FROM r2),
    r4 AS (SELECT *, CASE WHEN m1 THEN trim(regexp_replace(cl, {_q(BRACKET_MIX)}, '')) WHEN m2 THEN trim(regexp_replace(cl, {_q(DASH_MIX)}, '')) ELSE cl END AS bare, CASE WHEN m1 THEN ' ' || regexp_extract(cl, {_q(BRACKET_MIX)}, 1) WHEN m2 THEN ' (' || d || ')' ELSE '' END AS mix FROM r3),
    r5 AS (SELECT *, {clean_title_sql('bare')} AS tt FROM r4),
    r6 AS (SELECT *, CASE WHEN coalesce(cl, '') = '' THEN 'missing_title' WHEN coalesce(tt, '') = '' THEN 'title_cleaned_empty' WHEN kind <> 'album' AND a = '' THEN 'missing_artist' WHEN kind = 'album' AND n IS NULL THEN 'missing_track_number' WHEN kind = 'various' AND n IS NULL THEN 'ok_no_tracknum' ELSE 'ok' END AS reason, {number} AS prefix_ FROM r5),
    r7 AS (SELECT *, CASE WHEN starts_with(reason, 'ok') THEN {safe_sql("CASE WHEN kind = 'album' THEN prefix_ || lpad(CAST(n AS VARCHAR), 2, '0') || ' - ' || tt || mix || ext WHEN n IS NULL THEN a || ' - ' || tt || mix || ext ELSE prefix_ || lpad(CAST(n AS VARCHAR), 2, '0') || ' - ' || a || ' - ' || tt || mix || ext END")} END AS name,
      CASE WHEN NOT starts_with(reason, 'ok') THEN 0.0 WHEN kind = 'album' THEN 0.95 WHEN kind = 'mixed' THEN 0.90 WHEN n IS NULL THEN 0.85 ELSE 0.92 END AS confidence FROM r6),
    r8 AS (SELECT *, row_number() OVER (PARTITION BY folder_path, name ORDER BY file_id) AS k FROM r7)
    SELECT file_id, kind, CASE WHEN k > 1 AND name IS NOT NULL THEN regexp_replace(name, '(\.[^.]*)$', ' (' || CAST(k AS VARCHAR) || ')\1') ELSE name END AS new_name, confidence, reason FROM r8"""


@query(rename_sql())
def c29_track_renames(spark: SparkSession, sf: str) -> DataFrame:
    """New names of tracks by the kind of their folder."""
    files = raw_files(spark, sf)
    return library.rename_plan(files, proposals.propose(raw_files(spark, sf, heavy=True)).select("folder_path", "is_va", "album_share", "artist_share", "aa_vote", "artist_vote", "artist_display"))


@query(rename_sql(True))
def c29_guarded_renames(spark: SparkSession, sf: str) -> DataFrame:
    """New names of tracks whose titles begin with an artist, in folders of one disc and of several."""
    files, spread = (raw_files(spark, sf, heavy).withColumn("title", F.expr(LED_TITLE)).withColumn("disc_number", F.expr(DISC)) for heavy in (False, True))
    discs = files.groupBy("folder_path").agg((F.count_distinct(T.int_prefix(F.col("disc_number"))) > 1).alias("multi_disc"))
    made = proposals.propose(spread).join(discs, "folder_path")
    return library.rename_plan(files, made.select("folder_path", "is_va", "album_share", "artist_share", "aa_vote", "artist_vote", "artist_display", "multi_disc"))


@query(
    rf"""WITH {RAW_SQL}, ds AS (SELECT file_id AS fid, '' AS folder, regexp_replace(filename, '[.][^.]*$', '') AS stem FROM v_raw), {stems_ctes('ds', 'fid')},
    w AS (SELECT r.*, coalesce(nullif(trim(album_artist), ''), nullif(trim(r.artist), ''), {title_sql('dump_artist')}, '_Unknown') AS who, trim(regexp_replace(regexp_replace({fold_sql('lower(trim(album))', N.CLUSTER_TAILS)}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS alb FROM v_raw r JOIN stems s ON s.fid = r.file_id),
    k AS (SELECT *, array_to_string({KEY('who')}, '|') AS key_ FROM w), sp AS (SELECT key_, arg_min(who, (-n, who)) AS artist_ FROM (SELECT key_, who, count(*) AS n FROM k GROUP BY ALL) GROUP BY key_), al AS (SELECT key_, alb, count(*) AS together FROM k WHERE coalesce(alb, '') <> '' GROUP BY ALL),
    lib AS (SELECT DISTINCT {pick(['Ann Lee', 'x', 'Fox & The Ox'], 's_suppkey')} AS n FROM supplier), lb AS (SELECT artist_, bool_or({same_sql('artist_', 'n')}) AS there FROM (SELECT DISTINCT artist_ FROM sp), lib GROUP BY artist_)
    SELECT file_id, {safe_sql('artist_')} AS artist, CASE WHEN together >= 2 THEN {safe_sql("coalesce(trim(album), '')")} ELSE 'Singles' END AS place, coalesce(there, false) AS in_library, row_number() OVER (PARTITION BY k.key_, lower(title), size ORDER BY file_id) > 1 AS skipped
    FROM k JOIN sp USING (key_) LEFT JOIN al ON al.key_ = k.key_ AND al.alb = k.alb LEFT JOIN lb USING (artist_)"""
)
def c24_dump_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A dump sorted by artist and album."""
    names = read(spark, sf, "supplier").selectExpr(f"{pick(['Ann Lee', 'x', 'Fox & The Ox'], 's_suppkey')} AS name")
    return library.dump_plan(raw_files(spark, sf, heavy=True), names)


@query(
    rf"""WITH {RAW_SQL}, m AS (SELECT folder_path, file_id, trim(regexp_replace(artist, '(?i)\s+(?:feat\.?|ft\.?|featuring|&|and|vs\.?|x)\s+.*$', '')) AS main FROM v_raw WHERE artist <> ''), k AS (SELECT *, array_to_string({KEY('main')}, '|') AS artist_key FROM m)
    SELECT folder_path, artist_key, arg_min(main, file_id) AS artist, count(*) AS tracks, min(file_id) AS first_file FROM k GROUP BY ALL"""
)
def c25_split_by_artist(spark: SparkSession, sf: str) -> DataFrame:
    """A folder's files under their primary artists."""
    return library.split_by_artist(raw_files(spark, sf))


# Upkeep


@query(
    f"""WITH {RAW_SQL}, k AS (SELECT folder_path, {K_SQL} AS k FROM v_raw), f AS (SELECT folder_path, max(k) - min(k) + 1 - count(DISTINCT k) AS gaps, count(k) - count(DISTINCT k) AS repeats FROM k WHERE k IS NOT NULL GROUP BY folder_path)
    SELECT 'files' AS section, 'all' AS name, count(*) AS n FROM v_raw UNION ALL SELECT 'files', 'untagged', count_if(coalesce(nullif(title, ''), nullif(artist, ''), nullif(album, ''), nullif(album_artist, ''), nullif(genre, ''), nullif(year, '')) IS NULL) FROM v_raw
    UNION ALL SELECT 'formats', ext, count(*) FROM v_raw GROUP BY ext UNION ALL SELECT 'folders', 'gaps', count_if(gaps > 0) FROM f UNION ALL SELECT 'folders', 'repeats', count_if(repeats > 0) FROM f"""
)
def c27_library_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of a library."""
    return library.health(raw_files(spark, sf))


@query(
    rf"""WITH {RAW_SQL}, d AS (SELECT DISTINCT folder_path AS folder FROM v_raw), m AS (SELECT DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN 'gone/' || CAST(o_orderkey AS VARCHAR) ELSE folder_path END AS folder FROM (SELECT l_orderkey AS o_orderkey, min({FIELDS['folder_path']}) AS folder_path FROM lineitem GROUP BY l_orderkey)),
    e AS (SELECT 'lib/empty/' || c_name AS folder FROM customer)
    SELECT m.folder, 'missing_on_disk' AS issue, '' AS detail FROM m ANTI JOIN d USING (folder) UNION ALL SELECT d.folder, 'not_in_manifest', '' FROM d ANTI JOIN m USING (folder) UNION ALL SELECT DISTINCT e.folder, 'empty_folder', '' FROM e ANTI JOIN d USING (folder)
    UNION ALL SELECT folder_path, 'odd_file_names', CAST(count(*) AS VARCHAR) FROM v_raw WHERE NOT regexp_matches(filename, '^\d{{2,3}}\s*[-–]\s*.+\.\w+$') GROUP BY folder_path"""
)
def c26_library_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong in a library."""
    files = raw_files(spark, sf)
    by_order = read(spark, sf, "lineitem").selectExpr("l_orderkey", f"{FIELDS['folder_path']} AS folder_path").groupBy("l_orderkey").agg(F.min("folder_path").alias("folder_path"))
    manifest = by_order.select(F.when(F.col("l_orderkey") % 50 == 0, F.concat(F.lit("gone/"), F.col("l_orderkey").cast("string"))).otherwise(F.col("folder_path")).alias("name"))
    empty = read(spark, sf, "customer").select(F.concat(F.lit("lib/empty/"), "c_name").alias("folder"))
    return library.verify(files, manifest, empty)


@query(
    f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT name, unnest(['green small', 'Azure', 'part']) AS query FROM n), s AS (SELECT query, name, lower(trim(query)) AS a, lower(trim(name)) AS b FROM q), c AS (SELECT query, name, round({SIMILAR_SQL.format(a='a', b='b')} + 1e-9, 6) AS score FROM s)
    SELECT query, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS r FROM c WHERE score >= 0.3) WHERE r <= 20"""
)
def j14_library_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names most like a few queries."""
    return library.search(read(spark, sf, "part").select(F.col("p_name").alias("name")), ["green small", "Azure", "part"])


@query(
    """WITH a AS (SELECT s_name AS key, s_address AS value FROM supplier), b AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN upper(s_name) WHEN s_suppkey % 4 = 1 THEN s_name || ' x' ELSE s_name END AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'other' ELSE s_address END AS value FROM supplier)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.value IS NULL THEN 'mine' WHEN a.value IS NULL THEN 'add' WHEN a.value = b.value THEN 'skip' ELSE 'conflict' END AS action, coalesce(a.value, b.value) AS value FROM a FULL JOIN b ON lower(a.key) = lower(b.key)""".replace("s_address", "s_name")
)
def j24_reference_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two dictionaries merged."""
    s, k, n = read(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_name")
    other = s.select(F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(n, F.lit(" x"))).otherwise(n).alias("key"), F.when(k % 3 == 0, "other").otherwise(n).alias("value"))
    return library.merge_reference(s.select(n.alias("key"), n.alias("value")), other)


@query(
    f"""WITH {RAW_SQL}, {CONTEXT_SQL}, r AS (SELECT folder_name, context_score AS confidence, context_score < 0.5 AS low, structure_type = 'unknown' AS used_heuristic FROM v_context), t AS (SELECT count_if(low) AS low, count_if(used_heuristic) AS guessed FROM r),
    p AS (SELECT lower(unnest(regexp_extract_all(folder_name, '[\\(\\[]([^\\)\\]]+)[\\)\\]]', 1))) AS value FROM r), c AS (SELECT value, count(*) AS n FROM p WHERE value NOT IN ('', 'live') GROUP BY value HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 10)
    SELECT 'lower_threshold' AS kind, '0.80' AS value, low AS n FROM t WHERE low > 5 UNION ALL SELECT 'many_guesses', '', guessed FROM t WHERE guessed > 3 UNION ALL SELECT 'strip_phrase', value, n FROM c"""
)
def c22_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions for thresholds and phrases."""
    told = context.folder_context(raw_files(spark, sf))
    reasons = F.when(F.col("context_score") < 0.5, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    return library.tuning(told.select("folder_name", F.col("context_score").alias("confidence"), reasons.alias("reasons"), (F.col("structure_type") == "unknown").alias("used_heuristic")), known=("live",))
