"""Expressions over raw tag values: noise, tempo, key, featured artists, encoding repair, spelling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import digits, let, once

# Fixed values: (pattern, category, confidence), by field.
NOISE = {
    "title": [
        (r"\s*\[Official\s*(?:Audio|Video|Music\s*Video)\]", "youtube", 0.99),
        (r"\s*\((?:Official\s*)?(?:Audio|Video|Lyric\s*Video)\)", "youtube", 0.99),
        (r"\s*\[(?:FREE?\s*(?:DL|DOWNLOAD|D/L))\]", "promo", 0.98),
        (r"\s*\((?:FREE?\s*(?:DL|DOWNLOAD|D/L))\)", "promo", 0.98),
        (r"\s*[-–]\s*(?:FREE?\s*(?:DL|DOWNLOAD))", "promo", 0.97),
        (r"\s*(?:OUT NOW|BUY (?:NOW|LINK))", "promo", 0.97),
        (r"\s*\[(?:FLAC|MP3|WAV|AIFF|320(?:kbps)?|HQ|HD)\]", "format", 0.98),
        (r"\s*\((?:FLAC|MP3|WAV|AIFF|320(?:kbps)?|HQ|HD)\)", "format", 0.98),
        (r"\s*\[(?:hd|hq|4k|1080p|720p)\]", "quality", 0.97),
        (r"\s*\((?:lyrics?|lyric\s+video)\)", "youtube", 0.97),
        (r"\s*\[(?:lyrics?|lyric\s+video)\]", "youtube", 0.97),
        (r"\s*-\s*lyrics?\s*$", "youtube", 0.95),
    ],
    "artist": [
        (r"\s*\d{2,3}\s*[Bb][Pp][Mm]", "bpm_in_artist", 0.95),
        (r"\s*\b\d{1,2}[AaBb]\b", "key_in_artist", 0.85),
        (r"\s*\[(?:FLAC|MP3|320)\]", "format_in_artist", 0.98),
    ],
    "comment": [
        (r"(?:bpm\s*supreme|dj\s*city|zip\s*dj|djcity|club\s*killers)", "pool_tag", 0.95),
        (r"(?:digital\s*dj\s*pool|late\s*night\s*record\s*pool)", "pool_tag", 0.95),
        (r"for\s+promotional\s+use\s+only", "promo", 0.98),
        (r"not\s+for\s+(?:re)?sale", "promo", 0.97),
        (r"purchased?\s+(?:at|from|on)\s+", "purchase", 0.90),
        (r"downloaded?\s+(?:from|via)\s+", "purchase", 0.90),
        (r"https?://\S+", "url", 0.85),
        (r"www\.\S+", "url", 0.85),
        (r"[\w.+-]+@[\w-]+\.[\w.-]+", "email", 0.95),
        (r"(?:©|\(c\))\s*\d{4}", "copyright", 0.80),
        (r"(?:encoded|ripped|converted)\s+(?:by|with|using)\s+", "encoder", 0.90),
        (r"LAME\s*[\d.]+", "encoder", 0.95),
    ],
    "album": [
        (r"\s*\[(?:FLAC|MP3|WAV|320)\]", "format_in_album", 0.98),
        (r"\s*\((?:FLAC|MP3|WAV|320)\)", "format_in_album", 0.98),
    ],
    "filename": [
        (r"(?:www\.[\w.-]+\.\w{2,4})", "url_in_filename", 0.95),
        (r"(?:https?://\S+)", "url_in_filename", 0.95),
        (r"youtube_[A-Za-z0-9_-]{11}_audio", "youtube_download", 0.98),
        (r"\[_?YouConvert\.net_?\]", "converter_tag", 0.98),
        (r"\[_?(?:yt1s|savefrom|y2mate|mp3juices).*?\]", "converter_tag", 0.97),
    ],
}

# Fixed values: (pattern, confidence) of tempi, and (pattern, notation, confidence) of keys.
TEMPO = [(r"(\d{2,3})\s*bpm", 0.95), (r"bpm\s*[:=]?\s*(\d{2,3})", 0.92), (r"\b(\d{2,3})\s*bpm\b", 0.90)]
KEYS = [
    (r"\b(\d{1,2}[AaBb])\b", "camelot", 0.95),
    (r"(?:^|[^\w])[Kk]ey\s*[:=]?\s*([A-G][#b]?m?)(?:$|[^\w])", "musical_explicit", 0.90),
    (r"\b([A-G][#b]?\s*(?:min(?:or)?|maj(?:or)?))\b", "musical_full", 0.88),
    (r"(?:^|[^A-Za-z])([A-G][#b]?m)(?:$|[^A-Za-z])", "musical_short", 0.60),
]

#: What every pattern of keys needs: a digit and a wheel letter, the word, or a note and an m.
KEY_SIGN = r"\d[AaBb]\b|[Kk]ey|[A-G][#b]?\s*m"

# Misread letters and the letters they stand for.
MISREAD = {
    "Ã¶": "ö", "Ã¤": "ä", "Ã¼": "ü", "Ã©": "é", "Ã\xad": "í", "Ã±": "ñ", "Ã³": "ó", "Ã¡": "á", "Ã ": "à", "Ã¢": "â", "Ã§": "ç", "Ã¨": "è", "Ã®": "î", "Ã´": "ô", "Ã¹": "ù", "Ã»": "û",
    "â\u0080\u0099": "’", "â\u0080\u009c": "“", "â\u0080\u009d": "”", "â\u0080\u0094": "—", "â\u0080\u0093": "–", "â\u0080¢": "•",
}

# Risk of a kind of fix; kinds not named are moderate.
RISK = {
    "noise_removal": "safe", "whitespace": "safe", "comment_cleanup": "safe", "original_mix_strip": "safe", "feat_normalize": "safe", "filename_noise_flag": "safe", "artist_mismatch_flag": "safe",
    "fill_album_artist": "moderate", "bpm_extraction": "moderate", "bpm_cleanup": "moderate", "key_extraction": "moderate", "key_prefix_strip": "moderate", "genre_normalize": "moderate", "fill_from_folder": "moderate",
    "artist_normalize": "destructive", "encoding_repair": "destructive", "id3_upgrade": "destructive",
}

# Names in capitals, and small words.
ACRONYMS = ["DJ", "MC", "VA", "XRS", "MF", "DMX", "BPM", "RZA", "GZA", "ODB", "RJD2", "MPC", "KRS", "DMC", "FX", "AK", "JB"]
SMALL_WORDS = ["of", "the", "in", "on", "at", "to", "for", "and", "vs"]

# Where files come from: patterns of the comment, of the encoder and of the file name.
ORIGINS = {
    "beatport": ([r"beatport", r"purchased?\s+at\s+beatport"], [], [r"^\d{7,}_"]),
    "bandcamp": ([r"bandcamp"], [], [r"^[\w\s]+ - [\w\s]+\.flac$"]),
    "itunes": ([r"itunes"], [r"iTunes\s"], [r"^\d{2}\s"]),
    "djcity": ([r"dj\s*city"], [], [r"\b(?:clean|dirty|intro|short)\b"]),
    "bpm_supreme": ([r"bpm\s*supreme"], [], []),
    "soundcloud": ([r"soundcloud"], [r"yt-?dlp", r"youtube-?dl"], [r"[\w-]{11,}"]),
}

FEATURING = r"(?i)\s*[\(\[]?\s*(?:feat\.?|ft\.?|featuring|with)\s+.*$"
ORIGINAL_MIX = r"(?i)\s*[-–—]\s*(?:Original(?:\s+Mix)?)\s*$|\s*\(Original(?:\s+Mix)?\)\s*$"
KEY_PREFIX = r"^(\d{1,2}[AaBb])\s*[-–—]\s*(.+)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """One space for a run of them, none at the ends."""
    return strip(F.regexp_replace(c, r"\s{2,}", " "))


#: What `squeeze` changes, and nothing else.
UNSQUEEZED = r"^\s|\s$|\s{2}"


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded sums that end in a five go up, whatever their last bits are."""
    return F.round(c + 1e-9, digits)


def literal(pattern: str) -> str:
    """The longest text outside groups and classes that every match of an expression contains, in small letters; empty if
    there is none. A search for it tells most texts that cannot match without running the expression."""
    runs, run, depth, k = [], "", 0, 0
    while k < len(pattern):
        c, k = pattern[k], k + 1
        own = ""
        if c == "\\":
            own, k = ("" if pattern[k].isalnum() else pattern[k]), k + 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c in "?*{":
            run = run[:-1]  # the character before may be missing
            k = pattern.index("}", k) + 1 if c == "{" else k
        elif c == "|" and not depth:
            return ""
        elif c not in ".^$+|":
            own = c
        if own and not depth:
            run += own
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len).lower()


def noisy(field: str, value: Column) -> Column:
    """Whether a field's value has any noise: one search for all patterns. What they skip before a text decides nothing."""
    return F.coalesce(value.rlike("(?i)" + "|".join(re.sub(r"^\\s\*", "", p) for p, _, _ in NOISE[field])), F.lit(False))


def noise(field: str, value: Column) -> Column:
    """All noise in a field's value: structs (category, matched, confidence), in the order of the patterns."""
    none = F.array().cast("array<struct<category:string,matched:string,confidence:double>>")

    def found(text: Column, low: Column) -> Column:
        hits = []
        for p, c, w in NOISE[field]:
            hit, sign = F.struct(F.lit(c).alias("category"), strip(F.regexp_extract(text, "(?i)" + p, 0)).alias("matched"), F.lit(w).alias("confidence")), literal(p)
            hits.append(F.when(low.contains(sign), hit) if sign else hit)
        return F.filter(F.array(*hits), lambda h: h["matched"] != "")

    return let(value, lambda text: F.when(noisy(field, text), let(F.lower(text), lambda low: found(text, low))).otherwise(none))


def without_noise(field: str, value: Column) -> Column:
    """The value with every matched text taken out."""
    return squeeze(F.aggregate(noise(field, value), value, lambda text, hit: strip(F.replace(text, hit["matched"], F.lit("")))))


@once
def tempo(value: Column) -> Column:
    """Struct (bpm, confidence, matched) of the first pattern with a tempo from 50 to 220; null if there is none."""
    tries = []
    for p, w in TEMPO:
        n = digits(F.regexp_extract(value, "(?i)" + p, 1))
        tries.append(F.when(n.between(50, 220), F.struct(n.alias("bpm"), F.lit(w).alias("confidence"), F.regexp_extract(value, "(?i)" + p, 0).alias("matched"))))
    return F.when(F.lower(value).contains("bpm"), F.coalesce(*tries))


@once
def musical_key(value: Column) -> Column:
    """Struct (key, notation, confidence) of the first pattern that names a key; wheel numbers go from 1 to 12."""
    tries = []
    for p, notation, w in KEYS:
        k = strip(F.regexp_extract(value, p, 1))
        fits = (k != "") if notation != "camelot" else digits(F.regexp_extract(k, r"^\d+", 0)).between(1, 12)
        tries.append(F.when(fits, F.struct(k.alias("key"), F.lit(notation).alias("notation"), F.lit(w).alias("confidence"))))
    return F.when(value.rlike(KEY_SIGN), F.coalesce(*tries))


@once
def key_prefix(artist: Column) -> Column:
    """Struct (key, artist) of an artist led by a wheel key; null if there is none."""
    k, rest = F.upper(F.regexp_extract(strip(artist), KEY_PREFIX, 1)), strip(F.regexp_extract(strip(artist), KEY_PREFIX, 2))
    fits = digits(F.regexp_extract(k, r"^\d+", 0)).between(1, 12) & (rest != "")
    return F.when(artist.rlike(r"^\s*\d{1,2}[AaBb]\s*[-–—]"), F.when(fits, F.struct(k.alias("key"), rest.alias("artist"))))


def primary(artist: Column) -> Column:
    """The artist without those featured."""
    return strip(F.regexp_replace(artist, FEATURING, ""))


@once
def repaired(value: Column) -> Column:
    """Struct (text, confidence) of a misencoded text put right: by letters, or by reading its bytes as UTF-8.

    ASCII texts, which are most, are told by one test.
    """
    text = value
    for bad, good in MISREAD.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    latin = value.rlike("^[\\x00-\\xFF]*$") & value.rlike("[\\x80-\\xFF]")
    again = F.when(latin, F.encode(value, "ISO-8859-1").cast("string"))
    read = F.when(F.is_valid_utf8(again) & (again != value) & ~again.contains("�") & ~again.contains("\x00"), again)
    found = F.when(text != value, F.struct(text.alias("text"), F.lit(0.92).alias("confidence"))).when(read.isNotNull(), F.struct(read.alias("text"), F.lit(0.85).alias("confidence")))
    return F.when(F.octet_length(value) > F.length(value), found)


@once
def spelling(name: Column) -> Column:
    """How well spelled a name looks: case of its words, and how its parts are joined."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    first = lambda w: F.substring(w, 1, 1)
    capital = lambda w: (first(w) == F.upper(first(w))) & (first(w) != F.lower(first(w)))
    rest_upper = lambda w: (F.length(w) > 1) & (F.substring(w, F.lit(2), F.length(w)) == F.upper(F.substring(w, F.lit(2), F.length(w)))) & F.substring(w, F.lit(2), F.length(w)).rlike("[A-Za-z]")
    known = lambda w: F.upper(w).isin(ACRONYMS)
    points = lambda w: (
        F.when(known(w), F.when(w == F.upper(w), 1.5).when(capital(w) & ~rest_upper(w), -0.5).otherwise(0.0)).when(capital(w), 0.0).when(F.lower(w).isin(SMALL_WORDS), 0.1).otherwise(0.0)
    )
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + points(w))
    titled = F.size(F.filter(words, lambda w: ~known(w) & capital(w)))
    score = (
        total
        + F.when(name == F.lower(name), -3.0).otherwise(0.0)
        + F.when((name == F.upper(name)) & (F.size(words) > 1), -2.0).otherwise(0.0)
        + F.when(2 * titled >= F.size(words), 1.0).otherwise(0.0)
        + F.when(name.contains(" & "), 0.5).otherwise(0.0)
        + F.when(name.rlike(r"(?i)\band\b"), -0.3).otherwise(0.0)
        + F.when(name.contains(" And "), -0.5).otherwise(0.0)
    )
    return F.when(F.size(words) == 0, 0.0).otherwise(rounded(score))


def origins(comment: Column, encoder: Column, filename: Column) -> Column:
    """Structs (source, score) of where a file may come from: 0.4 for each sign in the comment, 0.3 in the encoder, 0.2
    in the file name; kept above 0.15, at most 1."""
    found = []
    for source, signs in ORIGINS.items():
        score = F.lit(0.0)
        for value, patterns, weight in zip((comment, encoder, filename), signs, (0.4, 0.3, 0.2), strict=True):
            for p in patterns:
                score = score + F.when(F.coalesce(value, F.lit("")).rlike("(?i)" + p), weight).otherwise(0.0)
        found.append(F.struct(F.lit(source).alias("source"), F.least(rounded(score), F.lit(1.0)).alias("score")))
    return F.filter(F.array(*found), lambda x: x["score"] > 0.15)


def risk(fix_type: Column) -> Column:
    out = F.lit("moderate")
    for tier in ("safe", "destructive"):
        out = F.when(fix_type.isin([k for k, v in RISK.items() if v == tier]), tier).otherwise(out)
    return out
