"""Expressions that tidy and take apart names of artists, albums, titles, files and folders."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let, once
from .tags import squeeze, strip
from .text import CONNECTORS

# Patterns of the parts of names that are no name.
DISPLAY_NOISE = [
    r"(?i)\s*\[official\s+(?:audio|video|music\s+video)\]\s*$", r"(?i)\s*\(official\s+(?:audio|video|music\s+video)\)\s*$", r"(?i)\s*-\s*official\s+(?:audio|video|music\s+video)\s*$", r"(?i)\s*\[(?:hd|hq|4k|1080p|720p)\]\s*$",
    r"(?i)\s*\((?:lyrics?|lyric\s+video)\)\s*$", r"(?i)\s*\[(?:lyrics?|lyric\s+video)\]\s*$", r"(?i)\s*-\s*lyrics?\s*$",
]
DISC = [r"(?i)\s*[-–—:,]\s*(?:disc|cd|disk)\s*\d+\s*$", r"(?i)\s*\((?:disc|cd|disk)\s*\d+\)\s*$", r"(?i)\s*\[(?:disc|cd|disk)\s*\d+\]\s*$"]
BRACKET_KINDS = [
    ("year", r"^(19|20)\d{2}$"),
    ("promo", r"(?i)www\.|\.com|\.net|\.org|free\s+download|promo\s+only|for\s+promo|not\s+for\s+sale|leaked|rip|ripped|uploaded|download"),
    ("format", r"(?i)\b(mp3|flac|aac|ogg|wav|aiff|320|256|192|128|lossless|hi.?res|24.?bit|vinyl|vinyl.?rip|web|cd|dvd)\b"),
    ("edition", r"(?i)\b(deluxe|expanded|anniversary|remaster(ed)?|special|bonus|collector|limited|explicit|censored|edition|version|complete|extended|import|original)\b"),
    ("remix", r"(?i)\b(remix|edit|mix|rework|bootleg|mashup|vip|flip|dub|club|radio|instrumental|acapella|version)\b"),
    ("noise", r"(?i)^\s*(hd|hq|\d+k|\d+\s*hz|\d+\s*kbps|stereo|mono|clean|dirty)\s*$"),
]
LAST_BRACKET = r"\s*[\[\(]([^\[\]\(\)]*)[\]\)]\s*$"
DOMAINS = "com|net|org|info|biz|co|io|me|fm|tv|cc|us|uk|de|fr|es|it|nl|ru|br|mx|in|jp|cn|au|ca|ch|se|no|fi|dk|pl|cz"
TRAILING_DOMAINS = [
    rf"(?i)\s*[\(\[]\s*(https?:\/\/)?(www\.)?[\w\-]+(\.[\w\-]+)+\.({DOMAINS})\s*[\)\]]\s*$", rf"(?i)(\s*[-–—]\s*)?(https?:\/\/)?(www\.)?[\w\-]+(\.[\w\-]+)+\.({DOMAINS})\s*$", r"(?i)(\s*[-–—]\s*)?www\s*$",
]
GARBAGE_URL = rf"(?i)(^https?://)|(^www\.)|(\b[\w\-]+\.({DOMAINS})\b)"
KEY_NAMES = [
    "a", "ab", "am", "b", "bb", "bbm", "bm", "c", "cb", "cm", "d", "db", "dm", "dbm", "e", "eb", "ebm", "em", "f", "fb", "fm", "g", "gb", "gbm", "gm", "abm", "c#", "c#m", "d#", "d#m", "f#", "f#m", "g#", "g#m", "a#", "a#m", "smg",
]
TRAILING_PHRASES = ["official video", "official music video", "official audio", "lyrics", "lyric video", "visualizer", "audio", "hq", "hd", "4k", "free download", "download", "uploaded by", "ripped by"]
PROTECTED = ["live", "remaster", "edit", "mix", "version", "instrumental"]
MIX_WORDS = ["remix", "edit", "mix", "version", "rework", "bootleg", "dub", "original mix"]
LABEL_LIKE = r"(?i)\b(Records?|Discos?|Recordings?|Label|Music\s+Group|Inc\.?|Ltd\.?|Disques?)\b"
LABEL_TAIL = r"(?i)\s*(Records?|Recordings?|Music|Entertainment|Ltd\.?|Inc\.?|LLC)\s*$"
SMALL = ["a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "in", "of", "vs"]
SMALL_IN_NAMES = ["a", "an", "the", "and", "but", "or", "for", "at", "to", "by", "in", "of", "vs"]
SMALL_IN_LOWER = ["a", "an", "the", "and", "but", "or", "for", "nor", "of", "in", "on", "at", "to", "by", "up", "as", "vs", "via", "feat", "feat.", "ft.", "b/w", "vs."]
ALWAYS_UPPER = ["dj", "mc", "ep", "lp", "va", "uk", "us", "la", "nyc", "ny", "ii", "iii", "iv", "vi"]
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
CLUSTER_TAILS = [r"\s*[\[\(]\s*e\.?p\.?\s*[\]\)]\s*$", r"\s+e\.?p\.?\s*$", r"\s*[\[\(]\s*l\.?p\.?\s*[\]\)]\s*$", r"\s+l\.?p\.?\s*$"]
DJ_ENCODED = r"(?i)^\d{2,3}\s*bpm|^\d{2,3}\s*[-–]\s*[A-Ga-g][#b]?\s*(m|min|maj)?\s*[-–]"
STORE_MULTI = r"^(.+?)\s+-\s+(.+?,\s*.+?)(?:\s+\(([^)]+)\))?\s*$"
STORE_MIX = r"(?i)\s+(\([^)]+(?:mix|remix|edit|version|dub|instrumental|reprise|rework)[^)]*\))\s*$"
LONG_ID = r"[\s_]+\d{9,}(?:\s*[-–—]\s*\S[^-–—]*)?$"


def fold(value: Column, patterns: list[str], by: str = "") -> Column:
    """The patterns taken out one after another, trimmed each time."""
    return reduce(lambda text, p: strip(F.regexp_replace(text, p, by)), patterns, value)


def without_domains(value: Column) -> Column:
    """Addresses at the end taken out, trimmed; a text without a full stop and "www" has none."""
    return let(value, lambda text: F.when(text.contains(".") | F.lower(text).contains("www"), fold(text, TRAILING_DOMAINS)).otherwise(strip(text)))


def without_id(value: Column) -> Column:
    """Without a long id at the end."""
    return let(value, lambda text: F.when(text.rlike(r"\d{9}"), F.regexp_replace(text, LONG_ID, "")).otherwise(text))


def has_letters(w: Column) -> Column:
    return w.rlike(r"\p{L}")


def shouted(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def whispered(w: Column) -> Column:
    return (w == F.lower(w)) & (w != F.upper(w))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


@once
def title_case(c: Column) -> Column:
    """Title case for names all in capitals or all in small letters; others stay."""
    # A word with both cases, as most names have, is told by one test.
    return F.when(c.rlike("[A-Z][a-z]"), c).otherwise(let(words(c), lambda ws: _title_case(c, ws)))


def _title_case(c: Column, ws: Column) -> Column:
    lettered = F.filter(ws, has_letters)
    last = F.size(ws) - 1
    from_caps = F.transform(ws, lambda w, i: F.when((i == 0) | ~F.lower(w).isin(SMALL), capital(w)).otherwise(F.lower(w)))

    def from_small(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
        lead, tail = F.regexp_extract(w, r"^[^\p{L}\p{N}_]*", 0), F.regexp_extract(w, r"[^\p{L}\p{N}_]*$", 0)
        shown = F.when(core.isin(ALWAYS_UPPER), F.upper(core)).when((i == 0) | (i == last) | ~core.isin(SMALL_IN_LOWER), F.concat(F.upper(F.substring(core, 1, 1)), F.substring(core, F.lit(2), F.length(core)))).otherwise(core)
        return F.when(core == "", w).otherwise(F.concat(lead, shown, tail))

    caps = F.forall(F.filter(lettered, lambda w: F.length(w) > 1), shouted)
    return F.when(F.size(lettered) == 0, c).when(caps, F.array_join(from_caps, " ")).when(F.forall(lettered, whispered), F.array_join(F.transform(ws, from_small), " ")).otherwise(c)


#: Letters that Unicode composes of a letter and a mark: pairs, each after a bar, and what they make, in one order.
_COMPOSED = [(d, chr(n)) for n in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(n))) == 2 and unicodedata.normalize("NFC", d) == chr(n)]
_COMPOSED += [(b + d[-1], chr(n)) for n in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(n))) > 2 and len(b := unicodedata.normalize("NFC", d[:-1])) == 1 and unicodedata.normalize("NFC", d) == chr(n)]


@once
def nfc(c: Column) -> Column:
    """Letters and the marks that follow them put together (NFC), for marks in their canonical order."""
    pairs, made = F.lit("".join("|" + pair for pair, _ in _COMPOSED)), F.lit("".join(one for _, one in _COMPOSED))

    def step(done: Column, x: Column) -> Column:
        place = F.position(F.concat(F.lit("|"), F.right(done, F.lit(1)), x), pairs)
        joined = F.concat(F.substring(done, F.lit(1), F.length(done) - 1), F.substring(made, F.floor((place + 2) / 3).cast("int"), F.lit(1)))
        return F.when(x.rlike(r"\p{M}") & (place > 0), joined).otherwise(F.concat(done, x))

    return F.when(c.rlike(r"\p{M}"), F.aggregate(F.split(c, ""), F.lit(""), step)).otherwise(c)


@once
def artist_display(c: Column, alias: Column | None = None, the: str = "keep-front", letters: dict[str, str] | None = None) -> Column:
    """A name as it is shown: composed letters, the user's ``letters`` for others, case, alias (if there is one, it is
    all), connectors, hyphens, and where "The" goes."""
    c = nfc(c)
    for old, new in (letters or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    ws = words(strip(c))
    caps = F.forall(F.filter(ws, lambda w: F.length(w) > 2), shouted)
    from_caps = F.array_join(F.transform(ws, lambda w, i: F.when((i == 0) | ~F.lower(w).isin(SMALL_IN_NAMES), capital(w)).otherwise(F.lower(w))), " ")
    # A word of three characters or more with both cases, as most names have, is left as it is: told by one test.
    cased = F.when(c.rlike(r"[A-Z][a-z]\S"), strip(c)).otherwise(title_case(F.when(caps, from_caps).otherwise(strip(c))))
    joined = F.regexp_replace(strip(F.regexp_replace(cased, CONNECTORS, " & ")), r"\s*&\s*", " & ")
    plain = F.regexp_replace(joined, "[–—‐−]", "-")
    rest = F.regexp_extract(plain, r"^[Tt]he\s+(.+)$", 1)
    if the != "keep-front":
        plain = F.when(rest != "", F.concat(rest, F.lit(", The")) if the == "move-to-end" else rest).otherwise(plain)
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.coalesce(alias, plain) if alias is not None else plain)


@once
def artist_low(c: Column) -> Column:
    """A name in small letters, composed, its connectors made alike, without a leading "the"."""
    return F.regexp_replace(strip(F.regexp_replace(nfc(F.lower(strip(c))), CONNECTORS, " & ")), r"^the\s+", "")


@once
def artist_key(c: Column) -> Column:
    """Parts of a name, sorted, in small letters and without a leading "the": names of one artist have one key."""
    low = artist_low(c)
    return F.array_sort(F.filter(F.transform(F.split(low, r"\s*[,&]\s*"), strip), lambda p: p != ""))


def same_artist(a: Column, b: Column, least: float = 0.92) -> Column:
    """Whether two names are one artist's: equal keys, or nearly the same words."""
    low = artist_low
    x, y = F.array_distinct(words(low(a))), F.array_distinct(words(low(b)))
    near = (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= least * F.size(F.array_union(x, y)))
    return (low(a) == low(b)) | (artist_key(a) == artist_key(b)) | near


@once
def bracket_kind(c: Column) -> Column:
    t = strip(c)
    out = F.lit("unknown")
    for kind, p in reversed(BRACKET_KINDS):
        out = F.when(t.rlike(p), kind).otherwise(out)
    return out


@once
def without_brackets(c: Column, passes: int = 8) -> Column:
    """Brackets of noise, promotion and formats taken off the end, one at a time."""

    def step(text: Column, _: Column) -> Column:
        inner = F.regexp_extract(text, LAST_BRACKET, 1)
        return F.when(text.rlike(LAST_BRACKET) & bracket_kind(inner).isin("noise", "promo", "format"), strip(F.regexp_replace(text, LAST_BRACKET, ""))).otherwise(text)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), strip(c), step)


@once
def garbage(c: Column) -> Column:
    """Whether a tag's value is an address or a key and no name."""
    v = strip(c)
    address = (v.contains(".") | v.contains("://")) & v.rlike(GARBAGE_URL)  # no address is without them
    return F.coalesce(address | (F.lower(v).isin(KEY_NAMES) & (F.length(v) <= 4)), F.lit(False))


@once
def clean_title(c: Column, passes: int = 6) -> Column:
    """A title without underscores, addresses, handles, long ids and trailing phrases that say nothing, unless protected.

    Each part binds what it gets, and does nothing more where one test tells that there is nothing to take out."""
    phrases, keep = "(?i)" + "|".join(TRAILING_PHRASES), "(?i)" + "|".join(PROTECTED)
    ends = [r"\s*[\(\[]([^)\]]+)[\)\]]\s*$", r"\s*[-–—]\s*([^-–—]+)\s*$"]

    def step(text: Column, _: Column) -> Column:
        out = text
        for p in reversed(ends):
            inner = F.regexp_extract(text, p, 1)
            out = F.when((inner != "") & inner.rlike(phrases) & ~inner.rlike(keep), strip(F.regexp_replace(text, p, ""))).otherwise(out)
        return out

    def shown(text: Column) -> Column:
        small = F.filter(words(text), has_letters)
        return F.when(text.rlike("[A-Z]"), strip(text)).when((F.size(small) > 0) & F.forall(small, whispered), title_case(strip(text))).otherwise(strip(text))

    text = without_domains(F.replace(strip(c), F.lit("_"), F.lit(" ")))
    text = let(text, lambda t: F.when(t.contains("@"), F.regexp_replace(t, r"(\s*[-–—]\s*)?@[\w\.\-]+\s*$", "")).otherwise(t))
    text = let(strip(without_id(text)), lambda t: F.when(t.rlike(phrases), F.aggregate(F.sequence(F.lit(1), F.lit(passes)), t, step)).otherwise(t))
    return let(F.regexp_replace(strip(F.regexp_replace(squeeze(F.regexp_replace(text, r"\s+", " ")), r"[. ]+$", "")), r"\s*[-–—]+\s*$", ""), shown)


@once
def mix_suffix(c: Column) -> Column:
    """Struct (title, suffix): what a title says of its mix, in brackets."""
    some = "(?i)" + "|".join(MIX_WORDS)
    bracket, dash = r"\s*(\(([^)]+)\))\s*$", r"\s*[-–—]\s*([^-–—]+)\s*$"
    in_bracket, after = F.regexp_extract(c, bracket, 2), strip(F.regexp_extract(c, dash, 1))
    pair = lambda t, s: F.struct(t.alias("title"), s.alias("suffix"))
    return (
        F.when((in_bracket != "") & in_bracket.rlike(some), pair(strip(F.regexp_replace(c, bracket, "")), F.concat(F.lit(" "), F.regexp_extract(c, bracket, 1))))
        .when((after != "") & after.rlike(some) & ~after.contains(",") & (F.length(after) <= 60), pair(strip(F.regexp_replace(c, dash, "")), F.concat(F.lit(" ("), after, F.lit(")"))))
        .otherwise(pair(c, F.lit("")))
    )


def store_format(stem: Column, folder: Column) -> Column:
    """Whether a file's name has the form of a store's exports: title first, then artists."""
    title, artists = F.regexp_extract(stem, STORE_MULTI, 1), F.regexp_extract(stem, STORE_MULTI, 2)
    listed = stem.contains(",") & artists.contains(",") & ~title.contains(",") & ~title.rlike(r"^\d{1,3}[\s\-]")  # no artists are listed without a comma
    return (stem != F.ltrim(stem)) | F.lower(folder).rlike("^(beatport|traxsource)") | listed


@once
def store_parts(stem: Column) -> Column:
    """Struct (artist, title, mix) of a store's file name "Title - Artist, Artist (Mix)"; the first artist stays."""
    mix = F.regexp_extract(strip(stem), STORE_MIX, 1)
    rest = strip(F.regexp_replace(strip(stem), STORE_MIX, ""))
    title, artists = F.regexp_extract(rest, r"^(.*?)\s+-\s+(.*)$", 1), F.regexp_extract(rest, r"^(.*?)\s+-\s+(.*)$", 2)
    return F.struct(
        F.when(title == "", rest).otherwise(strip(F.substring_index(artists, ",", 1))).alias("artist"), strip(title).alias("title"), F.when(mix != "", F.concat(F.lit(" "), mix)).otherwise("").alias("mix")
    )


def file_parts(stem: Column, folder: Column) -> Column:
    """Struct (artist, title) that a file's name gives; nulls where it gives none."""
    return let(F.struct(stem.alias("stem"), folder.alias("folder")), lambda x: _file_parts(x["stem"], x["folder"]))


def _file_parts(stem: Column, folder: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.ltrim(stem), r"^\d-\d{2}\s+", ""), r"^[A-Da-d]\d{1,2}\s*[-–—]?\s+", "")
    return let(F.regexp_replace(strip(bare), r"\s+", " "), lambda b: _parts_of(stem, folder, b))


def _parts_of(stem: Column, folder: Column, bare: Column) -> Column:
    s = F.regexp_replace(F.replace(F.replace(bare, F.lit("_-_"), F.lit(" - ")), F.lit("_"), F.lit(" ")), r"\s+", " ")
    encoded = bare.rlike(DJ_ENCODED)
    s = F.regexp_replace(strip(without_id(strip(s))), r"^[\[\(][^\]\)]+[\]\)]\s*", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\(?\d{1,3}\)?\s*[-–—\.]\s*", ""), r"^\d{1,3}\s+", "")
    cut = lambda text, p: F.filter(F.transform(F.split(text, p), strip), lambda x: x != "")
    spaced = lambda text: let(cut(text, r"\s+[-–—]\s+"), lambda x: F.when(F.size(x) >= 2, x).otherwise(cut(text, r"\s*[-–—]\s*")))
    group = lambda x: F.element_at(x, -1)
    more = lambda x: F.when((F.size(x) >= 3) & group(x).rlike("^[a-z]{2,5}$") & ~group(x).isin("mix", "rmx", "vip", "dub", "edit", "live", "demo", "ost", "dj", "va", "lp"), F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    pair = lambda a, t: F.struct(a.cast("string").alias("artist"), t.cast("string").alias("title"))
    none = F.lit(None)
    named = let(let(let(s, spaced), more), lambda x: F.when(F.size(x) >= 2, pair(F.get(x, F.lit(0)), F.array_join(F.slice(x, 2, F.size(x)), " - "))).when(F.size(x) == 1, pair(none, F.get(x, F.lit(0)))).otherwise(pair(none, none)))
    store = let(store_parts(stem), lambda x: F.when((x["artist"] != "") & (x["title"] != ""), pair(x["artist"], x["title"])))
    return F.coalesce(F.when(store_format(stem, folder), store), F.when(encoded, pair(none, none)), named)


@once
def dump_stem(stem: Column) -> Column:
    """A file's name from a dump folder without leading brackets and numbers; keys on the wheel stay."""
    s = squeeze(F.replace(fold(stem, [r"^\[.*?\]\s*", r"^\(.*?\)\s*"]), F.lit("_"), F.lit(" ")))
    keyed = s.rlike(r"^(1[0-2]|[1-9])[ABabdDmM]\s*[-–.\s]")
    s = F.when(keyed, strip(F.regexp_replace(s, r"^\d{1,3}[\s.\-]+(\d)", "$1"))).otherwise(strip(F.regexp_replace(s, r"^\d{1,3}[a-zA-Z]?[\s.\-]+", "")))
    s = strip(F.regexp_replace(s, r"^[A-Z]\d{1,2}[\s.\-]+([A-Z])", "$1"))
    return strip(F.regexp_replace(strip(F.regexp_replace(s, r"[-–]\s*[-–]", "-")), r"^\s*[-–]\s*", ""))


@once
def dump_artist(stem: Column) -> Column:
    """The artist that a dump file's name begins with; null if none."""
    three, two = r"^(.+?)\s*[-–]\s*(.+?)\s*[-–]\s*(.+)$", r"^(.+?)\s*[-–]\s*(.+)$"
    first, second = strip(F.regexp_extract(stem, three, 1)), strip(F.regexp_extract(stem, three, 2))
    code = (F.length(first) <= 3) & first.rlike(r"^\d+[a-zA-Z]?$")
    fits = lambda c: (F.length(c) > 1) & ~c.rlike(r"^\d+$")
    chosen, lone = F.when(code, second).otherwise(first), strip(F.regexp_extract(stem, two, 1))
    return F.when(stem.rlike(three) & fits(chosen), chosen).when(stem.rlike(two) & fits(lone), lone)


def decade(year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))).otherwise("")


@once
def label_name(c: Column, passes: int = 3) -> Column:
    return F.coalesce(fold(strip(c), [LABEL_TAIL] * passes), F.lit(""))


@once
def safe_name(c: Column, instead: str = " - ") -> Column:
    """A name that every file system takes."""
    text = F.regexp_replace(F.regexp_replace(c, r"[\/\\]", " "), r'[\:\*\?\"\<\>\|]', instead)
    return strip(F.regexp_replace(strip(F.regexp_replace(text, r"\s+", " ")), r"[. ]+$", ""))


@once
def unreserved(c: Column) -> Column:
    stem = F.upper(F.when(c.rlike(r"^.+\.[^.]+$"), F.regexp_replace(c, r"\.[^.]+$", "")).otherwise(c))
    return F.when(stem.isin(RESERVED), F.concat(c, F.lit("_"))).otherwise(c)


@once
def slug(c: Column, most: int = 24) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s-]", ""), r"[\s_]+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(text, "-+", "-"), "^-+|-+$", ""), 1, most)


@once
def cluster_key(album: Column) -> Column:
    text = fold(F.lower(strip(album)), CLUSTER_TAILS)
    return F.coalesce(F.regexp_replace(strip(F.regexp_replace(text, r"(?U)[^\w\s]", "")), r"\s+", " "), F.lit(""))


def unknown_album(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("", "unknown album", "untitled"), F.lit(True))


@F.pandas_udf(StringType())
def _plain_letters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


@F.pandas_udf(StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t), na_action="ignore")


def ascii_fold(c: Column) -> Column:
    """Without accents. ASCII texts are told by a test and do not leave the JVM's expression."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_plain_letters(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def composed(c: Column) -> Column:
    """Unicode normal form C."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_composed(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))
