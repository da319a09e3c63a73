"""Names against documented pairs and cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sleevenotes.functions import names as N
from sleevenotes.functions import tags as G
from sleevenotes.functions import text as T
from sleevenotes.operators import library, naming, quality


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x string").select("i", make(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


FOLDERS = {
    "Anka Foh - 2021 - Koundary ( FLAC )": ("Anka Foh - 2021 - Koundary", None),
    "2010 - R\u00edo Arriba (2010)": ("2010- R\u00edo Arriba", "2010"),
    "aukai.  [2016] aukai": ("aukai. - aukai", "2016"),
    "Tinariwen--Alkhar_Dessouf_Remix-WEB-2022-OMA": ("Tinariwen - Alkhar Dessouf Remix", None),
    "Tropical Twista Records - 2024 - Cigarra - Limbica": ("Cigarra - 2024 - Limbica", "2024"),
}


def test_folder_names(spark):
    rows = spark.createDataFrame([(k,) for k in FOLDERS] + [(None,), ("",)], "name string")
    got = {r["name"]: (r["clean_name"], r["name_year"]) for r in naming.clean_folders(rows, "name").collect()}
    assert {k: got[k] for k in FOLDERS} == FOLDERS and got[None] == (None, None) and got[""][0] == ""


def test_wheel_follows_the_circle_of_fifths(spark):
    keys = {"C": "8B", "Am": "8A", "G major": "9B", "e minor": "9A", "F#": "2B", "Gb": "2B", "G#m": "1A", "Abm": "1A", "B": "1B", "Cb": "1B", "C#": "3B", "bb": "6B", "Bbm": "3A", "D min": "7A", "E#": "", "Cbm": "", "H": "", "": "", "A m": ""}
    assert column(spark, list(keys), T.camelot) == list(keys.values())


@pytest.mark.parametrize("value, expected", [("ANN OF THE LEE", "Ann of the Lee"), ("ann and the dj", "Ann and the DJ"), ("Mixed case Stays", "Mixed case Stays"), ("123 !", "123 !"), ("\u00e9lan vital", "\u00c9lan Vital"), (None, None)])
def test_title_case(spark, value, expected):
    assert column(spark, [value], N.title_case) == [expected]


def test_tag_expressions(spark):
    assert column(spark, ["Song 128 BPM", "bpm: 300", "bpm 95", "x", None], lambda c: G.tempo(c)["bpm"]) == [128, None, 95, None, None]
    assert column(spark, ["10B - Ann", "13A - Ann", "Ann", None], lambda c: G.key_prefix(c)["artist"]) == ["Ann", None, None, None]
    assert column(spark, ["Caf\u00c3\u00a9", "Caf\u00e9", "plain", None], lambda c: G.repaired(c)["text"]) == ["Caf\u00e9", None, None, None]
    assert column(spark, ["Ann Lee", "ann lee", "ANN LEE", "DJ Ann", ""], G.spelling) == [1.0, -3.0, -1.0, 2.5, 0.0]


def test_a_number_out_of_all_reason_makes_no_large_array(spark):
    rows = spark.createDataFrame([("f", 1), ("f", 3), ("f", 999_999_999), ("g", 2), ("g", 2)], "folder_path string, k int")
    got = {r["folder_path"]: r for r in quality.numbers(rows, ["folder_path"], F.col("k")).collect()}
    assert got["f"]["gap_count"] == 999_999_996 and got["f"]["gaps"] == ["2-2", "4-999999998"]
    assert got["g"]["repeats"] == [2] and got["g"]["gap_count"] == 0


def test_duplicate_outcomes(spark):
    inc = [("a", "One", ".flac", 10), ("b", "One", ".mp3", 10), ("b", "Two", ".mp3", 10), ("c", "One", ".mp3", 100), ("d", "One", ".mp3", 100), ("e", "x", ".mp3", 1)]
    exi = [("a", "One", ".mp3", 10), ("b", "One", ".mp3", 10), ("c", "01 one", ".mp3", 100), ("d", "One", ".mp3", 10), ("e", "y", ".mp3", 1), ("z", "y", ".mp3", 1)]
    schema = "pair string, title string, ext string, size long"
    got = {r["pair"]: r["outcome"] for r in library.compare_folders(spark.createDataFrame(inc, schema), spark.createDataFrame(exi, schema)).collect()}
    assert got == {"a": "format_upgrade", "b": "missing_tracks", "c": "exact_duplicate", "d": "partial_overlap", "e": "partial_overlap"}


def test_a_name_is_worked_out_once(spark):
    """What an expression uses several times is bound: a title's loop stands in it once, an empty text is not cast, and votes
    are not made once more for a filter on their number."""
    from sleevenotes.functions.binding import digits
    from sleevenotes.operators import proposals
    from sleevenotes.sources.raw import raw_files

    one = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert plan(one.select(N.clean_title(F.col("t")).alias("x"))).count("aggregate(") == 1
    assert [r[0] for r in spark.createDataFrame([("07",), ("",), (None,)], "t string").select(digits(F.col("t"))).collect()] == [7, None, None]
    votes = proposals._voted(
        raw_files(spark, "/root/testdata/sf0.001").selectExpr("folder_path", "folder_name", "parent_name", "file_id", "ext", "album", "album AS _album", "album_artist AS _aa", "artist AS _artist", "genre", "label", "key", "year AS _year", "false AS _unread", "false AS _flagged", "1 AS _number", "1.0D AS _bpm"),
        "file_id", F.count_distinct,
    )
    assert "size(array(struct" not in votes._jdf.queryExecution().optimizedPlan().toString().replace("named_struct", "struct")
