"""Golden rows and edge cases of the catalog operators."""

import pytest
from pyspark.sql import functions as F

from sleevenotes.functions import text as T
from sleevenotes.operators import classify, dedupe, learn, quality, routing, runs, votes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_vote_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("f", "2", "a"), ("f", "1", "b"), ("g", "1", "a"), ("g", "2", "a"), ("g", "3", "b"), ("h", "1", None), ("h", "2", "")], "folder string, path string, v string")
    got = {r["folder"]: (r["winner"], round(r["share"], 3), r["votes"]) for r in votes.plurality(df, ["folder"], "v", "path").collect()}
    assert got == {"f": ("b", 0.5, 1), "g": ("a", 0.667, 2)}


@pytest.mark.parametrize(("numbers", "gaps", "repeats", "score"), [([1, 2, 2, 5], [3, 4], [2], 0.81), ([3], [], [], 1.0), ([], [], [], 1.0), ([1, 9], [2, 3, 4, 5, 6, 7, 8], [], 0.7)])
def test_gaps_and_repeats(spark, numbers, gaps, repeats, score):
    df = spark.createDataFrame([("f", n) for n in numbers] or [("f", None)], "folder string, n int")
    got = quality.numbers(df, ["folder"], F.col("n")).first()
    missing = [k for run in got["gaps"] for k in range(int(run.split("-")[0]), int(run.split("-")[1]) + 1)]
    assert (missing, got["gap_count"], got["repeats"], round(got["completeness"], 6)) == (gaps, len(gaps), repeats, score)


@pytest.mark.parametrize(("raw", "number"), [("B2", 10), ("3/12", 3), ("a1", 1), ("x", None), (None, None), ("0", None), (" 07", 7)])
def test_track_numbers(spark, raw, number):
    assert one(spark, T.track_number(F.col("a")), a=raw) == number


@pytest.mark.parametrize(("a", "b", "score"), [("a b", "b a", 1.0), ("abc", "abd", 2 / 3), ("", "x", 0.0), (None, "x", 0.0), ("Same ", "same", 1.0)])
def test_similarity(spark, a, b, score):
    assert abs(one(spark, T.similarity(F.col("a"), F.col("b")), a=a, b=b) - score) < 1e-9


@pytest.mark.parametrize(("bpm", "zone"), [("99.5", "90-99"), ("125", "House"), ("150", "150-159"), ("60", "Downtempo")])
def test_tempo_zones(spark, bpm, zone):
    assert one(spark, T.tempo_zone(F.col("a").cast("double")), a=bpm) == zone


@pytest.mark.parametrize(("key", "wheel"), [("A minor", "8A"), ("am", "8A"), ("F#", "2B"), ("C major", "8B"), ("H", ""), (None, "")])
def test_keys(spark, key, wheel):
    assert one(spark, T.camelot(F.col("a")), a=key) == wheel


def test_garbage(spark):
    assert one(spark, T.garbage_reasons(F.col("a")), a="(a)(b)[c][d](e) www.x") == ["token_flood", "promo_watermark"]
    assert one(spark, T.garbage_reasons(F.col("a")), a="Fine name") == []


def test_routing_order(spark):
    rows = [("p1", "misc", "A", 0.95, 0.0), ("p2", "x", "B", 0.9, 0.0), ("p3", "y", "B", 0.9, 0.0), ("p4", "z", "B", 0.9, 0.5), ("p5", "w", "C", 0.5, 0.0), ("p6", "v", "K", 0.95, 0.0)]
    p = spark.createDataFrame(rows, "folder_path string, folder_name string, proposed_name string, confidence double, unreadable_ratio double")
    got = {r["folder_path"]: r for r in routing.triage(routing.route(p, spark.createDataFrame([("K",)], "name string"))).collect()}
    assert (got["p1"]["destination"], got["p1"]["reasons"], round(got["p1"]["confidence"], 2)) == ("review", ["generic_folder_name"], 0.80)
    assert (got["p2"]["destination"], got["p2"]["tier"]) == ("clean", "high")
    assert (got["p3"]["destination"], got["p3"]["reasons"], got["p3"]["tier"]) == ("duplicate", ["duplicate_in_run:p2"], "mid")
    assert got["p4"]["destination"] == "review" and got["p5"]["destination"] == "review"
    assert (got["p6"]["destination"], got["p6"]["tier"]) == ("duplicate", "prob")


def test_learned_confidence(spark):
    v = [("noise_removal", "accept")] * 20 + [("bpm_extraction", "accept")] * 10 + [("bpm_extraction", "reject")] * 10 + [("key_extraction", "skip")]
    got = {r["fix_type"]: r for r in learn.learned(spark.createDataFrame(v, "fix_type string, verdict string"), ["fix_type"]).collect()}
    assert (got["noise_removal"]["graduated"], got["noise_removal"]["learned_confidence"]) == (True, 0.925)
    assert (got["bpm_extraction"]["graduated"], got["bpm_extraction"]["learned_confidence"]) == (False, 0.836)
    assert got["key_extraction"]["hit_rate"] == 0.0


def test_near_durations(spark):
    df = spark.createDataFrame([("a", "T", 200.0), ("b", "t", 201.9), ("c", "t", 202.0), ("d", None, 200.0)], "file_id string, title string, duration_sec double")
    got = {(r["file_id_a"], r["file_id_b"]) for r in dedupe.same_title_and_length(df).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_incremental_and_free_names(spark):
    s = "path string, mtime double"
    got = {r["path"]: r["action"] for r in runs.incremental(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], s), spark.createDataFrame([("a", 1.005), ("b", 1.0), ("z", 1.0)], s)).collect()}
    assert got == {"a": "keep", "b": "read", "c": "read", "z": "evict"}
    plan = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "source string, target string")
    got = {r["source"]: r["final"] for r in runs.free_names(plan, spark.createDataFrame([("y",)], "target string")).collect()}
    assert got == {"1": "x", "2": "x (1)", "3": "y (1)"}


def test_embedded_releases_are_partial_below_their_total(spark):
    tags = {"a": ["1/7", "2/7"], "b": ["1/2", "2/2"], "c": ["2", "3"], "d": ["1", "3"], "e": ["2/2", "3"], "g": ["1/0", "2/0"]}
    df = spark.createDataFrame([("f", 10 * i + k, a, t) for i, (a, ts) in enumerate(tags.items()) for k, t in enumerate(ts)], "folder string, file_id int, album string, tn string")
    found = classify.embedded_releases(df, ["folder"], F.lit("x"), F.col("album"), T.track_number(F.col("tn")), least=2, total=T.track_total(F.col("tn")))
    assert {r["album_key"]: r["partial"] for r in found.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": False, "g": False}


def test_crate_kind_comes_before_content_type(spark):
    df = spark.createDataFrame([(f, k, "x", "y", c) for f, c in (("p", "set"), ("q", "singles"), ("r", None)) for k in range(8)], "folder string, file_id int, artist string, albumartist string, crate string")
    got = {r["folder"]: r["content_type"] for r in classify.content_type(df, ["folder"], F.col("folder"), crate=F.col("crate")).collect()}
    assert got == {"p": "crate_set", "q": "crate_singles", "r": "album"}


def test_discs_from_file_names_and_heuristic_confidence(spark):
    files = {"p": [("1", "x"), (None, "213 y")], "q": [(None, "101 x"), ("0", "102 y")], "r": [("1", "201 x"), ("1/2", "y")], "s": [(None, "100 x"), (None, "200 x"), (None, "300 y")]}
    rows = [(f, k, d, n, "al", "ar", "ar", "Some title", "2001", "120", ".flac", 1, str(k + 1)) for f, fs in files.items() for k, (d, n) in enumerate(fs)]
    df = spark.createDataFrame(rows, "folder string, file_id int, discnumber string, stem string, album string, albumartist string, artist string, title string, year string, bpm string, ext string, size int, tracknumber string")
    assert {r["folder"]: r["multi_disc"] for r in quality.shape(df, ["folder"], F.col("stem")).collect()} == {"p": True, "q": False, "r": False, "s": False}
    sure, guess = ({r["folder"]: r["confidence"] for r in quality.confidence(df, ["folder"], F.col("folder"), F.col("album"), heuristic=h).collect()} for h in (None, F.col("folder") == "p"))
    assert abs(guess["p"] - 0.6 * sure["p"]) < 1e-9 and guess["q"] == sure["q"] > 0
