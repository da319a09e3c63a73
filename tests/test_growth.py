"""What keeps the work for a row small: guards that change no result, and one reading of a value."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from sleevenotes import catalog, scanner_queries
from sleevenotes.functions import names as N
from sleevenotes.functions import tags as G
from sleevenotes.functions import text as T
from sleevenotes.operators import alike, containment, context, fixes, groups, library, proposals
from sleevenotes.plans import moves
from sleevenotes.sources import adapters
from sleevenotes.sources.raw import raw_files


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Physical Plan ==")[1]


def test_literals_are_in_every_match():
    assert [G.literal(p) for p in (r"\s*\[Official\s*(?:Audio|Video)\]", r"https?://\S+", r"[\w.+-]+@[\w-]+\.[\w.-]+", r"(?:OUT NOW|BUY)", r"a|b", r"ab{2}c")] == ["[official", "http", "@", "", "", "a"]


@pytest.mark.parametrize("field", sorted(G.NOISE))
def test_guards_find_all_noise(spark, field):
    texts = ["", "plain", "x [OFFICIAL Video]", "y (lyrics)", "z - Free DL", "out now!", "q [Flac] (HQ)", "w - lyric ", "128 bpm 8A", "DJ  City", "HTTPS://a.b", "WWW.x.com", "a.b@c.de", "(C) 1999", "Ripped with x", "lame 3.9", "youtube_abcdefghijk_audio", "[_YouConvert.net_]", "[yt1s.x]", "not for resale", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plainly = F.filter(F.array(*[G.strip(F.regexp_extract("t", "(?i)" + p, 0)) for p, _, _ in G.NOISE[field]]), lambda m: m != "")
    rows = df.select(F.transform(G.noise(field, F.col("t")), lambda h: h["matched"]).alias("a"), plainly.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows)


def test_a_file_s_fields_are_read_for_keys_once(spark, small):
    assert plan_of(fixes.proposals(raw_files(spark, small))).count("|maj(?:or)?") == 6  # in the test and in the value, for each of three fields


def _sides(spark):
    rows = [(f"p{k % 3}", f"{k % 7} Song {'abc'[k % 3]} {k % 11}" if k % 13 else None, f"f{k % 5}.mp3", ".flac" if k % 4 else ".mp3", k % 6) for k in range(60)] + [("q", "-", "x.mp3", ".mp3", 1), ("q", None, None, ".mp3", 0)]
    both = spark.createDataFrame(rows, "pair string, title string, filename string, ext string, size long").repartition(3)
    return both, both.filter("title NOT LIKE '% 7' OR pair = 'q'")


def test_large_pairs_are_compared_as_small_ones(spark, monkeypatch):
    a, b = _sides(spark)
    found = []
    for most in (512, 20, 0):
        monkeypatch.setattr(library, "AT_ONCE", most)
        compared = library.compare_folders(a, b)
        found.append((sorted(map(str, compared.collect())), sorted(map(str, library.merge_plan(a, b, compared).collect()))))
    assert found[0] == found[1] == found[2] and found[0][1]


def test_large_folders_vote_as_small_ones(spark, small, monkeypatch):
    files = raw_files(spark, small).limit(400)
    one = sorted(map(str, proposals.tag_votes(files).collect()))
    monkeypatch.setattr(groups.by_key, "__defaults__", (3, None, True))  # no folder of more than three files is small
    assert sorted(map(str, proposals.tag_votes(files).collect())) == one


def test_folders_are_dealt_once(spark, small):
    assert plan_of(proposals.tag_votes(raw_files(spark, small))).count("Exchange hash") == 3  # facts, votes, tempi
    assert plan_of(library.compare_folders(*_sides(spark))).count("Exchange hash") == 2


def test_names_are_found_by_tests_and_by_pieces(spark, monkeypatch):
    names = spark.createDataFrame([(f"s{k % 3}", f"name {k * 7 % 31} of {'many few'.split()[k % 2]} {k}") for k in range(90)], "scope string, name string")
    needles = spark.createDataFrame([(f"s{k % 2}", t) for k in range(2) for t in ("many", "few 1", "name 1", " of many 1", "absent", "e")] + [("s2", "7 of")], "scope string, needle string")
    want = sorted((a.scope, a.needle, b.name) for a in needles.collect() for b in names.collect() if a.scope == b.scope and a.needle in b.name)
    for tests, few in ((1 << 16, 64), (40, 2), (40, 0), (0, 3), (0, 0)):
        monkeypatch.setattr(containment, "TESTS", tests)
        monkeypatch.setattr(containment, "FEW", few)
        assert sorted(map(tuple, containment.pairs(needles, names).collect())) == want
    monkeypatch.undo()
    assert "explode" not in plan_of(containment.pairs(needles, names))


def test_rows_of_few_row_groups_are_dealt_to_all_tasks(spark, small, monkeypatch):
    assert raw_files(spark, small, heavy=True).rdd.getNumPartitions() == 1  # not worth it
    monkeypatch.setattr(adapters, "WORTH", 1)
    dealt = raw_files(spark, small, heavy=True)
    assert all(dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) and dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(raw_files(spark, small)).isEmpty() and dealt.count() == raw_files(spark, small).count()
    assert "RoundRobinPartitioning" in plan_of(scanner_queries.c13_fix_proposals(spark, small))
    monkeypatch.setattr(adapters, "BUSY", 1)  # row groups enough
    assert raw_files(spark, small, heavy=True).rdd.getNumPartitions() == 1


def test_fixes_of_some_folders_are_those_of_all_filtered(spark, small):
    files = raw_files(spark, small)
    told, ann = context.folder_context(files), F.contains("folder_path", F.lit("Ann"))
    every, some = fixes.all_fixes(files, told).filter(ann), fixes.all_fixes(files, told, within=ann)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect())) and not some.isEmpty()
    assert plan_of(scanner_queries.p13_pending_fixes(spark, small)).count("Contains(") >= 4  # files of each pass and of the context


@pytest.mark.parametrize("name", ["c01_folder_proposals", "c28_what_if_album", "c29_track_renames", "c29_guarded_renames", "c34_explained"])
def test_files_are_dealt_before_they_are_judged(spark, small, monkeypatch, name):
    asked = []

    def judged(files):
        asked.append(files)
        raise StopIteration  # what is judged is all that is looked at

    for step in ("propose", "what_if"):
        monkeypatch.setattr(proposals, step, judged)
    monkeypatch.setattr(adapters, "WORTH", 1)
    with pytest.raises(StopIteration):
        catalog.QUERIES[name](spark, small)
    assert "RoundRobinPartitioning" in plan_of(asked[0])


def test_fixes_of_one_risk_are_those_of_all_filtered(spark, small):
    files = raw_files(spark, small)
    told = context.folder_context(files)
    mine = lambda df: sorted(map(str, df.filter(G.risk(F.col("fix_type")) == "moderate").collect()))
    assert mine(fixes.all_fixes(files, told, risk="moderate")) == mine(fixes.all_fixes(files, told))
    assert {r.fix_type for r in fixes.proposals(files, "safe").select("fix_type").distinct().collect()} <= {k for k, v in G.RISK.items() if v == "safe"}


def test_bulk_verdicts_are_given_in_one_pass(spark, small):
    plan = plan_of(scanner_queries.c18_bulk_verdicts(spark, small))
    assert plan.count("Scan parquet") <= 5  # files for two passes (spellings are of another risk), labels, and the context's rows by themselves


def test_a_folder_s_files_are_dealt_once_for_its_context(spark, small, monkeypatch):
    files = raw_files(spark, small).limit(400)
    told = context.folder_context(files)
    assert plan_of(told).count("Exchange hash") == 1
    one = sorted(map(str, told.collect()))
    monkeypatch.setattr(groups.by_key, "__defaults__", (3, None, True))  # no folder of more than three files is small
    assert sorted(map(str, context.folder_context(files).collect())) == one


def test_names_are_cut_into_tokens_once(spark):
    df = spark.createDataFrame([("Ann Lee - Night Drive 1999 web", "Ann Lee - Night Drive"), ("", "x"), ("one two", "One  Two"), (None, "a b"), ("Blue River", "Who - River of Blue")], "f string, p string")
    told = df.select(T.alignment(F.col("f"), F.col("p")).alias("a"), T.similarity(F.col("f"), F.col("p")).alias("s"))
    assert [r.a for r in told.collect()] == [1.0, 0.5, 1.0, 0.5, 2 / 3]
    assert plan_of(told).count("[^a-z0-9]+") == 3  # own tokens, wanted ones, and those after the dash


def test_files_stay_where_their_folder_is(spark, small, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.QUERIES["a03_multi_field_vote"](spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hash") == 4  # two sides of two joins; none for the votes


def test_names_of_common_words_do_not_all_meet(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    names = [" ".join(r.sample(words, r.randint(13, 18))) for _ in range(400)]
    more = [" ".join(r.sample(n.split()[k % 3 == 0 :], len(n.split()) - (k % 3 == 0))) for k, n in enumerate(names[:90])]
    x, y = (alike._worded(spark.createDataFrame([(n,) for n in some], "name string")) for some in (names, names[200:] + more))
    assert 290 <= alike._met(x, y, 0.92).count() < 900  # of 116,000 pairs, most of which share a rare word


def test_two_catalogs_are_read_once_each(spark, small):
    assert plan_of(catalog.QUERIES["j15_same_artists"](spark, small)).count("Scan parquet") == 0  # both are settled


def test_names_are_made_once_for_all_patterns(spark, small):
    assert plan_of(catalog.QUERIES["p02_not_ignored"](spark, small)).count("Scan parquet") == 0


def test_tracks_of_a_crate_meet_their_releases_in_one_shuffle(spark, small):
    plan = plan_of(catalog.QUERIES["c06_crate_tracks"](spark, small))
    assert plan.count("Scan parquet") == 2  # for the releases and for the tracks; none for the names that releases show


def test_names_with_both_cases_are_shown_as_they_are(spark):
    names = ["Ann Lee", "ANN LEE", "ann lee", " Of x ", "of Xy", "OF XyZ", "DJ of", "Ab", "AB C", "the Ox & Fox", "", None, "aBc DEF", "Éa bc", "e.g Abc"]
    slow = lambda c: N.title_case(F.when(F.forall(F.filter(N.words(N.strip(c)), lambda w: F.length(w) > 2), N.shouted), "x").otherwise(N.strip(c)))
    rows = spark.createDataFrame([(n,) for n in names], "n string").filter(r"n rlike '[A-Z][a-z]\\S'").select(slow(F.col("n")).alias("a"), N.strip(F.col("n")).alias("b")).collect()
    assert len(rows) == 4 and all(r.a == r.b for r in rows)


def test_a_dump_s_names_are_keyed_once(spark, small):
    plan = plan_of(catalog.QUERIES["c24_dump_plan"](spark, small))
    assert "array_sort" not in plan.lower() and plan.count("Scan parquet") == 2


@pytest.mark.parametrize("every", [1, 3, 40, 5000])
def test_a_batch_is_filled_from_the_first_files(spark, every):
    files = spark.range(1000).select(F.when(F.col("id") != 7, F.format_string("f%04d", F.col("id"))).alias("file_id"), "id").repartition(3)
    asked = []

    def plan(some):
        asked.append(some.count())
        rows = some.filter(F.col("id") % every == 0).select("file_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"))
        return rows.orderBy("file_id", "kind").limit(5)

    whole = [tuple(r) for r in plan(files).collect()]
    assert [tuple(r) for r in moves.first_batch(files, plan, 5).collect()] == whole
    assert asked[1:] == {1: [20], 3: [20], 40: [20, 320], 5000: [20, 320, 1000]}[every]


def test_an_artist_s_name_is_read_once(spark, small):
    plan = plan_of(scanner_queries.f24_tag_expressions(spark, small))
    assert plan.count(G.KEY_SIGN) == 1 and plan.count("Scan parquet") == 2  # a title's key once; artists on their own


def test_fixes_meet_their_folder_once_and_are_not_dealt_again(spark, small):
    files = raw_files(spark, small)
    told = context.folder_context(files)
    made = fixes.all_fixes(files, told)
    plan = plan_of(made)
    assert "Aggregate(key=[file_id" not in plan and plan.count("Join") == 2  # the context, and the spellings
    # Files that share an id: the first fix of a kind for a field stays, and others' are as they were.
    again = files.limit(40).withColumn("title", F.concat(F.lit("a "), "title"))
    both = fixes.all_fixes(files.unionByName(again), told)
    key = ["file_id", "field_name", "fix_type"]
    assert both.groupBy(*key).count().filter("count > 1").isEmpty()
    rest = lambda df: sorted(map(str, df.join(again.select("file_id").distinct(), "file_id", "left_anti").filter("fix_type <> 'artist_normalize'").collect()))
    assert rest(both) == rest(made) and both.join(again.select("file_id"), "file_id", "left_semi").count() > 40
    # What tallies need is the same without the values.
    short = fixes.all_fixes(files, told, values=False).select(*key, "folder_path", "confidence")
    assert sorted(map(str, short.collect())) == sorted(map(str, made.select(*key, "folder_path", "confidence").collect()))


def test_what_if_reads_the_files_once(spark, small, monkeypatch):
    asked, votes = [], proposals.tag_votes
    monkeypatch.setattr(proposals, "tag_votes", lambda files: asked.append(1) or votes(files))
    assert "parquet" not in plan_of(proposals.what_if(raw_files(spark, small))).lower() and asked == [1]
