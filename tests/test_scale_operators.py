"""Operators for hot keys, total orders, sweeps, contained names, one artist's names, patterns, state and upserts, against brute force."""

import itertools
import os
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from sleevenotes import catalog
from sleevenotes.functions import names as N
from sleevenotes.functions import text as T
from sleevenotes.operators import alike, containment, dedupe, library, order, patterns, proposals, routing, runs
from sleevenotes.plans import moves
from sleevenotes.sources import buckets
from sleevenotes.streaming import jobs


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_name_is_numbered_over_many_tasks(spark, many_partitions):
    n = 30_000
    d = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("n"), (F.col("id") % 500).cast("string"))).alias("name"), F.format_string("p%06d", (F.col("id") * 7919) % n).alias("path"))
    numbered = order.number_within(d, ["name"], ["path"], "k").cache()
    largest = numbered.groupBy(order.PART).count().agg(F.max("count")).first()[0]
    assert largest <= 0.02 * n and numbered.filter("name = 'hot'").select(order.PART).distinct().count() > 30
    want, seen = {}, {}
    for r in sorted(d.collect(), key=lambda r: r["path"]):
        seen[r["name"]] = seen.get(r["name"], 0) + 1
        want[r["path"]] = seen[r["name"]]
    assert {r["path"]: r["k"] for r in numbered.collect()} == want
    known = spark.createDataFrame([("hot", 1), (None, 2), ("none", 3)], "name string, f int")
    told = {(r["name"], r["f"]) for r in order.spread(numbered, ["name"], known).select("name", "f").distinct().collect()}
    assert ("hot", 1) in told and (None, 2) in told and all(f is None for name, f in told if name not in ("hot", None))


def test_places_in_a_total_order(spark, many_partitions):
    rows = [(i, (i * 37) % 11, None if i % 13 == 0 else f"x{(i * 7) % 101}") for i in range(700)]
    placed = order.positions(spark.createDataFrame(rows, "id int, a int, b string").repartition(5), [F.desc("a"), "b", "id"])
    want = sorted(rows, key=lambda r: (-r[1], r[2] is not None, r[2] or "", r[0]))
    assert [r["id"] for r in sorted(placed.collect(), key=lambda r: r["place"])] == [r[0] for r in want]
    assert sorted(r["place"] for r in placed.collect()) == list(range(1, 701))
    assert order.positions(spark.createDataFrame([], "id int"), ["id"]).count() == 0


def test_occurrences_and_names_given_out(spark):
    rows = [(f"p{i:02d}", "n", ("A", "B", "C", None)[i % 4 if i % 5 else 0], 0.9) for i in range(24)]
    df = spark.createDataFrame(rows, "folder_path string, folder_name string, proposed_name string, confidence double").repartition(3)
    got = {r["folder_path"]: (r["occurrence"], r["other"]) for r in routing.occurrences(df, "proposed_name", "folder_path").collect()}
    for p, _, name, _ in rows:
        own = sorted(q for q, _, m, _ in rows if m == name)
        k = own.index(p)
        assert got[p] == (k + 1, own[0] if k else (own[1] if len(own) > 1 else None))
    plan = spark.createDataFrame([("1", "a/x.mp3"), ("2", "a/x.mp3"), ("3", "a/y"), ("4", "a/.z"), ("5", "a/.z")], "source string, target string")
    final = {r["source"]: r["final"] for r in runs.free_names(plan, spark.createDataFrame([("a/y",)], "target string"), form="%s (UNDO%d)%s").collect()}
    assert final == {"1": "a/x.mp3", "2": "a/x (UNDO1).mp3", "3": "a/y (UNDO1)", "4": "a/.z", "5": "a/.z (UNDO1)"}


def test_undo_by_id_session_path_and_folder(spark):
    log = spark.createDataFrame([("1", "s", "in/a/x", "o/1"), ("2", "t", "in/b/x", "o/2")], "action_id string, session_id string, original_path string, target_path string")
    ids = lambda **by: sorted(r["action_id"] for r in moves.chosen(log, **by).collect())
    assert ids(action_id="2") == ["2"] and ids(session_id="s") == ["1"] and ids(path="/a/") == ["1"] and ids(folder="x") == ["1", "2"]
    with pytest.raises(ValueError):
        moves.chosen(log)
    snaps = spark.createDataFrame([("s", "f", "title", "old", "mid", 1, True, False), ("s", "f", "title", "mid", "new", 2, True, False), ("s", "g", "title", "a", "b", 3, True, True), ("u", "h", "key", "a", "b", 4, False, False)], "apply_session_id string, file_path string, field_name string, original_value string, new_value string, ord int, written boolean, undone boolean")
    assert [tuple(r) for r in moves.undo_tags(snaps, "s").collect()] == [("f", "title", "old", "new", 2)]


def test_sweep_counts_the_pairs_that_the_join_forms(spark):
    r = random.Random(1)
    rows = [(f"f{i:04d}", r.choice(["T", "t", "u", None, ""]), r.choice([None, 2.0, 4.0, 200.0, 201.9, 202.0]) if i % 3 else round(r.uniform(0, 30), 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "file_id string, title string, duration_sec double")
    pairs = dedupe.same_title_and_length(df).groupBy("signal_value").agg(F.count("*").alias("pairs"), F.min("file_id_a").alias("first_a"), F.max("file_id_b").alias("last_b"))
    got = dedupe.near_duration_groups(df).select("signal_value", "pairs", "first_a", "last_b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() == 2
    hot = spark.range(200_000).select(F.col("id").cast("string").alias("file_id"), F.lit("one").alias("title"), (100 + F.col("id") % 3).cast("double").alias("duration_sec"))
    n = [66667, 66667, 66666]
    want = sum(x * (x - 1) // 2 for x in n) + n[0] * n[1] + n[1] * n[2]
    assert dedupe.near_duration_groups(hot).collect()[0]["pairs"] == want


def test_identifier_folders_count_without_pairs(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "c", "d", None]), f"p{r.randint(0, 3)}") for i in range(40)] + [(100, "alone", "p")]
    got = {x["isrc"]: (x["pairs"], x["folders"], x["last_folder"]) for x in dedupe.identifier_folders(spark.createDataFrame(rows, "file_id int, isrc string, folder_path string")).collect()}
    want = {}
    for key in "abcd":
        own = [(i, f) for i, k, f in rows if k == key]
        edges = [(a, b) for a, b in itertools.product(own, own) if a[0] < b[0]]
        want[key] = (len(edges), len({a[1] for a, _ in edges}), max(b[1] for _, b in edges))
    assert got == want


def test_medians_and_gap_runs(spark):
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), r.choice([None, 1.5, 2.0, 7.25, 100.0])) for _ in range(301)] + [("only null", None), ("one", 4.0)]
    got = {x["k"]: x["m"] for x in order.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), "m").collect()}
    want = {k: statistics.median([v for q, v in rows if q == k and v is not None]) for k in ("x", "y", None, "one")}
    assert got == want
    numbers = [("a", k) for k in (1, 2, 2, 5, 70_000, 70_003, 2_000_000_000)] + [("b", 3), ("c", None), (None, 1), (None, 3)]
    ranges = order.gap_ranges(spark.createDataFrame(numbers, "k string, n long"), ["k"], F.col("n"))
    assert {tuple(x) for x in ranges.collect()} == {("a", 3, 4, 2), ("a", 6, 69_999, 69_994), ("a", 70_001, 70_002, 2), ("a", 70_004, 1_999_999_999, 1_999_929_996), (None, 2, 2, 1)}


def test_contained_names_match_brute_force(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab c") for _ in range(n))
    needles = [(r.choice("pq"), word(r.choice([0, 1, 2, 3, 7, 8, 9, 12]))) for _ in range(300)] + [("p", None), (None, "a"), ("p", "é😀x")]
    names = [(r.choice("pqr"), word(r.randint(0, 60))) for _ in range(300)] + [("p", "zé😀xz"), ("p", "zé😀xz"), (None, "a"), ("q", None)]
    got = {(x["scope"], x["needle"]): x["hits"] for x in containment.hits(spark.createDataFrame(needles, "scope string, needle string"), spark.createDataFrame(names, "scope string, name string")).collect()}
    want = {}
    for s, n in set(needles):
        found = sum(n in m for t, m in names if t == s and m) if n and s else 0
        if found:
            want[(s, n)] = found
    assert got == want
    assert containment.pairs(spark.createDataFrame([], "scope string, needle string"), spark.createDataFrame(names, "scope string, name string")).count() == 0


def test_one_parent_of_many_folders_has_no_quadratic_join(spark):
    n = 20_000
    names = spark.range(n).select(F.lit(1).alias("scope"), F.concat(F.lit("artist number "), F.col("id").cast("string"), F.lit(" - album")).alias("name"))
    needles = spark.range(n).select(F.lit(1).alias("scope"), F.concat(F.lit("artist number "), F.col("id").cast("string"), F.lit(" -")).alias("needle"))
    assert containment.hits(needles, names).agg(F.count("*"), F.sum("hits")).first() == (n, n)


def test_one_artists_names_match_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.sample(words, r.randint(1, 26))) for _ in range(60)]
    near = [" ".join((b.split() + [r.choice(words)])[r.randint(0, 1) :]) for b in base]
    a = base + ["The Ox & Fox", "Fox and the ox", "A, B & C", "", "x", "Béla"] + near[:30]
    b = near + ["fox & ox", "C & A, B", "b & a, c", "X ", "béla"] + base[20:40]
    got = {tuple(x) for x in alike.same_artists(spark.createDataFrame([(v,) for v in [*a, None]], "name string"), spark.createDataFrame([(v,) for v in b], "name string")).collect()}
    both = spark.createDataFrame(list(itertools.product(set(a), set(b))), "a string, b string")
    want = {tuple(x) for x in both.filter(N.same_artist(F.col("a"), F.col("b"))).select("a", "b").collect()}
    assert got == want and len(want) > 60


def test_patterns_by_their_longest_literal(spark):
    assert patterns.longest_literal(r"(?i)^gig\s+set\d+") == "gig" and patterns.longest_literal("abcx?yz+") == "abc"
    assert patterns.longest_literal("a|b") == "" and patterns.longest_literal(r"(foo)?bar\.baz") == "bar.baz" and patterns.longest_literal("ab{0,2}cde[xy]") == "cde"
    names = ["My Gig set7", "club night", "abcyz", "ab.cyz", "Ann 3", "[x]", "SET LIST", "odd7", None, "a\nb3"]
    rules = [("set", r"(?i)gig\s+set\d"), ("crate", "abcx?y"), ("veto", "(?i)CLUB"), ("veto", "^s|^S"), ("crate", "(["), ("crate", "(?P<n>abc)y"), ("ignore", "Ann *"), ("ignore", "[!A]*7"), ("ignore", "[[]x]"), ("ignore", "a*3"), ("set", None)]
    got = {tuple(r) for r in patterns.matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "kind string, pattern string")).collect()}
    assert got == {
        ("My Gig set7", "set", r"(?i)gig\s+set\d"), ("abcyz", "crate", "abcx?y"), ("club night", "veto", "(?i)CLUB"), ("SET LIST", "veto", "^s|^S"), ("Ann 3", "ignore", "Ann *"),
        ("My Gig set7", "ignore", "[!A]*7"), ("odd7", "ignore", "[!A]*7"), ("[x]", "ignore", "[[]x]"), ("a\nb3", "ignore", "a*3"),
    }
    left = patterns.without_ignored(spark.createDataFrame([(n,) for n in names], "name string"), "name", spark.createDataFrame(rules, "kind string, pattern string"))
    assert {r["name"] for r in left.collect()} == {"club night", "abcyz", "ab.cyz", "SET LIST", None}


def test_compound_artists_and_composed_letters(spark):
    rows = [("Ann Lee and Bob Fox", "ann lee"), ("Solo Act", "Solo Act"), ("A & Bee & C", "bee"), (None, "x"), ("Dj X and Mc Y", "zed"), ("Ann AND Bob", "ann")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, v string").select(proposals.compound(F.col("n"), F.col("v"))).collect()]
    assert got == ["Ann Lee & Bob Fox", None, "A & Bee & C", None, None, "Ann & Bob"]
    texts = [unicodedata.normalize("NFD", t) for t in ("Béyoncé", "ǭṩ Việt", "Plain", "", "Ångström ḗ")]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(N.nfc(F.col("t"))).collect()] == [unicodedata.normalize("NFC", t) for t in texts]


def test_decimals_round_as_binary_values_do(spark):
    r = random.Random(2)
    xs = [0.285, 0.275, 0.145, 0.135, 0.355, 0.625, 0.125, 0.005, 1.0, 0.0, 0.62495, 0.00005, 0.99995] + [r.randint(0, 2000) / r.choice([3, 7, 8, 16, 200, 400, 1000]) for _ in range(500)]
    for x in spark.createDataFrame([(x,) for x in xs], "a double").select("a", T.decimals(F.col("a"), 2).alias("b"), T.decimals(F.col("a"), 4).alias("c")).collect():
        assert (x["b"], x["c"]) == (f"{x['a']:.2f}", f"{x['a']:.4f}")


def test_titles_without_their_artist(spark):
    rows = [("Ann Lee - Night", "Ann Lee"), ("ANN LEE-Night", "Ann Lee"), ("Ann Lee - ", "Ann Lee"), ("Ann Leeds", "Ann Lee"), ("Béla - Sol", "bela"), ("x", ""), ("Ann", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, a string").select(library.without_artist(F.col("t"), F.coalesce("a", F.lit("")))).collect()]
    assert got == ["Night", "Night", "Ann Lee - ", "Ann Leeds", "Sol", "x", "Ann"]


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", i, 1) for i in range(200)]
    schema = "key string, v int, stamp int"
    buckets.write(spark.createDataFrame(rows, schema), path, ["key"], 16)
    listed = lambda: {(d, f) for d in os.listdir(path) if d.startswith("_bucket") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = listed()
    changes = spark.createDataFrame([("k3", -1, 2), ("k3", -2, 3), ("new", 5, 1), ("k7", -9, 0)], schema)
    touched = buckets.upsert(changes, path, ["key"], [F.desc("stamp")], 16)
    kept = {(d, f) for d, f in before if d not in {f"_bucket={k}" for k in touched}}
    assert 1 <= len(touched) <= 3 and kept <= listed() and len(kept) >= 12
    got = {r["key"]: r["v"] for r in buckets.read(spark, path).collect()}
    assert got == {k: v for k, v, _ in rows} | {"k3": -2, "new": 5}
    assert buckets.upsert(changes, path, ["key"], [F.desc("stamp")], 16) == touched  # again: nothing changes
    assert {r["key"]: r["v"] for r in buckets.read(spark, path).collect()} == got
    assert buckets.upsert(changes.limit(0), path, ["key"], [F.desc("stamp")], 16) == []


def test_names_seen_survive_a_restart(spark, tmp_path):
    schema = "folder_path string, folder_name string, proposed_name string, confidence double, is_crate boolean"
    batches = [
        [("p2", "b", "X", 0.9, False), ("p1", "alpha", "X", 0.9, False), ("p0", "z", "W", 0.5, False)],
        [("p3", "c", "X", 0.95, False), ("p4", "d", "Y", 0.9, True), ("p5", "e", "W", 0.99, False)],
        [("p6", "f", "Y", 0.9, False), ("p7", "g", "V", 0.9, None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sources_stream(spark, str(tmp_path / "in"), schema)
        jobs.route_arriving(stream, str(tmp_path / "manifest"), str(tmp_path / "history"), str(tmp_path / "checkpoint")).awaitTermination()
        if k == 0:  # what was written before is not read again
            for name in ("history", "manifest"):
                os.rename(tmp_path / name, tmp_path / f"{name}-gone")
    got = {r["folder_path"]: (r["destination"], list(r["reasons"])) for r in spark.read.parquet(str(tmp_path / "history")).collect()}
    assert got["p3"] == ("duplicate", ["already_in_clean"]) and got["p5"] == ("duplicate", ["duplicate_in_run:p0"])
    assert got["p4"][0] == "review" and got["p6"] == ("duplicate", ["duplicate_in_run:p4"]) and got["p7"] == ("clean", [])
    first = {r["folder_path"]: r["destination"] for r in spark.read.parquet(str(tmp_path / "history-gone")).collect()}
    assert first == {"p1": "clean", "p2": "duplicate", "p0": "review"}


def sources_stream(spark, path, schema):
    return jobs.stream_files(spark, path, spark.createDataFrame([], schema).schema)




def test_holders_of_names_without_numbering(spark, monkeypatch):
    rows = [(f"p{i:02d}", "n", ("A", "B", "C", None)[i % 4 if i % 5 else 0], 0.9) for i in range(24)] + [("q", "n", "D", 0.9)]
    df = spark.createDataFrame(rows, "folder_path string, folder_name string, proposed_name string, confidence double").repartition(3)
    known = spark.createDataFrame([("B", True)], "proposed_name string, _known boolean")
    want = {(p, name == "B" or None): (min(q for q, _, m, _ in rows if m == name) if p != min(q for q, _, m, _ in rows if m == name) else None) for p, _, name, _ in rows}
    for names, most in ((100, 100), (0, 100), (0, 6), (0, 0)):
        monkeypatch.setattr(routing, "NAMES", names)
        monkeypatch.setattr(routing, "ROWS", most)
        got = routing.holders(df, "proposed_name", "folder_path", known).collect()
        assert len(got) == len(rows) and {(r.folder_path, r._known): r.other for r in got} == want and all((r.occurrence == 2) == (r.other is not None) for r in got)


def test_routing_does_not_sort_all_folders(spark, small, monkeypatch):
    def numbered(*_):
        raise AssertionError("all folders are sorted and numbered")

    monkeypatch.setattr(routing, "number_within", numbered)
    assert catalog.QUERIES["c09_routing"](spark, small).count() == catalog.QUERIES["c07_confidence"](spark, small).count()
