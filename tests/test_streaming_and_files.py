"""Streaming forms give what the batch jobs give; readers and writers keep what they are given."""

import json

from pyspark.sql import functions as F

from sleevenotes.plans import moves
from sleevenotes.sources import files
from sleevenotes.streaming import jobs

PROPOSALS = "folder_path string, folder_name string, proposed_name string, confidence double"


def test_running_tallies_match_the_batch(spark, tmp_path):
    log = spark.createDataFrame([(f"s{i % 3}", ("clean", "review")[i % 2], i) for i in range(20)], "session_id string, destination string, t int").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = jobs.stream_files(spark, str(tmp_path / "log"), log.schema)
    query = jobs.running_tallies(stream).writeStream.format("memory").queryName("tallies").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("tallies").collect())) == sorted(map(tuple, jobs.running_tallies(log).collect()))


def test_arriving_proposals_meet_names_accepted_before(spark, tmp_path):
    source = tmp_path / "in"
    for k, rows in enumerate(([("p1", "alpha", "X", 0.9), ("p2", "beta", "X", 0.9)], [("p3", "gamma", "X", 0.95), ("p4", "delta", "Y", 0.5)])):
        spark.createDataFrame(rows, PROPOSALS).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.stream_files(spark, str(source), spark.createDataFrame([], PROPOSALS).schema)
        jobs.route_arriving(stream, str(tmp_path / "manifest"), str(tmp_path / "history"), str(tmp_path / "checkpoint")).awaitTermination()  # the second start resumes
    got = {r["folder_path"]: (r["destination"], list(r["reasons"])) for r in spark.read.parquet(str(tmp_path / "history")).collect()}
    assert got["p1"][0] == "clean" and got["p2"] == ("duplicate", ["duplicate_in_run:p1"])
    assert got["p3"] == ("duplicate", ["already_in_clean"]) and got["p4"][0] == "review"
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "manifest")).collect()] == ["X"]


def test_history_drops_malformed_lines(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text(json.dumps({"action_id": "1", "session_id": "s", "confidence": 0.5}) + "\n{broken\n" + json.dumps({"action_id": "2"}) + "\n")
    got = files.read_history(spark, str(path))
    assert [r["action_id"] for r in got.select("action_id", "session_id").orderBy("action_id").collect()] == ["1", "2"]
    files.append_history(got, str(tmp_path / "out"))
    files.append_history(got, str(tmp_path / "out"))
    assert files.read_history(spark, str(tmp_path / "out")).count() == 4


def test_listing_and_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.MP3", "a/.hidden.mp3", "a/y.txt", "z.flac"):
        (tmp_path / name).write_text("12345")
    got = files.listing(spark, str(tmp_path), (".mp3", ".flac"))
    assert sorted((r["path"].split("/")[-1], r["size"]) for r in got.collect()) == [("x.MP3", 5), ("z.flac", 5)]
    tree = files.tree_dump(spark.createDataFrame([("r/a/x.mp3",), ("r/b",)], "path string"))
    assert sorted(map(tuple, tree.collect())) == [("DIR", 0, "", "r"), ("DIR", 1, "", "r/a"), ("FILE", 1, "", "r/b"), ("FILE", 2, ".mp3", "r/a/x.mp3")]


def test_undo_gives_back_the_originals(spark):
    log = spark.createDataFrame([("1", 1, 1, "in/a", "out/a"), ("2", 2, 2, "in/b", "out/b")], "action_id string, timestamp int, ord int, original_path string, target_path string")
    plan = moves.undo_plan(log, spark.createDataFrame([("in/b",)], "target string"))
    assert {(r["source"], r["final"]) for r in plan.collect()} == {("out/a", "in/a"), ("out/b", "in/b (UNDO1)")}


def test_apply_plan_skips_protected_fields(spark):
    rows = [("1", "f2", "title", "a", "b", "x", "accepted"), ("2", "f1", "key", "a", "b", "x", "accepted"), ("3", "f1", "title", "a", "b", "x", "pending"), ("4", "f1", "album", "c", "d", "y", "accepted")]
    p = spark.createDataFrame(rows, "proposal_id string, file_id string, field_name string, old_value string, new_value string, fix_type string, status string")
    assert [r["proposal_id"] for r in moves.apply_plan(p, ["key"], 1).collect()] == ["4"]
    assert {r["proposal_id"] for r in moves.apply_plan(p, ["key"]).collect()} == {"1", "4"}
