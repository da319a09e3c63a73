"""Operators on the given tables against brute force: the rules that labels support, and the links between near copies."""

import itertools
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import brute_components

from sleevenotes.llm import nearsets, urls


def brute_rules(baskets, least, min_confidence):
    """All combinations of tokens with enough bad pages, their confidence, and the pruning by parts."""
    every, bad = Counter(), Counter()
    for tokens, is_bad in baskets:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(sorted(tokens), size):
                every[some] += 1
                bad[some] += is_bad
    found = {s: bad[s] / every[s] for s in bad if bad[s] and bad[s] >= least and bad[s] / every[s] >= min_confidence}
    parts = lambda s: (p for k in range(1, len(s)) for p in itertools.combinations(s, k))
    return {s: c for s, c in found.items() if not any(found.get(p, -1) >= c for p in parts(s))}, {s: bad[s] / every[s] for s in bad if bad[s] >= least}


def labelled(spark, sf):
    pages = urls.with_parts(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url"))
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return pages.withColumn("tokens", urls.tokens(F.col("url"), F.col("host"), F.col("path"))).join(bad, F.col("page_id") == F.col("doc_id")).select("tokens", "bad")


@pytest.mark.parametrize(("count", "confidence"), [(4, 0.2), (6, 0.35)])
def test_mined_rules_match_brute_force(spark, count, confidence):
    table = labelled(spark, "sf0.01")
    baskets = [(r["tokens"], r["bad"]) for r in table.collect()]
    want, _ = brute_rules(baskets, count, confidence)
    got = {tuple(r["antecedent"]): r["confidence"] for r in urls.mine(table, 0.0, count, confidence).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)
    # Matched by the index as by looking at every rule.
    asked = table.select("tokens").distinct().withColumn("k", F.xxhash64("tokens"))
    hits = {r["k"]: r["matched_rules"] for r in urls.match(asked, urls.mine(table, 0.0, count, confidence), "k").collect()}
    for r in asked.collect():
        assert hits.get(r["k"], 0) == sum(set(s) <= set(r["tokens"]) for s in want)


def test_labels_of_the_given_tables_support_no_rule_at_the_limits(spark):
    table = labelled(spark, "sf0.1")
    baskets = [(r["tokens"], r["bad"]) for r in table.collect()]
    want, known = brute_rules(baskets, max(20, 0.002 * len(baskets)), 0.6)
    assert not want and urls.mine(table).count() == 0
    assert max(known.values()) < 0.6  # the best combination of tokens is bad in well under three of five pages


def test_no_link_of_the_given_tables_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    # Brute force over pairs that share a shingle.
    want = brute_components(rows, 2) if len(rows) <= 1000 else {}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nearsets.link(docs, size=2).collect()}
    assert got == want
    sizes = defaultdict(int)
    for _, c in want.values():
        sizes[c] += 1
    assert sum(n - 1 for n in sizes.values()) > 50
