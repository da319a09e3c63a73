"""Vector codes, hard negatives and decontamination against brute-force versions, with the cases that each must bear."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleevenotes.llm import codes, decontamination, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, row long, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 1, 1) for i, v, label in rows], VECTORS).repartition(3)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def as_float(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.fixture(scope="module")
def crowd():
    """Copies, ties, null and repeated ids, null labels, bad vectors, a hot label."""
    r = random.Random(11)
    rows = [(k * 5 if k % 3 else k, as_float([r.gauss(0, 0.2) for _ in range(16)]), (None, 1, 1, 2, 3)[k % 5]) for k in range(240)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(20)] + [(None, rows[9][1], 2), (None, as_float([0.5] * 16), 1), (300, as_float([0.25] * 16), 1), (300, as_float([0.25] * 16), 1), (300, as_float([-0.25] * 16), 2)]
    bad = [(5000, None, 1), (5001, as_float([None] + [0.1] * 15), 1), (-5, as_float([float("nan")] + [0.1] * 15), 2), (-6, as_float([float("inf")] + [0.1] * 15), 2)]
    seen, distinct = set(), []
    for row in rows:  # ids repeat only where they are meant to
        if row[0] is None or row[0] == 300 or row[0] not in seen:
            distinct.append(row)
        seen.add(row[0])
    return distinct, bad


# 11


def brute_codes(rows, parts, entries, rounds, scale):
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    whole = sorted(((i, [math.floor(x * scale) for x in v], label) for i, v, label in rows), key=order)
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in whole:
                met.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(col) // len(met[k]) for col in zip(*met[k])] if k in met else c for k, c in enumerate(books[p])]
    out = []
    for i, v, label in whole:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), digest


@pytest.mark.parametrize("block", [codes.BLOCK, 37])
def test_codes_match_brute_force(spark, crowd, block):
    rows, bad = crowd
    coded, books = codes.compress(vectors(spark, rows + bad), parts=4, entries=7, rounds=4, scale=50, block=block)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_label_errors(coded).collect()), key=str)
    want, digest = brute_codes(rows, 4, 7, 4, 50)
    assert got == want and books.sha256 == digest
    one = got[0]
    assert len(books.vector(one[1])) == 16


def test_codes_few_empty_odd_lengths(spark):
    rows = [(2, as_float([0.1] * 8), 1), (1, as_float([-3.7] * 8), None), (3, as_float([0.1] * 8), 1)]
    coded, books = codes.compress(vectors(spark, [*rows, (4, [], 1), (5, as_float([1.0] * 16), 1), (6, as_float([1.0] * 9), 1)]))
    got, digest = brute_codes(rows, 8, 16, 6, 4096)
    assert books.sha256 == digest and books.entries.shape == (8, 3, 1)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.with_label_errors(coded).collect()), key=str) == got
    coded, books = codes.compress(vectors(spark, []))
    assert books is None and codes.with_label_errors(coded).count() == 0
    with pytest.raises(ValueError):
        codes.compress(vectors(spark, [(1, as_float([1.0] * 9), 1)]))
    _, books = codes.compress(vectors(spark, [(k, as_float([3e38] * 8), 1) for k in range(3)]))
    assert (books.entries == codes.BOUND).all()


def test_codes_with_text_ids_and_labels(spark):
    rows = spark.createDataFrame([(f"v{k}", [k / 10] * 8, "ab"[k % 2]) for k in range(30)], "vec_id string, embedding array<double>, label string")
    coded, _ = codes.compress(rows)
    assert coded.count() == 30 and {r["label"] for r in coded.collect()} == {"a", "b"}


# 12


def test_four_russians_scores():
    r = np.random.default_rng(4)
    for low, high in ((-300, 300), (0, 1), (-1, 1), (-(1 << 24), 1 << 24), (0, 1 << 24)):
        a, b = r.integers(low, high, (9, 24)), r.integers(low, high, (50, 24))
        assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(b)) == b @ a.T).all()
        # Vectors of unequal length: what one lacks counts as zero.
        assert (negatives.scores(negatives.subset_sums(a[:, :8]), negatives.bit_planes(b)) == b[:, :8] @ a[:, :8].T).all()
        assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(b[:, :16])) == b[:, :16] @ a[:, :16].T).all()
    assert [negatives.least_negative(p, 80) for p in (0, 1, 5, 6)] == [0, 1, 4, 5]


def brute_negatives(rows, positives=5, count=5, low=80, scale=256):
    whole = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if label is not None]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, (i, v, label) in enumerate(whole):
        if i is None or i % 10:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other == label) for m, (j, w, other) in enumerate(whole) if m != k]
        for p, j, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            fits = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= 100 * p), key=order)[:count]
            out += [(i, j, n + 1, m, p, q) for n, (q, m, _) in enumerate(fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "chunk"), [(negatives.BLOCK, negatives.CHUNK), (17, 3)])
def test_negatives_match_brute_force(spark, crowd, block, chunk):
    rows, bad = crowd
    found = negatives.mine(vectors(spark, rows + bad), F.col("vec_id") % 10 == 0, block=block, chunk=chunk)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    want = brute_negatives(rows)
    assert len(want) > 50 and got == want


def test_negatives_send_the_best_of_a_task_not_of_every_block(spark, monkeypatch):
    """Chunks of anchors meet blocks without a copy for each, and what is sent does not grow with their number."""
    monkeypatch.setattr(negatives, "BAND", 1 << 20)
    rng = np.random.default_rng(12)
    rows = [(i, as_float(v), i % 2) for i, v in enumerate(rng.random((600, 8)))]
    narrow = vectors(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), "embedding", (F.col("vec_id") % 20 == 0).alias("anchor"))
    blocks = negatives.numbered(negatives.settle(negatives.packed(narrow.coalesce(1), block=4)))
    met = negatives._met(blocks, negatives._own(blocks), 2, blocks.count())
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode(sequence" not in plan
    tasks = met.rdd.getNumPartitions()
    assert blocks.count() == 150 and met.count() >= 150 * 8
    assert negatives._positives(met, 5).count() <= 30 * 5 * tasks < 30 * 4 * 150


def test_negatives_empty_and_alone(spark):
    anchor = F.col("vec_id") % 100 == 0
    assert negatives.mine(vectors(spark, []), anchor).count() == 0
    assert negatives.mine(vectors(spark, [(0, as_float([0.1] * 8), 1)]), anchor).count() == 0
    assert negatives.mine(vectors(spark, [(0, [], 1), (1, [], 1), (2, as_float([0.1]), 2)]), anchor).collect() == [(0, 1, 1, 2, 0, 0)]


# 13


def brute_leaks(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaky(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(3)) for _ in range(40)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    common = text(25)
    items = [(1, text(30)), (2, text(12)), (3, "Only Three words"), (4, None), (5, ""), (6, "x " + common), (7, common + " y"), (7, text(11)), (None, text(10)), (10, "..."), (11, "solo")]
    passage = items[0][1]
    docs = [(1, None), (2, ""), (3, passage), (4, text(20) + "\n" + passage.upper() + "! " + text(5) + " " + passage), (5, "only; THREE, words... and only three"), (6, text(3000) + " " + common + " " + items[1][1]), (7, " ".join(passage.split()[:9]))]
    docs += [(8, passage), (8, passage), (8, text(30)), (None, common), (None, common), (12, passage + " " + passage[:40]), (13, "a solo b"), (14, items[8][1] + " " + items[7][1])]
    docs += [(100 + k, common + f" end{k % 3}") for k in range(60)]
    frame = spark.createDataFrame([(i, t, 1, 2, "g", "h") for i, t in docs], "doc_id long, text string, at int, upto int, group string, words string").repartition(3)
    return docs, items, frame, spark.createDataFrame([(i, t, "w") for i, t in items], "item_id int, text string, words string")


@pytest.mark.parametrize("at_once", [decontamination.AT_ONCE, 7])
def test_leaks_match_brute_force(leaky, at_once):
    docs, items, frame, benchmark = leaky
    found = decontamination.find(frame, benchmark, at_once=at_once).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_leaks(docs, items)


def test_leaks_removed(spark, leaky):
    docs, items, frame, benchmark = leaky
    clean = {k for k, r in zip(range(len(docs)), [brute_leaks([d], items)[0] for d in docs]) if not r[5]}
    left = decontamination.remove(frame, benchmark, whole=True)
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((docs[k][0] for k in clean), key=str)
    cut = decontamination.remove(frame, benchmark)
    assert cut.columns == frame.columns and cut.count() == len(docs)
    told = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str)
    assert (13, "a  b") in told and (3, "") in told and (1, None) in told and (5, "... and only three") in told
    untouched = {(d, t) for k, (d, t) in enumerate(docs) if k in clean}
    assert untouched <= set(told)


def test_leaks_empty_tables(spark, leaky):
    _, _, frame, benchmark = leaky
    assert decontamination.find(frame.limit(0), benchmark).count() == 0
    none = decontamination.find(frame, benchmark.limit(0))
    assert none.count() == frame.count() and not none.filter("contaminated OR n_items > 0 OR items_sha256 != sha2('', 256)").count()
    assert decontamination.remove(frame, benchmark.limit(0)).exceptAll(frame).count() == 0


def test_leaks_plan_is_native_and_in_one_stage(spark, small):
    found = queries.op13_benchmark_ngrams(spark, small)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())
    docs = spark.read.parquet(f"{small}/documents.parquet")
    part = decontamination.windows(spark.read.parquet(f"{small}/benchmark.parquet")).withColumn("group", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = decontamination._hits(decontamination.keyed(docs), part, [10])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Runs, look-up and proof stand in one stage of generated code: no row of a run and its document's words is ever written.
    assert re.search(r"\*\(\d+\) Project[^\n]*\n[^\n]*\*\(\d+\) BroadcastHashJoin[^\n]*\n(?:[^\n]*\*\(\d+\) (?:Filter|Project)[^\n]*\n)*[^\n]*\*\(\d+\) Generate", plan), plan
