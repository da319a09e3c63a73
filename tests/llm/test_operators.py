"""Operators against brute-force versions, and the cases that each must bear: nulls, empty texts, copies, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleevenotes.llm import encoding, fingerprints, html, langid, mixing, nearsets, pieces, quality, queries, sharding, suffixes, urls
from sleevenotes.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, shard int, kept boolean, n long, rate double, copies int, key string, extra string, host string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties and copies, a very long text, and columns whose names clash with those the operators make."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(90)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, base), (6, base), (7, base + " tail"), (8, text(70)), (9, text(4000)), (10, "日本語 ▁ é 😀"), (11, "x" * 3000), (None, base), (12, text(60) + "\n" + text(60))]
    full = [(i, t, ("en", "fr", None)[k % 3], ("s1", None, "s2")[k % 3], 1, 1, 1, True, 1, 1.0, 1, "k", "e", "h") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS + EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


# 1


def test_quality_base_counts(spark):
    t = "a b c a b c d\n\n a b c a b c d\nx# y$\n \nx# y$"
    got = rows_of(quality.base_counts(quality.words(spark.createDataFrame([(1, t), (2, None), (3, "a b")], "doc_id long, text string"))))
    one = got[0]
    words = t.split()
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert (one["n_words"], one["word_chars"], one["n_symbols"], one["n_dup_lines"], one["n_repeat_words"]) == (len(words), sum(map(len, words)), 4, 1, len(covered))
    assert [got[1][k] for k in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words")] == [0, 0, 0, 0]
    assert got[2]["n_repeat_words"] == 0


def test_quality_verdicts(spark, odd, none):
    good, bad = " ".join(f"w{i % 60}" for i in range(0, 300, 1)), " ".join(f"w{i % 60}&&&" for i in range(0, 295, 7))
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(80))) for i in range(30)] + [(100 + i, " ".join(f"j{(i * 7 + k * k) % 97}%%%" for k in range(80))) for i in range(10)] + [(200, good), (201, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (100, 0, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality.judge(docs, labels))}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(10)) and not kept[201]
    got = rows_of(quality.judge(odd, labels))
    assert len(got) == odd.count() and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality.judge(none, labels).count() == 0
    assert all(r["score_micro"] == 0 for r in rows_of(quality.judge(docs, labels.limit(0))))


# 2


def test_url_parts_and_fixed_rules(spark):
    cases = [
        ("http://A.Example.org/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"), ("x://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"), ("http://b.org/", "b.org", "/", "org/", "allow"),
        ("http://corp/fr/", "corp", "/fr/", None, "allow"), ("https://q.com/de/1", "q.com", "/de/1", "com/de/", "block"), ("https://q.com?x=/de/", "q.com", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string").repartition(2)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(urls.judge(pages, labels))}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_url_mined_rules(spark):
    rows = [(i, f"http://h{i % 5}.net/{'spam' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)]
    got = rows_of(urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert len(got) == 400 and all((r["verdict"] == "block") == (r["page_id"] % 4 == 0) for r in got)
    mined = urls.mine(spark.createDataFrame([(["a", "b"], True)] * 30 + [(["a"], False)] * 30, "tokens array<string>, bad boolean"))
    assert [r["antecedent"] for r in rows_of(mined)] == [["b"]]


# 3


def brute_repeats(rows):
    first, out = {}, []
    ordered = sorted((2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows)
    for i, b in ordered:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in ordered:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if i == 2**63 - 1 else i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_repeats_match_brute_force(spark, monkeypatch, block):
    r = random.Random(3)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    base = ["".join(r.choice("abcdéf \n") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(60):
        text = "".join(x[r.randint(0, 200) : r.randint(200, 400)] if r.random() < 0.7 else "z" * r.randint(0, 120) for x in r.sample(base, 3))
        rows.append((r.randint(0, 50) if i % 7 else None, text if i % 11 else None))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(x)[:5] for x in got.collect()), key=str) == brute_repeats(rows)


def test_repeats_odd_cases(spark, odd, none):
    got = suffixes.remove_repeats(odd)
    assert sorted((tuple(x)[:5] for x in got.collect()), key=str) == brute_repeats([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert suffixes.remove_repeats(none).count() == 0
    left = suffixes.without_repeats(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 6").count() == 0 and left.filter("doc_id = 1").first()["text"] is None


def test_level_index_grows_geometrically():
    index = suffixes.LevelIndex()
    for b in range(16):
        key = np.arange(b * 100, b * 100 + 150, dtype=np.uint64)
        found = index.add({"key": key, "doc": np.full(150, b, np.int64)})
        assert found.sum() == (50 if b else 0)
    assert len(index.levels) <= 5 and len(index.whole()["key"]) == 1650


# 4


def test_fingerprints(spark, odd, none):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprint_neighbours(odd, blocks=4))}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        a, b = (set(zip(*[x.split()[j:] for j in range(5)])) for x in (t, following))
        if a and b and len(a | b) <= fingerprints.K:
            assert math.isclose(got[i]["near_next"], len(a & b) / len(a | b))
    assert got[5]["fingerprint"] == got[6]["fingerprint"]
    assert fingerprints.fingerprint_neighbours(none).count() == 0
    one = rows_of(fingerprints.fingerprint_neighbours(odd.filter("doc_id = 8")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 5000, np.uint64), r.integers(0, 2**63, 5000, np.uint64)
    b[:3000] = a[:3000]
    sa, sb = fingerprints.bottom(a), fingerprints.bottom(b)
    assert (fingerprints.merge(sa, sb) == fingerprints.bottom(np.concatenate([a, b]))).all()
    assert abs(fingerprints.resemblance(sa, sb) - 3000 / 7000) < 0.15
    assert abs(fingerprints.containment(sa, sb) - 0.6) < 0.2
    assert (fingerprints.from_text(fingerprints.to_text(sa)) == sa).all()


# 5


def test_forward_sums_all_segmentations():
    v = pieces.load()
    f = langid.Forward(v, langid.zipf(v))

    def total(w):
        if not w:
            return 1.0
        p = lambda x: f.table[v.ids[x], 0] if x in v.ids else (f.BYTE ** len(x.encode()) if len(x) == 1 else 0.0)
        return sum(p(w[:j]) * total(w[j:]) for j in range(1, min(len(w), v.longest) + 1))

    for w in (" theing", " ñque", " 一😀x", " a"):
        assert math.isclose(math.log(total(w)), f.log_sums([w])[0, 0], rel_tol=1e-9)
    assert math.isclose(sum(e * len(s) for s, e in zip(v.surfaces, f.expected([" thing"], np.array([2.0]), 0))), 12, rel_tol=1e-6)


def test_langid_held_out(spark, small):
    got = queries.op5_forward_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"])


def test_langid_odd_cases(spark, odd, none):
    langs, table = langid.learn(odd.select("text", "lang"))
    assert langs == ["en", "fr"] and np.allclose(table.sum(axis=0), 1)
    got = {r["doc_id"]: r for r in rows_of(langid.predict(odd, langs, table))}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3)) and got[10]["lang_pred"] in langs
    empty, nothing = langid.learn(none.select("text", "lang"))
    assert empty == [] and all(r["lang_pred"] == "und" for r in rows_of(langid.predict(odd, empty, nothing)))


# 6


PAGE = """<!doctype html><html><head><title>T</title><script>var x="</p>";</script></head><body><nav><ul><li><a href=/>{0}</a></ul></nav><div class="ad banner">buy {0}</div>
<article><h1>Head&nbsp;{0}</h1><p>Read this first<p><b>One {0}<br>two &amp; <i>th</i>ree<p>{1}</p></article><div id=comments><p>reader {0}</p></div><footer>&copy; {0}</footer></body></html>"""


def test_wrapper_text(spark):
    rows = [(i, f"http://a.net/{i}", PAGE.format(f"n{i}", f"last {i}")) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "http://b.net/", "<p>only <b>this</b>"), (23, "http://b.net/", "plain &lt;text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1 << 20, 0):  # broadcast, and joined with salt
        got = {r["page_id"]: r["text"] for r in rows_of(html.extract(pages, broadcast_bytes=size))}
        assert all(got[i] == f"Head n{i} One n{i} two & three last {i}" for i in range(8))
        assert (got[20], got[21], got[22], got[23]) == ("", "", "only this", "plain <text")


def test_wrapper_text_counts_all_pages_of_a_host(spark):
    # Of each host's 100 pages 85 have the same first line (content), and 95 the same last one (template).
    page = "<div class=top><p>{}</p></div><div class=text><p>body {}</p></div><div class=end><p>{}</p></div>"
    filled = lambda h, i: page.format("often here" if i % 20 >= 3 else f"top {h} {i}", f"{h} {i}", "nearly always" if i % 20 else f"end {h} {i}")
    rows = [(100 * h + i, f"http://h{h}.net/{i}", filled(h, i)) for h in range(10) for i in range(100)]
    rows += [(1000 + i, "http://h0.net/0", filled(0, 0)) for i in range(40)]  # copies count once
    got = {r["page_id"]: r["text"] for r in rows_of(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    for h in range(10):
        for i in range(100):
            assert got[100 * h + i] == " ".join(["often here" if i % 20 >= 3 else f"top {h} {i}", f"body {h} {i}"] + ([] if i % 20 else [f"end {h} {i}"]))
    assert all(got[1000 + i] == got[0] for i in range(40))


def test_wrapper_text_keeps_what_articles_share(spark):
    bare = "<div class=top><p>Our site</p></div><div class=text>{}</div>"
    marked = "<div class=top><p>Our site</p></div><article>{}</article>"
    shared = "<h1>Title</h1><p>a long paragraph in every copy of it<p>and one more that is also in all<p>"
    quote = "<h2>Rare</h2><blockquote>said by all three</blockquote>"
    rows, wanted = [], {}
    for h, (page, n) in enumerate((p, n) for p in (bare, marked) for n in (3, 12)):
        for i in range(n):  # near-copies of one article and nothing else
            rows.append((100 * h + i, f"http://copies{h}.net/{i}", page.format(f"{shared}word{i}")))
            wanted[100 * h + i] = f"Title a long paragraph in every copy of it and one more that is also in all word{i}"
    for h, page in enumerate((bare, marked)):
        for i in range(30):  # nodes that three articles have, with the same text
            rows.append((1000 + 100 * h + i, f"http://rare{h}.net/{i}", page.format(f"<p>first {i}</p>{quote if i < 3 else ''}<p>last {i}")))
            wanted[1000 + 100 * h + i] = f"first {i} {'Rare said by all three ' if i < 3 else ''}last {i}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in rows_of(html.extract(pages))} == wanted


def test_side_words_are_whole_tokens_and_spare_what_wraps_the_article():
    for wrapped in (
        "<body class='has-sidebar'><p>text</p></body>", "<body class='search-enabled'><p>text</p>", "<body class=search><main id=comments><p>text</p></main></body>", "<article class='post comment-open'><p>text</p></article>",
        "<div id='content-with-sidebar'><p>text</p></div>", "<article><div class='article-header'><h1>text</h1></div></article>", "<p><span class='no-ads'>text</span>",
    ):
        assert html.main_text(wrapped + "<div class='wide sidebar'>side</div><div id=ad-1>buy</div><p><span class=share>send</span>", None) == "text"


def test_tree_matching_counts_nodes():
    a, b = (html.blocks(p)[0] for p in ("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>", "<div><h1>x</h1><section>y</section><ul><li>z</ul></div>"))
    assert html.Matching(a, b).total == 5
    both = html.merge(a, b)
    assert [c.sign for c in both.children[0].children] == ["h1", "section", "p", "ul"]


# 7


def in_chunks(e, parts):
    """Ids by chunks, step by step, without Spark."""
    begin = np.where(np.arange(e.v.longest) == 0, 0, pieces.NEVER)
    forward = encoding.prefixes([e.transfer(*p) for p in parts], begin)
    exits = encoding.choose_states([e.entries(*p, f) for p, f in zip(parts, forward)])
    return [k for p, f, x in zip(parts, forward, exits) for k in e.backtrace(*p, f, x)]


def test_chunks_keep_to_one_rule_among_equal_segmentations():
    e = encoding.Encoder(pieces.load())
    r = random.Random(8)
    for _ in range(150):
        text = " " + "".join(r.choice(["x", "xx", "e", "ee", "aa", "s", "ing", " ", "  "][: r.randint(1, 9)]) for _ in range(r.randint(1, 120)))
        size = r.randint(1, 40)
        parts = [(text[i : i + size + e.v.longest], min(size, len(text) - i)) for i in range(0, len(text), size)]
        assert in_chunks(e, parts) == e.encode(text[1:])


def test_encoding_round_trip_and_chunks(spark, odd, none):
    e = encoding.Encoder(pieces.load())
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choice(["abc", "the ", "  ", "\n", "▁", "中", "é", "😀", "ing", ", "]) for _ in range(r.randint(0, 150)))
        ids = e.encode(text)
        assert e.decode(ids) == text
        t, size = " " + text, r.randint(3, 60)
        parts = [(t[i : i + size + e.v.longest], min(size, len(t) - i)) for i in range(0, len(t), size)]
        assert in_chunks(e, parts) == ids
    for giant in (1 << 20, 1000):
        got = encoding.encode(odd, giant=giant)
        assert got.count() == odd.count()
        back = {(x["doc_id"], x["text"]) for x in rows_of(encoding.decode(got))}
        assert back == {(x["doc_id"], x["text"]) for x in odd.collect()}
        assert all(x["round_trip"] for x in rows_of(encoding.encode(odd, digest=True, giant=giant)) if x["doc_id"] != 1)
    assert encoding.encode(none).count() == 0


def test_transfer_matrices_combine_associatively():
    r = np.random.default_rng(4)
    a, b, c = (r.integers(-100, 0, (5, 5)) for _ in range(3))
    assert (encoding.product(encoding.product(a, b), c) == encoding.product(a, encoding.product(b, c))).all()


# 8


def test_shards_are_a_computable_permutation(spark, odd, none):
    keys = spark.range(500).select((F.col("id") % 400).alias("doc_id"), F.lit(None).cast("string").alias("t"))
    got = rows_of(sharding.deal(keys, F.crc32(F.col("doc_id").cast("string").cast("binary")), 24, 9, 16))
    places = sorted((r["shard"], r["slot"]) for r in got)
    assert places == sorted((x % 24, x // 24) for x in range(500))
    for r in got[:80]:
        assert sharding.place_of(r["row_number"], 500, 24, 9) == (r["shard"], r["slot"])
        assert sharding.number_at(r["shard"], r["slot"], 500, 24, 9) == r["row_number"]
    for n in (1, 2, 3, 7, 100):
        assert sorted(sharding.place_of(i, n, 1)[1] for i in range(n)) == list(range(n))
    block = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    assert sharding.deal(odd.select("doc_id"), block, 24).count() == odd.count()
    assert sharding.deal(none.select("doc_id"), block, 24).count() == 0


# 9


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(spark, odd, none):
    r = random.Random(6)
    rows = [(i, r.choice(["b", "a", "c", "é", None, "z"]) if i % 3 else "a", int(r.paretovariate(1.2) * 20)) for i in range(900)] + [(1000 + i, "small", 0) for i in range(5)] + [(7, "dup", 100)] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), split=50).toPandas()
    assert len(got) == len(rows) and got["copies"].between(0, 2).all()
    sizes = collections.defaultdict(int)
    largest = collections.defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    target = brute_targets(sizes)
    got["taken"] = got["copies"] * got["size"]
    for s in sizes:
        own = got[got["source"].isna() if s is None else got["source"] == s]
        assert abs(own["target"].iloc[0] - target[s]) < 1e-6 * max(1, target[s]) and abs(own["taken"].sum() - target[s]) <= own["size"].mean() + 1
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7), split=50).toPandas()
    order = ["doc_id", "size", "copies"]
    assert got[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()
    assert mixing.mix(mixing.with_size(odd)).count() == odd.count()
    assert mixing.mix(mixing.with_size(none)).count() == 0


# 10


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy).upper() if r.random() < 0.3 else "\t".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "solo"), (904, "SOLO")]


@pytest.mark.parametrize("small_node", [32, 2])
def test_near_duplicates_match_brute_force(spark, small_node):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(nearsets.link(spark.createDataFrame(rows, "doc_id long, text string"), size=2, small=small_node))}
    assert got == brute_components(rows, 2)


def test_near_duplicates_odd_cases(spark, odd, none):
    linked = nearsets.link(odd)
    got = {r["doc_id"]: r["component_id"] for r in rows_of(linked)}
    assert got[6] == 5 and got[7] == 5 and got[8] == 8 and got[None] == 5 and linked.count() == odd.count()
    kept = nearsets.keep_one(odd, linked)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12]
    assert nearsets.link(none).count() == 0


def test_near_duplicates_under_shared_and_null_ids(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randint(0, 300)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a), (5, b), (7, b + " tail"), (9, a), (None, c), (None, c + " tail"), (None, d), (11, d), (5, a), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = nearsets.link(docs)
    got = sorted((str(x["doc_id"]), x["n_shingles"] > 0, str(x["component_id"])) for x in rows_of(linked))
    assert got == sorted([("5", True, "5")] * 3 + [("7", True, "5"), ("9", True, "5")] + [("None", True, "None")] * 2 + [("None", True, "11"), ("11", True, "11"), ("None", False, "None"), ("6", False, "6")])
    kept = sorted(map(str, (tuple(x) for x in nearsets.keep_one(docs, linked).collect())))
    assert kept in [sorted(map(str, [(5, a), (5, b), (None, one), (11, d), (None, None), (6, "")])) for one in (c, c + " tail")]


def test_a_dense_group_is_compared_within_its_leaf(spark):
    # Copies of one text with edits of their own: few are linked with each other, but all are with the text itself.
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = list(base)
        for k in r.sample(range(100), 8 if i % 3 else 4):
            copy[k] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"o{i}_{k}" if k % 30 == 7 else w for k, w in enumerate(base[:70] + [f"t{k}" for k in range(30)]))) for i in range(60)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows_of(nearsets.link(spark.createDataFrame(rows, "doc_id long, text string"), size=1, small=8))}
    assert got == brute_components(rows, 1)


def test_survival_of_the_branching_process():
    assert math.isclose(nearsets.survival(1), 1 - (0.75 * 0.2 + 0.25 * 0.04))
    tokens = np.random.default_rng(3).integers(0, 2**32, (400, nearsets.MINWISE), np.uint64).astype(np.uint32)
    other = np.where(np.random.default_rng(5).random(tokens.shape) < 0.8, tokens, tokens + np.uint32(1))
    met = [len(set(nearsets.paths(x, 8, 3, 0.25)[:, 3].tolist()) & set(nearsets.paths(y, 8, 3, 0.25)[:, 3].tolist())) > 0 for x, y in zip(tokens, other)]
    assert sum(met) / len(met) > 0.98
    assert [len(nearsets.paths(tokens[0], 1000, 1, 0.25)) in range(1180, 1320), nearsets.depth_for(10**11, 32) > nearsets.depth_for(10**5, 32)] == [True, True]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in rows_of(components(edges))}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# Further cases


def test_wrapper_text_bears_deep_long_and_strange_pages(spark):
    deep = "<div>" * 3000 + "<p>low" + "</div>" * 3000
    mixed = "".join(f"<div class='{'mnopqrstuv'[k % 10]}{'mnopqrstuv'[k // 10 % 10]}'><p>t{k}" for k in range(2500))
    long = "<article>" + "".join(f"<p>para {k} &amp; more</p>" for k in range(20000)) + "</article>"
    rows = [(1, "http://d.net/1", deep, "x", 1), (2, "http://d.net/2", mixed, "x", 1), (3, "http://d.net/3", deep.replace("low", "other"), None, 1), (4, "http://l.net/", long, "x", 1), (4, "http://l.net/", long, "x", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template long")
    got = {(r["page_id"]): r["text"] for r in rows_of(html.extract(pages))}
    assert got[1] == "low" and got[3] == "other" and got[None] == ""
    assert got[2] == " ".join(f"t{k}" for k in range(2500)) and got[4] == " ".join(f"para {k} & more" for k in range(20000))
    assert html.extract(pages).count() == 6 and html.extract(pages.limit(0)).count() == 0


def brute_matching(a, b):
    """Simple tree matching by its table of all pairs of children."""
    if a.sign != b.sign:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + brute_matching(x, y))
    return table[-1][-1] + 1


def test_tree_matching_is_the_best_one():
    r = random.Random(12)

    def page(depth):
        return "".join(f"<div class={r.choice('abcd')}>{r.choice(['t', ''])}{page(depth - 1)}</div>" for _ in range(r.randint(0, 3))) if depth else "x"

    for _ in range(60):
        a, b = (html.blocks(page(4) + "end")[0] for _ in range(2))
        found = html.Matching(a, b)
        assert found.total == brute_matching(a, b) == len(found.pairs) + 1
        both = html.merge(html.Node.load(a.dump()), html.Node.load(b.dump()))
        assert both.count == a.count + b.count - found.total and html.Node.load(both.dump()).shape == both.shape


def test_mix_is_the_tilt_that_meets_the_targets(spark):
    r = random.Random(16)
    rows = [(i, "abc"[i % 3] if i % 7 else None, int(r.paretovariate(1.3) * 10)) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    for s in ("a", "b", "c", None):
        own = got[got["source"].isna() if s is None else got["source"] == s]
        sizes, target = own["size"].to_numpy(float), own["target"].iloc[0]
        rate = lambda m: np.minimum(2.0, 1.5 * np.exp(np.minimum(m * sizes / sizes.mean(), 700)))
        if target >= 2 * sizes.sum() * (1 - 1e-9):
            assert np.allclose(own["rate"], 2.0)
            continue
        lo, hi = -1000.0, 1000.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sizes * rate(mid)).sum() < target else (lo, mid)
        assert np.allclose(own["rate"], rate(lo), rtol=1e-5, atol=1e-6)
        assert abs((own["rate"] * sizes).sum() - target) < 1e-4 * target


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_is_near_the_targets_of_the_given_tables(spark, sf):
    got = mixing.mix(mixing.with_size(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")))
    sums = got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.avg("size").alias("mean"))
    assert not [r for r in rows_of(sums) if abs(r["taken"] - r["target"]) > min(0.01 * r["target"], r["mean"])]


def test_rounding_tracks_words():
    size, n, rate = np.array([900, 500, 40, 3]), np.array([1, 4, 5, 60]), np.array([0.2, 0.6, 1.4, 1.9])
    copies = mixing.rounded(size, n, rate, 2)
    assert (copies >= 0).all() and (copies <= 2 * n).all() and abs((copies * size).sum() - (rate * n * size).sum()) <= 1.5


def test_mix_ties_and_equal_rows(spark):
    rows = [(1, "a", 10)] * 9 + [(2, "a", 10)] * 4 + [(3, "b", 10), (None, None, 0), (4, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    one, two = (sorted((str(x["doc_id"]), x["copies"]) for x in rows_of(mixing.mix(docs.repartition(n)))) for n in (1, 5))
    assert one == two and len(one) == len(rows)


def test_encoding_is_the_best_segmentation():
    e = encoding.Encoder(pieces.load())
    score = {s: e.v.scores[k] for s, k in e.v.ids.items()}

    def best(text):
        if not text:
            return 0
        own = [score[text[:j]] + best(text[j:]) for j in range(1, min(len(text), e.v.longest) + 1) if text[:j] in score]
        return max(own + ([] if text[0] in score else [pieces.BYTE_SCORE * len(text[0].encode()) + best(text[1:])]))

    r = random.Random(21)
    for _ in range(120):
        text = "".join(r.choice(["a", "b", "th", "e", " ", "ing", "é", "中", "😀", ".", "\n", "of"]) for _ in range(r.randint(0, 8)))
        ids = e.encode(text)
        value = sum(e.v.scores[k] if e.v.surfaces[k] else pieces.BYTE_SCORE for k in ids)
        assert value == best(" " + text) and e.decode(ids) == text


def test_giant_texts_have_the_ids_of_small_ones(spark):
    r = random.Random(22)
    rows = [(i, "".join(r.choice(["word ", "the ", "a", "中文", "xx", ", ", "\n"]) for _ in range(3000))) for i in range(4)] + [(9, "x" * 30000), (10, " " * 30000), (11, "xxe" * 9000), (12, "ss" * 8192 + "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, giant = ({x["doc_id"]: x["ids"] for x in rows_of(encoding.encode(docs, giant=g))} for g in (1 << 20, 5000))
    assert small == giant  # one character over and over, too: many segmentations are equally good


def test_langid_fit_tells_gibberish_at_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL")
    langs, table = langid.learn(docs.select("text", "lang"))
    r = random.Random(7)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n)) for n in (1, 5, 500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*junk, "日本語 のテキスト", "...", None])], "doc_id long, text string")
    fit = {x["doc_id"]: x["fit"] for x in rows_of(langid.predict(rows, langs, table))}
    assert all(fit[i] < langid.NO_LANGUAGE for i in range(4)) and fit[4] is None and fit[5] is None
    told = rows_of(langid.predict(docs.select("doc_id", "text"), langs, table))
    assert all(x["fit"] > langid.NO_LANGUAGE for x in told if x["lang_pred"] != "und")
    assert min(len(x["text"]) for x in told) < 60


def test_langid_takes_letters_alone():
    assert langid.words("½ ② ³ 12 _") == [] and langid.words("a½b C²d") == ["a", "b", "c", "d"]


def test_forward_sums_of_long_words():
    v = pieces.load()
    f = langid.Forward(v, langid.zipf(v))
    r = random.Random(30)

    def total(w):
        logs = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            terms = []
            for i in range(max(0, j - v.longest), j):
                p = f.table[v.ids[w[i:j]], 0] if w[i:j] in v.ids else (f.BYTE ** len(w[i:j].encode()) if j == i + 1 else 0.0)
                if p:
                    terms.append(logs[i] + math.log(p))
            logs[j] = np.logaddexp.reduce(terms) if terms else -math.inf
        return logs[-1]

    for n in (20, 40, 64, 65, 200, 700):
        for letters in ("abcdeghinorst", "日本語字", "x"):
            word = "".join(r.choice(letters) for _ in range(n))
            cut = langid.parts(word, v.pairs)
            assert "".join(cut) == " " + word
            got = sum(f.log_sums([cut[i] for i in places]).sum() for places in langid.by_length(cut, together=True))
            assert math.isclose(got, total(" " + word), rel_tol=1e-9)
    assert math.isclose(sum(e * len(s) for s, e in zip(v.surfaces, f.expected([" " + "thing" * 20], np.array([2.0]), 0))), 2 * 101, rel_tol=1e-6)


def test_url_rules_mined_at_size(spark):
    # Bad are only the pages whose address has both words; either word alone is common among good ones.
    r = random.Random(40)
    rows = []
    for i in range(12000):
        words = [w for w in ("cheap", "pills") if r.random() < 0.3]
        rows.append((i, f"http://www{i % 9}.net/{'/'.join(words + ['item'])}/{i}?page={i}", set(words) == {"cheap", "pills"}))
    labels = [(i, 0 if bad else 1, 0) for i, _, bad in rows[:6000]] + [(1, None, None), (None, 0, 1)]
    pages = spark.createDataFrame([x[:2] for x in rows] + [(None, "http://a.net/cheap/pills"), (7, "http://z.net/" + "x" * 100000)], "page_id long, url string")
    got = rows_of(urls.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    by_url = {x["page_id"]: x["verdict"] for x in got if x["page_id"] is not None and x["page_id"] != 7}
    wrong = [i for i, _, bad in rows if i != 7 and (by_url[i] == "block") != bad]
    assert not wrong and len(got) == len(rows) + 2
    assert urls.judge(pages.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
