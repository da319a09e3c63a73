import collections

import corpus_pipeline as P
from sleevenotes.llm import encoding, mixing, pieces


def test_stages_keep_the_columns_and_work_on_what_is_left(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    result = P.run(spark, small)
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "pieces"]
    assert result.columns == ["doc_id", "n_tokens", "ids"]
    ids = {r["doc_id"] for r in result.select("doc_id").distinct().collect()}
    assert ids <= {r["doc_id"] for r in documents.select("doc_id").collect()}
    assert result.groupBy("doc_id").count().filter("count > 2").count() == 0
    assert result.filter("n_tokens != size(ids)").count() == 0


def test_mixing_takes_rows_with_null_and_repeated_ids_once_each(spark):
    words = lambda k: " ".join(f"w{k}" for _ in range(1 + k % 7))
    rows = [(None if k % 3 == 0 else k // 2, words(k), "en", "abc"[k % 3 if k % 5 else 0]) for k in range(240)]
    rows += [(None, "same row", "en", "b")] * 5 + [(7, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = collections.Counter(tuple(r) for r in P.mixed(spark, docs, "").collect())
    have = collections.Counter(rows)
    assert all(n <= 2 * have[r] for r, n in got.items())
    size = lambda r: len((r[1] or "").split())
    targets = {r["source"]: r["target"] for r in mixing.mix(mixing.with_size(docs)).select("source", "target").distinct().collect()}
    for s, target in targets.items():
        assert abs(sum(n * size(r) for r, n in got.items() if r[3] == s) - target) <= max(size(r) for r in rows if r[3] == s) + 1e-6


def fixture_rows():
    import random

    r = random.Random(3)
    words = [f"{a}{b}" for a in ("der", "the", "und", "house", "wort") for b in ("", "s", "ung", "ing", "er")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, shared = text(80), "a passage that several documents share word for word, well over fifty bytes long "
    rows = [(1, base), (2, base), (3, base + " tail"), (None, base), (4, text(60)), (4, text(70)), (5, shared + text(40)), (6, text(40) + " " + shared + text(20)), (7, None), (8, ""), (9, "!!! ... 123"), (None, text(50)), (None, text(55))]
    return [(i, t, ("en", "de", None)[k % 3], ("s1", "s2", None)[k % 3], len(t or ""), "x", 1.0) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size double"


def test_stages_against_brute_force(spark):
    from test_operators import brute_components, brute_repeats

    rows = fixture_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = P.near_deduplicated(spark, docs, "")
    assert kept.columns == docs.columns
    # Each row is a document of its own; of a component the row of the smallest id stays.
    numbered = [(k, t) for k, (_, t, *_) in enumerate(rows)]
    parts = collections.defaultdict(list)
    for k, (_, part) in brute_components(numbered, 5).items():
        parts[part].append(k)
    stay = [min(ks, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for ks in parts.values()]
    assert sorted(map(str, (tuple(x) for x in kept.collect()))) == sorted(str(rows[k]) for k in stay)

    left = P.without_repeats(spark, kept, "")
    assert left.columns == docs.columns
    removed = {(i, n): gone for i, n, gone, *_ in brute_repeats([(x["doc_id"], x["text"]) for x in kept.collect()])}
    before = {(x["doc_id"], x["source"], x["lang"]): x["text"] for x in kept.collect()}
    for x in left.collect():
        old = before[x["doc_id"], x["source"], x["lang"]]
        assert len((old or "").encode()) - len((x["text"] or "").encode()) == removed[x["doc_id"], len((old or "").encode())]

    ids = {(x["doc_id"], x["n_tokens"]): x["ids"] for x in P.encoded(spark, left, "").collect()}
    encoder = encoding.Encoder(pieces.load())
    assert sorted(map(str, ids)) == sorted(str((x["doc_id"], 0 if x["text"] is None else len(encoder.encode(x["text"])))) for x in left.collect())


def test_language_stage_keeps_clean_documents(spark):
    rows = [r for r in fixture_rows()]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = P.identified(spark, docs, "")
    texts = collections.Counter(x["text"] for x in kept.collect())
    assert kept.columns == docs.columns and texts == collections.Counter(t for _, t, *_ in rows if t and any(c.isalpha() for c in t))
    assert P.identified(spark, docs.limit(0), "").count() == 0


def test_run_bears_an_empty_table_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    for name, df in (("full", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        result = P.run(spark, f"{tmp_path}/{name}")
        assert result.columns == ["doc_id", "n_tokens", "ids"] and (result.count() > 0) == (name == "full")
