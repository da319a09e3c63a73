"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontamination, encoding, fingerprints, html, langid, mixing, nearsets, negatives, quality, sharding, suffixes, urls
from .common import read

#: DuckDB: CRC-32 of a text's UTF-8 bytes, by the usual table.
CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def crc_sql(text: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def op1_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("score")


def _op1_sql(threshold: int = -50_000, buckets: int = 16384, max_trusted: int = 20_000) -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws, row_number() OVER () AS r FROM documents
), base AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines FROM worded
), windows AS (
  SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)
), twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), occurrences AS (SELECT r, i, ws[i] AS w, lead(ws[i]) OVER (PARTITION BY r ORDER BY i) AS v FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded)
), vocabulary AS (SELECT w, {crc_sql("w")} AS h FROM (SELECT DISTINCT w FROM occurrences), {CRC_TABLE}
), grams AS (
  SELECT r, a.h % {buckets} AS bucket FROM occurrences o JOIN vocabulary a ON o.w = a.w
  UNION ALL SELECT r, (a.h * 31 + b.h) % {buckets} FROM occurrences o JOIN vocabulary a ON o.w = a.w JOIN vocabulary b ON o.v = b.w
), trusted AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL), {CRC_TABLE}
  ORDER BY {crc_sql("CAST(doc_id AS VARCHAR)")}, doc_id LIMIT {max_trusted}
), counts AS (
  SELECT bucket, count(*) AS raw, count(t.doc_id) AS target FROM grams JOIN worded w USING (r) LEFT JOIN trusted t ON w.doc_id = t.doc_id GROUP BY bucket
), totals AS (SELECT sum(raw) AS rs, sum(target) AS ts FROM counts
), model AS (SELECT bucket, CASE WHEN ts > 0 THEN CAST(round((ln((target + 1) / (ts + {buckets})) - ln((raw + 1) / (rs + {buckets}))) * 1e6) AS BIGINT) ELSE 0 END AS weight FROM counts, totals
), scores AS (SELECT r, count(*) AS n_ngrams, CAST(sum(weight) AS BIGINT) AS score_micro FROM grams JOIN model USING (bucket) GROUP BY r
), joined AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_ngrams, 0) AS n_ngrams, coalesce(score_micro, 0) AS score_micro
  FROM base LEFT JOIN repeats USING (r) LEFT JOIN scores USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND score_micro >= {threshold} * n_ngrams AS kept
FROM joined"""


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op3_level_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(read(spark, sf_dir, "documents"))


def held_out():  # noqa: ANN201
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op5_forward_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, table = langid.learn(docs.filter(~held_out()).select("text", "lang"))
    predicted = langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), langs, table)
    return predicted.drop("text")


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op7_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, CRC-32 of the ids (as little-endian 32-bit numbers), and whether decoding gives the text back."""
    return encoding.encode(read(spark, sf_dir, "documents"), digest=True)


SHARDS, SHARD_SEED, SHARD_BLOCKS = 24, 20260101, 4096


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    bytes_ = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    keys = docs.select("doc_id", (F.octet_length(bytes_) + 8).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    block = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    dealt = sharding.deal(keys, block, SHARDS, SHARD_SEED, SHARD_BLOCKS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _op8_sql() -> str:
    f = lambda x: sharding.feistel_sql(x, "a", "b", SHARD_SEED, "//", "xor({}, {})")
    return f"""
WITH keys AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % {SHARD_BLOCKS} AS block
  FROM documents, {CRC_TABLE}
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM keys
), radices AS (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered
), sized AS (SELECT *, (n + a - 1) // a AS b FROM radices
), first AS (SELECT *, {f("x")} AS y FROM sized
), walked AS (
  SELECT *, list_reduce(list_prepend(y, range(1, {sharding.MAX_WALK + 1})), lambda v, i: CASE WHEN v < n THEN v ELSE {f("v")} END) AS z FROM first
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(z % {SHARDS} AS INTEGER) AS shard, CAST(z // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walked"""


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.with_size(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", F.col("copies").cast("int").alias("copies"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = nearsets.link(read(spark, sf_dir, "documents"), size=2)
    return linked.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op11_value_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read(spark, sf_dir, "embeddings"))
    digest = F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest())
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _finite_sql(scale: int) -> str:
    """Rows of embeddings that have a vector of finite numbers, and those numbers times ``scale``, floored."""
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"""


def _op11_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    steps = [f"""whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM ({_finite_sql(codes.SCALE)})
), cut AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM (SELECT r, v, unnest(range({parts})) AS p FROM whole)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM cut WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""near{n} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, min(struct_pack(d, k)) AS best
  FROM (SELECT r, cut.p, x, k, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM cut JOIN book{n} b ON cut.p = b.p) GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""mean{n} AS (
  SELECT p, k, list(m ORDER BY i) AS c FROM (
    SELECT p, best.k AS k, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{n}) GROUP BY p, best.k, i
  ) GROUP BY p, k
), book{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.k = m.k)""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT r, string_agg(lpad(to_hex(best.k), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN whole USING (r), digest"""


def op12_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def _op12_sql() -> str:
    return f"""
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM ({_finite_sql(negatives.SCALE)}) WHERE label IS NOT NULL
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scored n USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score QUALIFY rank <= 5"""


def op13_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _op13_sql(size: int = decontamination.SIZE) -> str:
    ws = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, {ws} AS ws FROM documents
), items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {ws} AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, ws[i:i + least(len(ws), {size}) - 1] AS w, least(len(ws), {size}) AS n FROM (SELECT *, unnest(range(1, greatest(len(ws) - {size}, 0) + 2)) AS i FROM items WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM windows
), hits AS (
  SELECT r, f, n, item FROM (SELECT r, n, i AS f, ws[i:i + n - 1] AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM worded, lengths)) JOIN windows USING (n, w)
), covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(f, f + n)) AS j FROM (SELECT DISTINCT r, f, n FROM hits)) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_llr, op2_url_rules, op3_level_suffixes, op4_bottom_k, op5_forward_langid, op6_wrapper_text, op7_max_plus_pieces, op8_feistel_shards, op9_entropy_mix, op10_chosen_path, op11_value_dictionaries, op12_four_russians, op13_benchmark_ngrams)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_llr": _op1_sql(), "op8_feistel_shards": _op8_sql(), "op11_value_dictionaries": _op11_sql(), "op12_four_russians": _op12_sql(), "op13_benchmark_ngrams": _op13_sql()}
