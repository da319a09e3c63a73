"""URL filters: fixed rules by host and path, and association rules mined from labels.

*Fixed rules.* A rule is a host and a path prefix; it fits its host and all subdomains when the URL's path starts with
its path. The longest rule that fits decides.

*Mined rules.* URLs of labelled pages become sets of tokens (scheme, host suffixes, path segments with digits folded,
query keys). Spark's FP-growth mines token combinations together with the class item; rules "these tokens => bad" are
kept if their confidence, support and count reach the limits, and pruned if a rule with fewer tokens, all among theirs,
has at least their confidence. Matching uses an inverted index: a rule is filed under that of its tokens that the fewest
URLs have, the tokens of a URL are looked up there, and a rule matches if all its tokens are in the URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no tokens, so only the default
verdict (allow) can hold; without labels nothing is mined; a page labelled twice is bad if one label says so; repeated
rows are judged alike; other columns play no part.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "class=bad"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    address = F.col(url)
    rest = F.when(F.instr(address, "://") > 0, F.substring(address, F.instr(address, "://") + 3, F.length(address)))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit("")))


def fixed_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits ``host`` and ``path``, or null."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    found = [F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*found))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(url, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([A-Za-z]+)://", 1)))
    return F.when(host != "", F.array_distinct(F.concat(scheme, F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), segments, keys))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.6) -> DataFrame:
    """``rule_id, antecedent, confidence, support`` of rules for the bad class. labelled: ``tokens, bad`` (boolean)."""
    baskets = labelled.filter(F.size("tokens") > 0).select(F.concat("tokens", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    n = baskets.count()
    schema = "rule_id long, antecedent array<string>, confidence double, support double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    fitted = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(baskets)
    found = fitted.associationRules.filter(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    found = settle(found.withColumn("rule_id", F.xxhash64("antecedent")))
    # A rule goes if one of its parts is a rule of at least its confidence: parts are looked up by their first token.
    a, b = found.alias("a"), found.select("antecedent", "confidence", F.col("rule_id").alias("part_id"), F.element_at("antecedent", 1).alias("token")).alias("b")
    spread = a.select("a.rule_id", "a.antecedent", "a.confidence", F.explode("a.antecedent").alias("token")).alias("s")
    weaker = spread.join(b, "token").filter(
        (F.size("b.antecedent") < F.size("s.antecedent")) & (F.size(F.array_except("b.antecedent", "s.antecedent")) == 0) & (F.col("b.confidence") >= F.col("s.confidence"))
    )
    return found.join(weaker.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, matched_rules`` of the rows whose ``tokens`` hold all tokens of a rule, by the inverted index."""
    spread = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    asked = urls.select(key, "tokens", F.explode("tokens").alias("token"))
    # Counts are of those tokens alone that rules have; a token no URL has files its rule where nothing looks.
    common = asked.join(spread.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("in_urls"))
    rarest = F.min(F.struct(F.coalesce("in_urls", F.lit(0)).alias("in_urls"), "token"))["token"].alias("token")
    index = settle(spread.join(common, "token", "left").groupBy("rule_id", "antecedent").agg(rarest))
    looked = asked.join(index, "token")
    return looked.filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy(key).agg(F.count("*").alias("matched_rules"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, matched_rules (mined rules that match; null where a fixed rule decides)."""
    parted = with_parts(pages.select("page_id", "url"))
    tokened = parted.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("fixed", fixed_rule(rules))
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("bad"))
    labelled = tokened.join(bad, tokened["page_id"] == bad["doc_id"]).select("tokens", "bad")
    mined = mine(labelled)
    # Pages with the same tokens are matched once: the index is asked for token sets, not for pages.
    asked = tokened.filter(F.col("fixed").isNull()).select("tokens").distinct().withColumn("token_set", F.xxhash64("tokens"))
    hits = match(asked, mined, "token_set")
    judged = tokened.withColumn("token_set", F.xxhash64("tokens")).join(hits, "token_set", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("matched_rules") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fixed").isNull(), F.coalesce("matched_rules", F.lit(0))).cast("long").alias("matched_rules"))
