"""Near-duplicates by a Chosen Path set similarity join.

A document's set holds the hashes of its distinct word shingles. Two documents are linked when
``100 * intersection >= 80 * union`` (the Jaccard threshold); the answer is the connected components of the links.

1. *Classes.* Rows with equal sets form a class (found by a 128-bit fingerprint of the set), which gets a number of its
   own; classes, not ids, are the nodes of everything that follows, so neither a null nor a repeated id decides what is
   compared. Copies, however many, are never paired.
2. *Trees.* In each of several independent trees, every node chooses, by its own hash, which of the 128 minwise tokens it
   branches on: ``1 / threshold`` of them on average (one always, a second one in a fraction of the nodes). A set goes
   down every branch, by the value of that token, so similar sets share a branch with a probability equal to their
   similarity, and a pair at the threshold stays together in one branch on average at every level. Nodes of at most
   ``small`` sets are compared exhaustively; larger ones branch further. The depth grows with the logarithm of the number
   of documents, and the number of trees with the target recall: with ``s`` the chance that a pair at the threshold
   survives a tree to its full depth (`survival`), ``trees = ln(1 - recall) / ln(1 - s)``.
3. *Large leaves.* Nodes still large at the last level are dense groups. Each member is compared with the leaf's hub, the
   member that has most tokens in common with the tokens that are most frequent in the leaf. When the links so far are
   joined, members outside the leaf's largest component are compared with every member of the leaf, block by block,
   first by sketches alone and then, for those that have a likely partner, by their texts; no pair of different
   components goes unseen, and no row is made for a pair that is not linked.
4. *Links.* Candidate pairs pass a size test and a test of 32 (in large leaves of 128) four-bit minwise tokens, which
   keeps a pair at the threshold with a probability above 0.9999, and are confirmed on the full sets. Pairs are confirmed in two rounds:
   first each set's smallest and most similar partner, then every pair whose two components are still apart.

Sets are computed from whole texts, once for the trees and once for the classes that some pair names.

Defined cases: a null or empty text, or one without words, has an empty set and no links; a text of fewer words than a
shingle is one shingle; repeated rows are copies; rows that share an id but not the text are compared each for itself;
rows with a null id are compared like others and come after all ids (a component without any id has a null id); an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle, small_batches, tidy
from .components import components
from .fingerprints import shingle_hashes

THRESHOLD = 0.8
U = np.uint64
MINWISE, SKETCHED = 128, 32
#: Equal four-bit tokens asked for, of the first 32 and of all 128: over four standard deviations below what a pair at the threshold has.
SKETCH_MATCHES, FULL_MATCHES = 15, 86
_RANDOM = np.random.default_rng(20260101)
_FACTORS = _RANDOM.integers(1, 2**32, MINWISE, np.uint64).astype(np.uint32) | np.uint32(1)
_MASKS = _RANDOM.integers(0, 2**32, MINWISE, np.uint64).astype(np.uint32)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; words are split at ASCII white space, A-Z lower-cased."""
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), size))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens: for each of ``MINWISE`` hash functions, the least value over the set."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(MINWISE, np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), 2048):
        x = (low[k : k + 2048, None] ^ _MASKS) * _FACTORS
        out = np.minimum(out, (x ^ (x >> np.uint32(15))).min(axis=0))
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def second_branches(threshold: float) -> float:
    """Share of nodes that branch on a second token."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must be between 0.5 and 1")
    return 1 / threshold - 1


def paths(tokens: np.ndarray, trees: int, depth: int, second: float) -> np.ndarray:
    """All paths of a set from the roots to the last level, a row each: the first level at which the path is not the same
    as an earlier one's, then its nodes."""
    node = _mix(np.arange(trees, dtype=np.uint64) + U(77), U(5))
    out = np.zeros((trees, depth + 1), np.int64)
    cut = U(int(second * 2**32))
    for level in range(depth):
        token = (node >> U(7)) % U(MINWISE)
        salt = U(level + 1) << U(40)
        twice = np.flatnonzero(_mix(node, U(11)) & U(0xFFFFFFFF) < cut)
        other = (token[twice] + U(1) + (node[twice] >> U(17)) % U(MINWISE - 1)) % U(MINWISE)
        branch = _mix(node, (tokens[token].astype(U) | token << U(32)) + salt)
        if len(twice):
            branch = np.concatenate([branch, _mix(node[twice], (tokens[other].astype(U) | other << U(32)) + salt)])
            more = out[twice]
            more[:, 0] = level
            out = np.concatenate([out, more])
        node = branch
        out[:, level + 1] = node.view(np.int64)
    return out


def sketch(tokens: np.ndarray) -> list[int]:
    """Longs of 16 four-bit tokens each."""
    low = (tokens & np.uint32(15)).astype(np.uint64).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(low, axis=1).view(np.int64).tolist()


def survival(depth: int, threshold: float = THRESHOLD) -> float:
    """Chance that two sets at the threshold share a node at the last level of a tree (a branching process)."""
    lost, second = 0.0, second_branches(threshold)
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - second) * one + second * one * one
    return 1 - lost


def trees_for(recall: float, depth: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold)))


def depth_for(documents: int, small: int, fan_out: int = 64) -> int:
    """Levels after which nodes of unlike sets are small: a level divides them by ``fan_out`` or more."""
    return max(3, math.ceil(math.log(max(1, documents / small)) / math.log(fan_out)))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two hashes of the text: with the id, they tell which text a row is about."""
    return docs.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})


KEY = ["doc_id", "_h1", "_h2"]


def _same_row(a: str, b: str) -> Column:
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


def _signatures(docs: DataFrame, size: int, trees: int, depth: int, second: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text, size)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                x = _mix(s, np.arange(1, len(s) + 1, dtype=U) * U(0x9E3779B97F4A7C15))
                y = _mix(x, s)
                f1, f2 = (int(np.bitwise_xor.reduce(v).view(np.int64)) for v in (x, y))
                t = minwise(s)
                rows.append((len(s), f1, f2, sketch(t), paths(t, trees, depth, second).ravel()))
            made = pd.DataFrame(rows, columns=["n", "f1", "f2", "sketch", "nodes"], index=batch.index).astype({"f1": "Int64", "f2": "Int64"})
            yield pd.concat([batch[KEY].astype({"doc_id": "Int64"}), made], axis=1)

    narrow = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return narrow.mapInPandas(tidy(run), "doc_id long, _h1 long, _h2 long, n long, f1 long, f2 long, sketch array<long>, nodes array<long>")


def _matches(a: Column, b: Column) -> Column:
    """Number of equal four-bit tokens of two longs."""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    z = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(16) - F.bit_count(z)


def _score(longs: int) -> Column:
    total = F.lit(0)
    for k in range(longs):
        total = total + _matches(F.col("a.sketch")[k], F.col("b.sketch")[k])
    return total


def _pairs(a: DataFrame, b: DataFrame, on: Column, percent: int, whole: bool = False) -> DataFrame:
    """Pairs a < b that meet, pass the size test and have enough tokens in common; ``score`` is among 32 tokens."""
    alike = _score(MINWISE // 16) >= FULL_MATCHES if whole else _score(SKETCHED // 16) >= SKETCH_MATCHES
    sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return a.alias("a").join(b.alias("b"), on & sizes & alike).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), _score(SKETCHED // 16).alias("score"))


def _centres(leaves: DataFrame) -> DataFrame:
    """``node, centre``: the sketch made of the most frequent token at each of the 128 places."""
    shifts = np.arange(16, dtype=U) * U(4)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.arange(MINWISE)
        held: dict[int, np.ndarray] = {}  # counts by node, over batches, given out before they grow large
        flush = lambda: pd.DataFrame([(k, v.astype("<i4").tobytes()) for k, v in held.items()], columns=["node", "counts"])
        for batch in batches:
            for node, group in batch.groupby("node", sort=False):
                tokens = ((np.stack(group["sketch"].to_numpy()).view(U)[:, :, None] >> shifts) & U(15)).reshape(len(group), MINWISE).astype(np.int64)
                held[node] = held.get(node, 0) + np.bincount((tokens + 16 * places).ravel(), minlength=16 * MINWISE)
            if len(held) > 2000:
                yield flush()
                held.clear()
        yield flush()

    def total(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(16 * MINWISE, np.int64)
        for raw in group["counts"]:
            counts += np.frombuffer(raw, "<i4")
        return pd.DataFrame({"node": group["node"].iloc[:1], "centre": [sketch(counts.reshape(MINWISE, 16).argmax(axis=1).astype(np.uint32))]})

    # A leaf sends a row from each task that has members of it, or a few.
    parts = leaves.select("node", "sketch").mapInPandas(tidy(add), "node long, counts binary")
    return parts.groupBy("node").applyInPandas(total, "node long, centre array<long>")


def candidates(reps: DataFrame, depth: int, small: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b, score), and the members of large leaves (node, id, n, sketch)."""
    found = None
    # A row for each path. Paths of a tree that begin alike count once where they are alike.
    each = F.transform(F.sequence(F.lit(0), F.expr(f"size(nodes) div {depth + 1} - 1")), lambda t: F.slice("nodes", t * (depth + 1) + 1, depth + 1))
    rows = reps.select("id", "n", F.slice("sketch", 1, SKETCHED // 16).alias("sketch"), F.explode(each).alias("path"))
    for level in range(depth):
        at, own = rows.withColumn("node", F.get("path", F.lit(level + 1))), F.get("path", F.lit(0)) <= level
        sizes = at.filter(own).groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
        met = at.join(sizes, "node")
        few = met.filter((F.col("members") <= small) & own).select("node", "id", "n", "sketch")
        pairs = _pairs(few, few, (F.col("a.node") == F.col("b.node")) & (F.col("a.id") < F.col("b.id")), percent)
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.filter(F.col("members") > small).select("id", "n", "sketch", "path", "node")
        if level < depth - 1:
            rows = settle(rows.drop("node"))
    leaves = settle(rows.select("node", "id").join(reps.select("id", "n", "sketch"), "id"))
    likeness = F.lit(0)
    for k in range(MINWISE // 16):
        likeness = likeness + _matches(F.col("sketch")[k], F.col("centre")[k])
    central = leaves.join(_centres(leaves), "node").select("node", F.struct(likeness.alias("like"), (-F.col("id")).alias("first"), "id", "n", "sketch").alias("m"))
    hubs = settle(central.groupBy("node").agg(F.max("m").alias("m")).select("node", "m.id", "m.n", "m.sketch"))
    starred = _pairs(hubs, leaves, (F.col("a.node") == F.col("b.node")) & (F.col("a.id") != F.col("b.id")), percent, True)
    return settle(found.unionByName(starred).groupBy("a", "b").agg(F.max("score").alias("score"))), leaves


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold. docs: ``id, text`` of all that the pairs name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, s, t in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last or own is None:
                    last, own = a, shingles(s, size)
                other = shingles(t, size)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(tidy(run), "a long, b long")


def link(docs: DataFrame, size: int = 5, threshold: float = THRESHOLD, recall: float = 0.999, depth: int | None = None, small: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the component), stays: for every row of ``docs`` (doc_id, text).

    ``stays`` is true for one text of each component, the one of the smallest id, and for every text without words;
    columns `KEY` tell which rows of ``docs`` have it. A text that stays may have several equal rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    percent = round(100 * threshold)
    depth = depth or depth_for(docs.count(), small)
    signed = settle(_signatures(docs, size, trees_for(recall, depth, threshold), depth, second_branches(threshold)))
    # The rows of a class agree in everything but the id and, if their shingles do but not their words, the text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *KEY)).alias("first")
    known = signed.filter("n > 0")
    classes = settle(known.groupBy("f1", "f2", "n").agg(first).withColumn("id", F.monotonically_increasing_id()))
    named_by = classes.select("id", *[F.col(f"first.{c}").alias(c) for c in KEY])
    c, k = classes.alias("c"), known.alias("k")
    whose = (F.col("c.f1") == F.col("k.f1")) & (F.col("c.f2") == F.col("k.f2")) & (F.col("c.n") == F.col("k.n"))
    own = F.lit(True)
    for column in KEY:
        own = own & F.col(f"c.first.{column}").eqNullSafe(F.col(f"k.{column}"))
    reps = settle(k.join(c, whose & own).select("c.id", "c.n", "k.sketch", "k.nodes").dropDuplicates(["id"]))
    pairs, leaves = candidates(reps, depth, small, percent)
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(leaves.select("id")).distinct()
    wanted = named_by.join(named, "id")
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    texts = settle(d.alias("d").join(wanted.alias("w"), _same_row("d", "w")).select("w.id", "d.text").dropDuplicates(["id"]))

    # First round: for each set its smallest partner, and its most similar one.
    both = pairs.union(pairs.select("b", "a", "score"))
    chosen = both.groupBy("a").agg(F.min("b").alias("least"), F.max(F.struct("score", "b"))["b"].alias("best"))
    tried = chosen.select("a", F.explode(F.array("least", "best")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = settle(confirm(tried, texts, size, percent))

    def apart(some: DataFrame, joined: DataFrame) -> DataFrame:
        """The pairs whose two ends are in different components so far."""
        x, y = joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), joined.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return some.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # Second round: all other pairs whose components are still apart.
    joined = components(links)
    second = apart(pairs.join(tried, ["a", "b"], "left_anti"), joined)
    links = settle(links.union(confirm(second, texts, size, percent)))
    joined = settle(components(links))

    # Third round, large leaves: members outside the largest component of their leaf, against all members of the leaf.
    placed = leaves.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("node", "component").agg(F.count("*").alias("members"), F.sum("n").alias("volume"))
    top = F.max(F.struct("members", "component", "volume")).alias("top")
    main = parts.groupBy("node").agg(top, F.sum("members").alias("members"), F.sum("volume").alias("volume"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda members, volume: F.ceil(F.greatest(members / BLOCK_SETS, volume / BLOCK_SHINGLES)).cast("int")
    cut = main.select(
        "node", F.col("top.component").alias("main"), blocks(F.col("members"), F.col("volume")).alias("members"),
        F.greatest(F.lit(1), blocks(F.col("members") - F.col("top.members"), F.col("volume") - F.col("top.volume"))).alias("outside"),
    )
    joined = components(settle(links.union(_within_leaves(placed.join(cut, "node"), texts, size, percent))))

    whole = classes.select("id", "f1", "f2", "n", "first").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = whole.groupBy("component").agg(F.min("first").alias("head"))
    told = whole.join(heads, "component").select("f1", "f2", "n", "head")
    same_text = F.lit(True)
    for column in KEY:
        same_text = same_text & F.col(column).eqNullSafe(F.col(f"head.{column}"))
    judged = signed.drop("sketch", "nodes").join(told, ["f1", "f2", "n"], "left")
    return judged.select(*KEY, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), ((F.col("n") == 0) | same_text).alias("stays"))


#: Sets, and shingles of sets, that a block of a large leaf holds about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000


def _near(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of b, the likely partners among the rows of a that are in another component, the likeliest first."""
    x, y = (np.stack(f["sketch"].to_numpy()).view(U) for f in (a, b))
    na, nb, ca, cb = a["n"].to_numpy(), b["n"].to_numpy(), a["component"].to_numpy(), b["component"].to_numpy()
    for k in range(len(b)):
        z = x ^ y[k]
        z |= z >> U(1)
        z |= z >> U(2)
        equal = MINWISE - np.bitwise_count(z & U(0x1111111111111111)).sum(axis=1).astype(np.int64)
        near = np.flatnonzero((equal >= FULL_MATCHES) & (100 * np.minimum(na, nb[k]) >= percent * np.maximum(na, nb[k])) & (ca != cb[k]))
        if len(near):
            yield k, near[np.argsort(-equal[near], kind="stable")]


def _within_leaves(split: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between members outside a leaf's main component and members of other components.

    split: ``node, id, n, sketch, component, main``, and the numbers of blocks that the leaf's ``members`` and those
    ``outside`` are cut into. Each pair of blocks is one small group. It is met by sketches first; then the texts come of
    those that have a likely partner there.
    """
    key = ("node", "mine", "theirs")
    own = F.pmod(F.xxhash64("id"), F.col("members")).cast("int")
    out = F.pmod(F.xxhash64("id", F.lit(1)), F.col("outside")).cast("int")
    facts = ("node", "id", "n", "sketch", "component")
    members = split.select(*facts, own.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("theirs"))
    outside = split.filter("component != main").select(*facts, F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("mine"), out.alias("theirs"))
    columns = "node long, mine int, theirs int, side int, id long, n long, sketch array<long>, component long"

    def survivors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: tuple[set[int], set[int]] = (set(), set())
        if len(left) and len(right):
            for k, near in _near(left, right, percent):
                rows[1].add(k)
                rows[0].update(near.tolist())
        return pd.concat([f.iloc[sorted(r)].assign(side=side)[[c.split()[0] for c in columns.split(", ")]] for side, (f, r) in enumerate(zip((left, right), rows, strict=True))])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["side"] == side] for side in (0, 1))
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            known: dict[int, np.ndarray] = {}
            text = dict(zip(group["id"], group["text"], strict=True))
            component = dict(zip(group["id"], group["component"], strict=True))
            ids, others = left["id"].to_numpy(), right["id"].to_numpy()
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            def shingled(i: int) -> np.ndarray:
                if i not in known:
                    known[i] = shingles(text[i], size)
                return known[i]

            for k, near in _near(left, right, percent):
                for m in near:  # the likeliest first: their links spare the others
                    i, j = int(ids[m]), int(others[k])
                    p, q = find(component[i]), find(component[j])
                    if p == q:
                        continue
                    s, t = shingled(i), shingled(j)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        links.append((min(i, j), max(i, j)))
                        parent[max(p, q)] = min(p, q)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    right = outside.select(*[F.col(c).alias(c) for c in outside.columns])  # columns of their own: both sides come from one table
    likely = settle(members.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tidy(survivors), columns))
    return likely.join(texts, "id").groupBy(*key).applyInPandas(tidy(run), "a long, b long")


def keep_one(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for.

    Of rows equal in id and text, one stays, the first by their other columns; all rows without words stay.
    """
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    head = linked.filter("stays AND n_shingles > 0").select(*KEY).distinct()
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = keyed(docs.filter(~wordless))
    met = d.alias("d").join(head.alias("h"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.col("d._h1") == F.col("h._h1")) & (F.col("d._h2") == F.col("h._h2")), "left_semi")
    first = Window.partitionBy(*KEY).orderBy(*[F.col(c) for c in names]) if names else Window.partitionBy(*KEY).orderBy("doc_id")
    one = met.withColumn("_row", F.row_number().over(first)).filter("_row = 1")
    return one.select(*docs.columns).unionByName(docs.filter(wordless))
