"""Mixing sources to target token weights by entropy balancing.

Each document d of source s gets a rate w_d, the copies it should have in the mix. Among all rates between 0 and a
cap, those closest to the base rate (the share, for all documents alike) in Kullback-Leibler divergence, every document
counting alike, that meet every source's token constraint ``sum size_d * w_d = target_s`` are an exponential tilt of the
base rate: ``w_d = min(cap, share * exp(m_s * x_d))``, x_d being the document's size over its source's mean size. A source
that is asked for less than the base rate gives gives up its long documents first, since they cost least divergence for a
word; one that is asked for more repeats them first. The multipliers m_s solve the convex dual. `balance` finds them by
Newton steps, kept inside a bracket; gradients and curvatures are sums over the corpus, computed by Spark. Documents of
one source and size have the same rate, so those sums run over the counts by (source, size), made once with map-side
combining, and not over the documents. A source whose target is its cap has all documents at the cap.

*Rounding.* Copies are whole. Cells of one source and size are taken in falling order of size, and each gets as many
copies as bring the words taken so far nearest to the words asked for so far, so the smallest documents settle what is
left: a source's words are nearer to its target than its mean document, unless all of its small documents are used up.
Within a cell the documents whose seeded hash is lowest get the extra copy; cells with more than
``split`` documents are split by that hash first, so that no task ranks a whole cell.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a source without words
has target 0; documents of size 0 are taken no more often than their rate says and count no words; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, settle

#: Newton steps, after which `balance` gives up with an error; the bracket halves whenever a step would leave it.
MAX_STEPS = 80
TOLERANCE = 1e-9
#: Bracket of the multipliers.
WIDEST = 1e4


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Weights repeat along the sources in code-point order, null last. A target over ``cap`` times its source's size is
    cut there, and what is over is shared again among the others by weight, until none is above. The sources that end
    at their cap are those with the smallest ``cap * size / weight``, so one running sum over the sources in that
    order finds them all: a source is capped while its quotient is at most the amount left per weight left.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_q", F.col("_cap") / F.col("_w"))
    by_q = Window.orderBy("_q", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = by_q.rowsBetween(Window.unboundedPreceding, -1)
    running = (
        weighted.withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weight_left"))
        .withColumn("_capped", F.col("_q") <= F.col("_level"))
    )
    level = F.min(F.when(~F.col("_capped"), F.struct("_q", "_level"))).over(everything)["_level"]
    return running.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def rates(size: Column, mean_size: Column, multiplier: Column, base: float, cap: float) -> Column:
    """``min(cap, base * exp(multiplier * size / mean_size))``; a null multiplier stands for the cap itself."""
    tilt = F.least(multiplier * size / mean_size, F.lit(700.0))
    return F.when(multiplier.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.lit(float(base)) * F.exp(tilt)))


def balance(cells: DataFrame, targets: DataFrame, base: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Multipliers by source: ``source, source_size, target, mean_size, multiplier`` (null: all at the cap).

    cells: ``source, size, n`` (documents of that source and size). The dual's derivative for a source,
    ``sum n * size * min(cap, base * exp(m * x)) - target``, rises in the multiplier m. A source without words has
    multiplier 0.
    """
    means = cells.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"))
    full = (F.col("source_size") > 0) & (F.col("target") >= F.col("source_size") * F.lit(cap * (1 - TOLERANCE)))
    state = settle(
        targets.join(means, targets["source"].eqNullSafe(means["source"])).select(
            targets["source"], "source_size", "target", F.when(F.col("mean_size") > 0, F.col("mean_size")).otherwise(1.0).alias("mean_size"),
            F.when(~full, 0.0).alias("multiplier"), F.lit(-WIDEST).alias("lo"), F.lit(WIDEST).alias("hi"), (full | (F.col("source_size") == 0)).alias("done"),
        )
    )
    for _ in range(MAX_STEPS):
        if state.filter(~F.col("done")).isEmpty():
            # Sums of doubles differ in their last digits from run to run; rounded multipliers, and all that follows, do not.
            return state.select("source", "source_size", "target", "mean_size", F.round("multiplier", 8).alias("multiplier"))
        c, s = cells.alias("c"), state.alias("s")
        x = F.col("c.size") / F.col("s.mean_size")
        rate, tokens = rates(F.col("c.size"), F.col("s.mean_size"), F.col("s.multiplier"), base, cap), F.col("c.n") * F.col("c.size")
        sums = (
            c.join(s.filter("NOT s.done"), F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.sum(tokens * rate).alias("taken"), F.sum(F.when(rate < cap, tokens * rate * x).otherwise(0.0)).alias("curvature"))
        )
        u = sums.alias("u")
        gradient = F.col("u.taken") - F.col("s.target")
        newton = F.col("s.multiplier") - gradient / F.when(F.col("u.curvature") > 0, F.col("u.curvature"))
        lo = F.when(gradient < 0, F.col("s.multiplier")).otherwise(F.col("s.lo"))
        hi = F.when(gradient > 0, F.col("s.multiplier")).otherwise(F.col("s.hi"))
        inside = newton.isNotNull() & (newton > lo) & (newton < hi)
        reached = F.col("s.done") | (F.abs(gradient) <= F.greatest(F.col("s.target"), F.lit(1.0)) * TOLERANCE) | (hi - lo < 1e-11)
        state = settle(
            s.join(u, F.col("s.source").eqNullSafe(F.col("u.source")), "left").select(
                F.col("s.source").alias("source"), "s.source_size", "s.target", "s.mean_size",
                F.when(reached, F.col("s.multiplier")).when(inside, newton).otherwise((lo + hi) / 2).alias("multiplier"),
                lo.alias("lo"), hi.alias("hi"), reached.alias("done"),
            )
        )
    raise RuntimeError("the multipliers did not settle")


def rounded(size: np.ndarray, n: np.ndarray, rate: np.ndarray, cap: int) -> np.ndarray:
    """Copies of each cell's documents together, cells in falling order of size: so many that the words taken so far are as
    near as they can be to the words that the rates ask for so far. What one cell takes too much or too little, the next
    ones, of smaller documents, make up."""
    out = np.zeros(len(size), np.int64)
    owed = 0.0
    for k in range(len(size)):
        copies = rate[k] * n[k]
        owed += copies * size[k]
        out[k] = min(max(0, math.floor((owed / size[k] if size[k] else copies) + 0.5)), cap * n[k])
        owed -= out[k] * size[k]
    return out


def _rounder(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group is one source's cells, one for each distinct size."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False)
        n = cells["n"].to_numpy()
        copies = rounded(cells["size"].to_numpy(), n, cells["rate"].to_numpy(), cap)
        return cells.assign(whole=copies // n, extra=copies % n)

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 0, split: int = 20_000) -> DataFrame:
    """``docs`` (doc_id, source, size) with ``source_size, target, rate, copies``."""
    narrow = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"))
    cells = settle(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    solved = balance(cells, targets, share, cap)
    c, m = cells.alias("c"), solved.alias("m")
    rate = rates(F.col("size"), F.col("mean_size"), F.col("multiplier"), share, cap)
    rated = c.join(m, F.col("c.source").eqNullSafe(F.col("m.source"))).select(F.col("c.source").alias("source"), F.col("c.size").alias("size"), "n", "source_size", "target", rate.alias("rate"))
    planned = settle(rated.groupBy("source").applyInPandas(_rounder(cap), "source string, size long, n long, source_size long, target double, rate double, whole long, extra long"))
    # A document's place among the n of its cell is the number of hashes below its own: counted by block of hashes.
    d, p = narrow.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).alias("d"), planned.alias("p")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("p.n") / F.lit(split)))
    placed = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))).select(
        "d.doc_id", F.col("d.source").alias("source"), F.col("d.size").alias("size"), "n", "source_size", "target", "rate", "whole", "extra", "_h", F.pmod(F.col("_h"), blocks).alias("_block")
    )
    easy = placed.filter((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + F.when(F.col("extra") == 0, 0).otherwise(1)).alias("copies"))
    hard = placed.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    in_block = hard.groupBy("source", "size", "_block").agg(F.count("*").alias("_in"))
    shared = in_block.withColumn("_upto", F.sum("_in").over(Window.partitionBy("source", "size").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)))
    h, b = hard.alias("h"), shared.alias("b")
    ranked = h.join(b, F.col("h.source").eqNullSafe(F.col("b.source")) & (F.col("h.size") == F.col("b.size")) & (F.col("h._block") == F.col("b._block"))).select(
        "h.doc_id", F.col("h.source").alias("source"), F.col("h.size").alias("size"), "source_size", "target", "rate", "whole", "extra", "_h", F.col("h._block").alias("_block"), (F.col("_upto") - F.col("_in")).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "_block").orderBy("_h", "doc_id")) + F.col("_before")
    tough = ranked.withColumn("_rank", rank).select("doc_id", "source", "size", "source_size", "target", "rate", (F.col("whole") + F.when(F.col("_rank") <= F.col("extra"), 1).otherwise(0)).alias("copies"))
    return easy.unionByName(tough)


def with_size(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
