"""Learning how far to trust each kind of fix from verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import risk

#: Default confidence and judged fixes needed, by risk.
DEFAULTS = {"safe": 0.85, "moderate": 0.92, "destructive": 0.98}
NEEDED = {"safe": 20, "moderate": 50, "destructive": 100}


def tallies(verdicts: DataFrame, by: list[str]) -> DataFrame:
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    return verdicts.groupBy(*by).agg(F.count("*").alias("total"), count("accept").alias("accepted"), count("reject").alias("rejected"), count("skip").alias("skipped"))


def learned(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Hit rate, graduation and blended confidence of each kind of fix (``by`` starts with fix_type)."""
    t = tallies(verdicts, by).withColumn("risk_tier", risk(F.col("fix_type"))).withColumn("judged", F.col("accepted") + F.col("rejected"))
    needed, default = F.lit(0), F.lit(0.0)
    for name in NEEDED:
        needed = F.when(F.col("risk_tier") == name, NEEDED[name]).otherwise(needed)
        default = F.when(F.col("risk_tier") == name, DEFAULTS[name]).otherwise(default)
    hit = F.when(F.col("judged") > 0, F.col("accepted") / F.col("judged")).otherwise(0.0)
    weight = F.least(F.col("judged") / (2.0 * F.col("needed")), F.lit(0.8))
    return (
        t.withColumn("needed", needed).withColumn("hit_rate", hit).withColumn("graduated", (F.col("judged") >= F.col("needed")) & (F.col("hit_rate") >= 0.90))
        .withColumn("weight", weight).withColumn("learned_confidence", F.round(default * (1 - F.col("weight")) + F.col("hit_rate") * F.col("weight"), 4))
        .withColumn("to_graduation", F.greatest(F.lit(0), F.col("needed") - F.col("judged")))
    )


def with_profile(rows: DataFrame, profiles: DataFrame, label: str) -> DataFrame:
    """Adds ``source_label``: the profile whose comma-separated ``scan_labels`` hold the row's label, or the label itself."""
    listed = profiles.select(F.explode(F.split("scan_labels", ",")).alias("_label"), "profile")
    return rows.join(listed, F.col(label) == F.col("_label"), "left").withColumn("source_label", F.coalesce("profile", label)).drop("_label", "profile")
