"""Intervals of shares and calibration of claimed confidences.

Edge cases: a null ``correct`` is no hit; no rows give no tiers, and an error of zero; a share of nothing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Ends of the 95 % interval of a share."""
    p, zz = hits / n, Z * Z
    centre, half = p + zz / (2 * n), Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)


# Samples below which, and half width of the interval above which, a tier gets no verdict.
POWER_FLOOR, MAX_HALF_WIDTH = 100, 0.15


def calibration(judged: DataFrame) -> DataFrame:
    """Per tier and claimed confidence (thousandths): ``n, measured, low, high, verdict, proposed``; needs ``tier, confidence, correct``.

    A claim outside the 95 % interval is ``miscalibrated`` and gets a proposal, the mean of the posterior under Beta(1/2, 1/2); with too
    few samples or too wide an interval it is ``under_powered``. No rows give no tiers.
    """
    by = judged.groupBy("tier", F.floor(F.col("confidence") * 1000 + 0.5).cast("long").alias("claimed")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    out = by.withColumns({"measured": F.col("hits") / F.col("n"), "low": low, "high": high})
    weak = (F.col("n") < POWER_FLOOR) | ((F.col("high") - F.col("low")) / 2 > MAX_HALF_WIDTH)
    off = (F.col("claimed") / 1000 < F.col("low")) | (F.col("claimed") / 1000 > F.col("high"))
    verdict = F.when(weak, "under_powered").when(off, "miscalibrated").otherwise("ok")
    return out.withColumn("verdict", verdict).withColumn("proposed", F.when(F.col("verdict") == "miscalibrated", (F.col("hits") + 0.5) / (F.col("n") + 1))).drop("hits")


def brier_ece(judged: DataFrame) -> DataFrame:
    """``brier, ece`` over all judged edges; the bins of the error are the tiers and their claimed values."""
    sq = judged.select(F.avg((F.col("confidence") - F.col("correct").cast("double")) ** 2).alias("brier"))
    gap = F.sum(F.col("n") * F.abs(F.col("measured") - F.col("claimed") / 1000)) / F.sum("n")
    return sq.crossJoin(calibration(judged).agg(gap.alias("ece"))).select(F.coalesce("brier", F.lit(0.0)).alias("brier"), F.coalesce("ece", F.lit(0.0)).alias("ece"))
