"""Sweeps over decision thresholds: one aggregation by score bucket serves any number of thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.intervals import net_benefit_band, ratio
from . import disparity, groups, rates


def buckets(df: DataFrame, attributes: Sequence[str], thresholds: Sequence[float], overall: bool = True) -> DataFrame:
    """attribute, group, t_index, threshold and the cells at every threshold.

    A row's bucket is the number of thresholds its score reaches; counts at a threshold are sums over the buckets at or
    above it, which at most ``len(thresholds) + 1`` rows a group give.
    """
    ts = sorted(thresholds)
    reached = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col("p")))
    small = df.withColumn("b", reached).groupBy("b", *attributes).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"), F.sum("p").alias("sp"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    rows = groups.long(small, attributes, "b", "n", "k", "sp", "sq", overall=overall).groupBy("attribute", "group", "b").agg(*(F.sum(c).alias(c) for c in ("n", "k", "sp", "sq")))
    # Every bucket of every group, so that thresholds no score reaches have rows too.
    keys = rows.select("attribute", "group").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(ts)))))
    full = keys.join(rows, ["attribute", "group", "b"], "left").na.fill(0)
    up = Window.partitionBy("attribute", "group").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("attribute", "group")
    cum = full.select("attribute", "group", "b", F.sum("n").over(up).alias("flagged"), F.sum("k").over(up).alias("tp"), F.sum("n").over(whole).alias("n"), F.sum("k").over(whole).alias("n_positive"), F.sum("sp").over(whole).alias("sum_p"), F.sum("sq").over(whole).alias("sum_sq")).where("b > 0")
    cells = cum.select("attribute", "group", F.col("b").alias("t_index"), F.element_at(F.array(*map(F.lit, ts)), F.col("b")).alias("threshold"), "n", "n_positive", "tp", (F.col("flagged") - F.col("tp")).alias("fp"), (F.col("n") - F.col("n_positive") - F.col("flagged") + F.col("tp")).alias("tn"), (F.col("n_positive") - F.col("tp")).alias("fn"), "sum_p", "sum_sq")
    return rates.derived(cells)


def sweep(df: DataFrame, attributes: Sequence[str] = (), thresholds: Sequence[float] = C.SWEEP) -> DataFrame:
    """All measures at every threshold."""
    return rates.classification(buckets(df, attributes, thresholds))


def decision_curve(df: DataFrame, attributes: Sequence[str] = (), thresholds: Sequence[float] | None = None) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none at every threshold, and whether the model is useful."""
    cells = buckets(df, attributes, thresholds or C.curve_thresholds())
    odds = F.when(F.col("threshold") < 1, F.try_divide(F.col("threshold"), 1 - F.col("threshold")))
    prev = ratio("n_positive", "n")
    model = F.coalesce(ratio("tp", "n") - ratio("fp", "n") * odds, F.lit(0.0))
    everyone = F.coalesce(prev - (1 - prev) * odds, F.lit(0.0))
    return cells.select("attribute", "group", "t_index", "threshold", model.alias("net_benefit"), everyone.alias("net_benefit_all"), F.lit(0.0).alias("net_benefit_none"), (model > F.greatest(everyone, F.lit(0.0))).alias("useful"))


def useful_range(curve: DataFrame) -> DataFrame:
    return curve.where("useful").groupBy("attribute", "group").agg(F.min("threshold").alias("min_threshold"), F.max("threshold").alias("max_threshold"))


def net_benefit(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Net benefit at a threshold, its maximum (the prevalence), their ratio and its band."""
    odds = threshold / (1 - threshold) if threshold < 1 else 0.0
    nb = ratio("tp", "n") - ratio("fp", "n") * odds if threshold < 1 else F.lit(0.0)
    prev = ratio("n_positive", "n")
    snb = F.when(prev > 0, F.try_divide(nb, prev))
    return cells.select("attribute", "group", nb.alias("net_benefit"), prev.alias("max_net_benefit"), snb.alias("standardized_net_benefit"), net_benefit_band(snb).alias("interpretation"))


def threshold_fairness(df: DataFrame, attributes: Sequence[str], thresholds: Sequence[float] = C.SWEEP) -> DataFrame:
    """Worst differences of each attribute at every threshold."""
    frame = disparity.fairness(buckets(df, attributes, thresholds, overall=False), extra=["t_index", "threshold"])
    return disparity.fairness_summary(frame, ["t_index", "threshold"])


def best_threshold(frame: DataFrame) -> DataFrame:
    """The threshold of the least worst equalized-odds difference of each attribute (ties: the lowest)."""
    return frame.groupBy("attribute").agg(F.min(F.struct("worst_equalized_odds", "threshold"))["threshold"].alias("optimal_threshold"))
