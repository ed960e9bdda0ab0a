"""AUROC, curves and score distributions from histograms of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import auroc_band, auroc_diff_band, ks_asymptotic_p, ks_p, ratio
from . import groups
from .resampling import percentile_ci


def auroc(hist: DataFrame) -> DataFrame:
    """attribute, group, n, n_positive, auroc: the chance that a positive scores above a negative, ties counting half; null with one class."""
    run = groups.running(hist)
    neg, before = F.col("n") - F.col("k"), F.col("before_n") - F.col("before_k")
    pairs = F.sum(F.col("k").cast("double") * (before.cast("double") + neg.cast("double") / 2))
    out = run.groupBy("attribute", "group").agg(F.sum("n").alias("n"), F.sum("k").alias("n_positive"), pairs.alias("pairs"))
    both = F.col("n_positive").cast("double") * (F.col("n") - F.col("n_positive")).cast("double")
    return out.select("attribute", "group", "n", "n_positive", F.when(both > 0, F.try_divide("pairs", both)).alias("auroc"))


def auroc_bands(frame: DataFrame) -> DataFrame:
    return frame.withColumn("interpretation", auroc_band(F.col("auroc")))


def auroc_comparison(frame: DataFrame, reference: dict[str, str] | None = None) -> DataFrame:
    """AUROC of groups of at least 20 rows and both classes against the reference group's, with the band of the difference."""
    base = frame.where((F.col("n") >= 20) & F.col("auroc").isNotNull())
    both = groups.against_reference(base, groups.references(base, reference))
    d = F.col("auroc") - F.col("ref_auroc")
    return both.select("attribute", "group", "ref_group", "auroc", "ref_auroc", d.alias("auroc_diff"), auroc_diff_band(d).alias("interpretation"), (F.abs(d) >= 0.05).alias("clinically_meaningful"))


def auroc_comparison_ci(comparison: DataFrame, samples: DataFrame) -> DataFrame:
    """:func:`auroc_comparison` with the intervals of both AUROCs and of their difference, from bootstrap ``samples``.

    Groups are drawn apart, so a replicate's difference is that of two independent draws.
    """
    own = percentile_ci(samples).select("attribute", "group", "ci_lower", "ci_upper")
    ref = own.select("attribute", F.col("group").alias("ref_group"), F.col("ci_lower").alias("ref_ci_lower"), F.col("ci_upper").alias("ref_ci_upper"))
    pairs = comparison.select("attribute", "group", "ref_group")
    both = pairs.join(samples, ["attribute", "group"]).join(samples.select("attribute", F.col("group").alias("ref_group"), "replicate", F.col("value").alias("ref_value")), ["attribute", "ref_group", "replicate"])
    gap = percentile_ci(both.withColumn("value", F.col("value") - F.col("ref_value"))).select("attribute", "group", F.col("ci_lower").alias("diff_ci_lower"), F.col("ci_upper").alias("diff_ci_upper"))
    return comparison.join(own, ["attribute", "group"], "left").join(ref, ["attribute", "ref_group"], "left").join(gap, ["attribute", "group"], "left")


def roc_points(hist: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """Rates by descending threshold, from (0, 0) at infinity; points on a straight line between their neighbours may be dropped."""
    run = groups.running(hist, descending=True).withColumn("range", groups.score_range(F.col("p")))
    keys = ["attribute", "group"]
    neg = F.col("n") - F.col("k")
    # The next point's step lies in the same range of scores or is the first step of the next range that has one.
    firsts = run.groupBy(*keys, "range").agg(F.max_by("k", "p").alias("k1"), F.max_by(neg, "p").alias("n1"))
    o = Window.partitionBy(*keys).orderBy(F.desc("range"))
    ahead = firsts.select(*keys, "range", F.lead("k1").over(o).alias("k1"), F.lead("n1").over(o).alias("n1"))
    v = Window.partitionBy(*keys, "range").orderBy(F.desc("p"))
    steps = run.withColumns({"k_next": F.lead("k").over(v), "n_next": F.lead(neg).over(v)}).join(ahead, [*keys, "range"])
    steps = steps.withColumns({"k_next": F.coalesce("k_next", "k1"), "n_next": F.coalesce("n_next", "n1")})
    totals = hist.groupBy(*keys).agg(F.sum("k").alias("pos"), F.sum(F.col("n") - F.col("k")).alias("neg"))  # a row a group
    pts = steps.withColumns({"tps": F.col("before_k") + F.col("k"), "fps": F.col("before_n") + F.col("n") - F.col("before_k") - F.col("k")})
    if drop_collinear:
        pts = pts.where("k_next is null or k_next <> k or n_next <> n - k")
    zero = totals.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"))
    return zero.unionByName(pts.select(*keys, F.col("p").alias("threshold"), "tps", "fps")).join(totals, keys).select(*keys, "threshold", ratio("fps", "neg").alias("fpr"), ratio("tps", "pos").alias("tpr"))


def pr_points(hist: DataFrame) -> DataFrame:
    """Precision and recall by descending threshold."""
    run = groups.running(hist, descending=True)
    totals = hist.groupBy("attribute", "group").agg(F.sum("k").alias("pos"))  # a row a group
    tp, flagged = F.col("before_k") + F.col("k"), F.col("before_n") + F.col("n")
    return run.join(totals, ["attribute", "group"]).select("attribute", "group", F.col("p").alias("threshold"), ratio(tp, flagged).alias("precision"), ratio(tp, F.col("pos")).alias("recall"), "k", "pos", "before_k", "before_n")


def precision_summaries(hist: DataFrame) -> DataFrame:
    """Average precision (steps) and the area under the precision-recall curve (trapezoids, from precision 1 at recall 0)."""
    pts = pr_points(hist)
    previous = F.when(F.col("before_n") > 0, F.try_divide(F.col("before_k").cast("double"), F.col("before_n").cast("double"))).otherwise(F.lit(1.0))
    step = ratio("k", "pos")
    return pts.groupBy("attribute", "group").agg(F.sum(step * F.col("precision")).alias("average_precision"), F.sum(step * (F.col("precision") + previous) / 2).alias("auprc"))


def risk_distribution(df: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """Moments and quartiles of the score by group and outcome."""
    keys = ["attribute", "group", "y"]
    small = df.groupBy("p", "y", *attributes).agg(F.count(F.lit(1)).alias("n"))
    hist = groups.long(small, attributes, "p", "y", "n").groupBy(*keys, "p").agg(F.sum("n").alias("n"))
    moments = groups.moments(hist, keys)
    out = moments.join(groups.quantiles(hist, (0.25, 0.5, 0.75), keys=keys), keys)
    return out.select("attribute", "group", "y", "n", "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def discrimination_slope(df: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    one = groups.grouped(df, attributes, [F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("m1"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("m0")])
    return one.select("attribute", "group", (F.col("m1") - F.col("m0")).alias("discrimination_slope"))


def risk_histogram(df: DataFrame, attributes: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Rows by group, outcome and bin of the score; bins hold their left edge, the last one both."""
    edges = [i / bins for i in range(1, bins)]
    bin_ = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("p")))
    small = df.withColumn("bin", bin_).groupBy("bin", "y", *attributes).agg(F.count(F.lit(1)).alias("n"))
    return groups.long(small, attributes, "bin", "y", "n").groupBy("attribute", "group", "y", "bin").agg(F.sum("n").alias("n"))


def ks_statistic(hist: DataFrame) -> DataFrame:
    """Greatest distance between the score distributions of the outcomes; null with one class."""
    run = groups.running(hist)
    totals = hist.groupBy("attribute", "group").agg(F.sum("k").alias("n_positive"), F.sum(F.col("n") - F.col("k")).alias("n_negative"))  # a row a group
    gap = F.abs(F.try_divide((F.col("before_k") + F.col("k")).cast("double"), F.col("n_positive")) - F.try_divide((F.col("before_n") + F.col("n") - F.col("before_k") - F.col("k")).cast("double"), F.col("n_negative")))
    rows = run.join(totals, ["attribute", "group"])
    return rows.groupBy("attribute", "group").agg(F.max(gap).alias("ks_statistic"), F.max("n_positive").alias("n_positive"), F.max("n_negative").alias("n_negative"))


def ks_test(frame: DataFrame, exact: bool = True) -> DataFrame:
    """Adds the p-value: exact for small samples, or asymptotic for all."""
    p = ks_p if exact else ks_asymptotic_p
    return frame.withColumn("p_value", F.when(F.col("ks_statistic").isNotNull(), p("ks_statistic", "n_positive", "n_negative")))
