"""Calibration: sums, reliability bins, adaptive error, logistic recalibration and local regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.intervals import ratio
from . import groups, local


def bin_index(p: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Number of inner edges at or below p (``left``: bins hold their left edge) or below p (``right``)."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: (e <= p) if closed == "left" else (e < p)))


def scalars(cells: DataFrame) -> DataFrame:
    """Brier score, scaled Brier score, observed to expected and its inverse."""
    brier, prev = ratio("sum_sq", "n"), ratio("n_positive", "n")
    spread = prev * (1 - prev)
    return cells.select("attribute", "group", "n", brier.alias("brier_score"), F.when(spread > 0, 1 - F.try_divide(brier, spread)).otherwise(F.lit(0.0)).alias("brier_scaled"), F.when(F.col("sum_p") > 0, F.try_divide(F.col("n_positive").cast("double"), "sum_p")).alias("oe_ratio"), F.when(F.col("n_positive") > 0, F.try_divide(F.col("sum_p"), F.col("n_positive").cast("double"))).otherwise(F.lit(float("inf"))).alias("eo_ratio"), (ratio("sum_p", "n") - prev).alias("mean_calibration_error"))


def reliability(df: DataFrame, attributes: Sequence[str] = (), bins: int = C.BINS, closed: str = "right") -> DataFrame:
    """attribute, group, bin, n, mean_predicted, mean_observed over equal bins; empty bins have no row.

    ``closed='right'`` puts an edge into the bin below; ``'open'`` holds left edges and leaves a score of 1 out.
    """
    edges = [i / bins for i in range(1, bins)]
    rows = df.where(F.col("p") < 1) if closed == "open" else df
    small = rows.withColumn("bin", bin_index(F.col("p"), edges, "right" if closed == "right" else "left")).groupBy("bin", *attributes).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("k"))
    out = groups.long(small, attributes, "bin", "n", "sp", "k").groupBy("attribute", "group", "bin").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("k").alias("k"))
    return out.select("attribute", "group", "bin", "n", ratio("sp", "n").alias("mean_predicted"), ratio("k", "n").alias("mean_observed"))


def calibration_by_group(bins: DataFrame, least: int = C.CALIBRATION_N) -> DataFrame:
    """Unweighted mean and greatest absolute bin error of groups of at least ``least`` rows."""
    gap = F.abs(F.col("mean_observed") - F.col("mean_predicted"))
    return bins.groupBy("attribute", "group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_bins"), F.avg(gap).alias("ece"), F.max(gap).alias("mce")).where(F.col("n") >= least)


def ace(df: DataFrame, attributes: Sequence[str] = (), bins: int = C.BINS, least: int = 5) -> DataFrame:
    """Adaptive calibration error: bins between distinct quantiles, left-closed; bins of fewer than ``least`` rows drop out."""
    rows = groups.histogram(df, attributes)
    q = groups.quantiles(rows, [i / bins for i in range(bins + 1)]).select("attribute", "group", F.array_distinct("q").alias("edges"))
    inner = F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))")
    joined = rows.join(q.withColumn("inner", inner).drop("edges"), ["attribute", "group"])  # an array a group
    binned = joined.withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("p"))))
    cells = binned.groupBy("attribute", "group", "bin").agg(F.sum("n").alias("n"), ratio(F.sum("k"), F.sum("n")).alias("o"), F.try_divide(F.sum(F.col("n") * F.col("p")), F.sum("n")).alias("e")).where(F.col("n") >= least)
    return cells.groupBy("attribute", "group").agg((F.sum(F.col("n") * F.abs(F.col("o") - F.col("e"))) / F.sum("n")).alias("ace"), F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n_used"))


def ace_gap(frame: DataFrame) -> DataFrame:
    """Greatest less least adaptive error over the groups of an attribute, and the worst group."""
    g = frame.where(F.col("attribute") != C.OVERALL)
    return g.groupBy("attribute").agg((F.max("ace") - F.min("ace")).alias("gap"), F.max(F.struct("ace", "group"))["group"].alias("worst_group"))


def _logit(p: Column) -> Column:
    c = F.greatest(F.lit(C.CLIP), F.least(F.lit(1 - C.CLIP), p))
    return F.ln(c / (1 - c))


def logistic_recalibration(df: DataFrame, attributes: Sequence[str] = (), least: int = C.CALIBRATION_N, rounds: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Slope (ridge penalty w^2/2 on the slope, free intercept) and calibration-in-the-large of every group.

    Each Newton round is one aggregation for all groups; only a row a group comes to the driver.
    """
    # The distinct scores are counted once; every round reads them from there, not from the input.
    rows = groups.histogram(df, attributes).select("attribute", "group", _logit(F.col("p")).alias("x"), "n", "k").persist()
    spark = df.sparkSession
    sizes = rows.groupBy("attribute", "group").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where((F.col("n") >= least) & (F.col("k") > 0) & (F.col("k") < F.col("n")))
    state = {(r["attribute"], r["group"]): [0.0, 1.0, 0.0] for r in sizes.collect()}  # intercept and slope; offset intercept
    schema = "attribute string, group string, a double, b double, c double"
    done = not state
    for _ in range(rounds):
        if done:
            break
        now = F.broadcast(spark.createDataFrame([(*k, *v) for k, v in state.items()], schema))  # a row a group
        s = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        t = 1 / (1 + F.exp(-(F.col("c") + F.col("x"))))
        w, v = F.col("n") * s * (1 - s), F.col("n") * t * (1 - t)
        e = F.col("k") - F.col("n") * s
        sums = rows.join(now, ["attribute", "group"]).groupBy("attribute", "group").agg(F.sum(e).alias("g0"), F.sum(e * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"), F.sum(F.col("k") - F.col("n") * t).alias("gc"), F.sum(v).alias("hc"))
        largest = 0.0
        for r in sums.collect():
            a, b, c = state[r["attribute"], r["group"]]
            g = np.array([r["g0"], r["g1"] - b])
            h = np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"] + 1]])
            d = np.clip(np.linalg.solve(h, g), -5, 5)
            dc = float(np.clip(r["gc"] / r["hc"], -5, 5)) if r["hc"] > 0 else 0.0
            state[r["attribute"], r["group"]] = [a + float(d[0]), b + float(d[1]), c + dc]
            largest = max(largest, float(np.abs(d).max()), abs(dc))
        done = largest < tolerance
    rows.unpersist()
    out = [(*k, v[1], v[2]) for k, v in state.items()]
    return spark.createDataFrame([(a, g, float(x), float(y)) for a, g, x, y in out], "attribute string, group string, calibration_slope double, calibration_intercept double")


def lowess_curve(df: DataFrame, attributes: Sequence[str] = (), frac: float = 0.75, least: int = C.CALIBRATION_N) -> DataFrame:
    """Local regression of the outcome on the score by group, exact at every distinct score: attribute, group, p, n, k, smoothed."""
    return local.local_regression(groups.histogram(df, attributes), frac, least)


def curve_errors(curve: DataFrame) -> DataFrame:
    """ICI, ECI and E_max: distances of the score from the smoothed outcome."""
    e = F.col("smoothed") - F.col("p")
    out = curve.groupBy("attribute", "group").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.abs(e)).alias("a"), F.sum(F.col("n") * e * e).alias("b"), F.max(F.abs(e)).alias("e_max"), F.sum(F.col("n") * F.col("p")).alias("sp"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("spp"))
    prev = F.col("k") / F.col("n")
    spread = prev * prev - 2 * prev * F.col("sp") / F.col("n") + F.col("spp") / F.col("n")
    return out.select("attribute", "group", (F.col("a") / F.col("n")).alias("ici"), F.when(spread > 0, F.try_divide(F.col("b") / F.col("n"), spread)).otherwise(F.lit(0.0)).alias("eci"), "e_max")


def verdict(frame: DataFrame) -> DataFrame:
    """Text on slope, intercept, O:E and Brier score (null ones are passed over)."""
    parts = F.array(
        F.when(F.col("calibration_slope") < C.SLOPE_LOW, F.format_string("overfitting (slope=%.2f)", "calibration_slope")).when(F.col("calibration_slope") > C.SLOPE_HIGH, F.format_string("underfitting (slope=%.2f)", "calibration_slope")),
        F.when(F.abs("calibration_intercept") > 0.5, F.format_string("systematic %s (intercept=%.2f)", F.when(F.col("calibration_intercept") > 0, "underestimation").otherwise("overestimation"), "calibration_intercept")),
        F.when(F.col("oe_ratio") < 0.8, F.format_string("model overpredicts events (O:E=%.2f)", "oe_ratio")).when(F.col("oe_ratio") > 1.2, F.format_string("model underpredicts events (O:E=%.2f)", "oe_ratio")),
        F.when(F.col("brier_score") > C.BRIER_POOR, F.format_string("poor overall calibration (Brier=%.3f)", "brier_score")),
    )
    said = F.array_join(F.array_compact(parts), "; ")
    return frame.withColumn("interpretation", F.when(said == "", "Good calibration").otherwise(F.concat(F.lit("Calibration issues: "), said)))


