"""Confusion counts and the rates on them, for all groups of all attributes in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import clopper_pearson, ratio, sample_status, sample_warning, wilson
from . import groups

#: numerator and denominator of each rate
RATES: dict[str, tuple[str, str]] = {
    "tpr": ("tp", "n_positive"),
    "fpr": ("fp", "n_negative"),
    "tnr": ("tn", "n_negative"),
    "fnr": ("fn", "n_positive"),
    "ppv": ("tp", "n_flagged"),
    "npv": ("tn", "n_unflagged"),
    "selection_rate": ("n_flagged", "n"),
    "accuracy": ("n_right", "n"),
}


def aggregates(threshold: float | Column) -> list[Column]:
    """Counts and sums from which rates, Brier score and observed-to-expected ratio follow."""
    flag = F.col("p") >= threshold
    pos = F.col("y") == 1
    return [
        F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("n_positive"),
        F.count_if(pos & flag).alias("tp"), F.count_if(~pos & flag).alias("fp"), F.count_if(~pos & ~flag).alias("tn"), F.count_if(pos & ~flag).alias("fn"),
        F.sum("p").alias("sum_p"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sum_sq"),
    ]


def derived(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"n_negative": F.col("n") - F.col("n_positive"), "n_flagged": F.col("tp") + F.col("fp"), "n_unflagged": F.col("tn") + F.col("fn"), "n_right": F.col("tp") + F.col("tn")})


def cells(df: DataFrame, attributes: Sequence[str], threshold: float = 0.5, overall: bool = True, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """The cells of all groups of a standard frame (``p``, ``y``, attributes)."""
    return derived(groups.grouped(df, attributes, aggregates(threshold), overall, sets))


def group_rates(cells_: DataFrame, metrics: Sequence[str] = tuple(RATES)) -> DataFrame:
    """Cells with the rates; an empty denominator gives 0."""
    unknown = [m for m in metrics if m not in RATES]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return cells_.withColumns({m: ratio(*RATES[m]) for m in metrics}).withColumn("prevalence", ratio("n_positive", "n"))


def with_intervals(rates: DataFrame, metrics: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Adds ``<metric>_ci_lower`` and ``_upper``: Wilson's, or the exact one where the outcome is rarer than 1 % or commoner than 99 %."""
    rare = (F.col("n_positive") < 0.01 * F.col("n")) | (F.col("n_positive") > 0.99 * F.col("n"))
    out = rates.withColumn("ci_method", F.when(rare, "clopper_pearson").otherwise("wilson"))
    for m in metrics:
        s, n = RATES[m]
        lo, hi = wilson(s, n, alpha, (0.0, 1.0))
        exact = clopper_pearson(F.col(s), F.col(n))
        out = out.withColumns({f"{m}_ci_lower": F.when(rare, exact["lower"]).otherwise(lo), f"{m}_ci_upper": F.when(rare, exact["upper"]).otherwise(hi)})
    status = sample_status(F.col("n"), F.col("n_positive"))
    return out.withColumn("sample_status", status).withColumn("warning", sample_warning(F.col("group"), F.col("n"), F.col("sample_status")))


def wilson_intervals(rates: DataFrame, metrics: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Wilson intervals alone, within whole-stage code."""
    out = rates
    for m in metrics:
        lo, hi = wilson(*RATES[m], alpha, (0.0, 1.0))
        out = out.withColumns({f"{m}_ci_lower": lo, f"{m}_ci_upper": hi})
    return out


def classification(cells_: DataFrame) -> DataFrame:
    """The measures of a threshold: sensitivity to kappa. Undefined ones are 0; an infinite NNE or odds ratio is null."""
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    se, sp, ppv, npv = ratio("tp", "n_positive"), ratio("tn", "n_negative"), ratio("tp", "n_flagged"), ratio("tn", "n_unflagged")
    acc = ratio("n_right", "n")
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    prev = F.try_divide(tp + fn, n)
    expected = prev * F.try_divide(tp + fp, n) + (1 - prev) * F.try_divide(fn + tn, n)
    inner = (se > 0) & (se < 1) & (sp > 0) & (sp < 1)
    dor = F.when(inner, F.try_divide(F.try_divide(se, 1 - sp), F.try_divide(1 - se, sp))).when((se == 1) & (sp == 1), F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return cells_.withColumns({
        "sensitivity": se, "specificity": sp, "ppv": ppv, "npv": npv,
        "f1_score": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), "accuracy": acc,
        "balanced_accuracy": (se + sp) / 2, "youden_index": se + sp - 1,
        "mcc": F.when(root > 0, F.try_divide(tp * tn - fp * fn, root)).otherwise(F.lit(0.0)), "dor": dor,
        "kappa": F.when(expected < 1, F.try_divide(acc - expected, 1 - expected)).otherwise(F.lit(0.0)),
        "pct_flagged": 100 * ratio("n_flagged", "n"), "nne": F.when(ppv > 0, F.try_divide(F.lit(1.0), ppv)),
    })


def effective_sample_size(df: DataFrame, cluster: str | None = None) -> DataFrame:
    return df.agg((F.count_distinct(cluster) if cluster else F.count(F.lit(1))).alias("n_effective"))


def stratum_adequacy(df: DataFrame, attributes: Sequence[str], suppress: int = 5, flag: int = 30) -> DataFrame:
    """Distinct clusters of each group and outcome: fewer than 5 SUPPRESS, than 30 FLAG, else REPORT."""
    rows = groups.long(df.select("cluster", "y", *attributes).distinct(), attributes, "cluster", "y", overall=False)
    n = rows.groupBy("attribute", "group", "y").agg(F.count_distinct("cluster").alias("n_effective"))
    return n.withColumn("status", F.when(F.col("n_effective") < suppress, "SUPPRESS").when(F.col("n_effective") < flag, "FLAG").otherwise("REPORT"))
