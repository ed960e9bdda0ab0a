"""Disparities between groups and the reference group of their attribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.intervals import impact_decision, index_band, katz, newcombe, p_of_z, ratio, z_statistic
from . import groups, rates

WORST = {"demographic_parity": "demographic_parity_diff", "equal_opportunity": "tpr_diff", "predictive_parity": "ppv_diff", "calibration": "calibration_diff"}


def disparities(cells: DataFrame, metric: str = "tpr", reference: dict[str, str] | None = None, strategy: str = "largest", warn: float = 0.05, fail: float = 0.1, alpha: float = 0.05, denominator: str | None = None, p_values: bool = True) -> DataFrame:
    """Each group's rate against its reference group: difference with a hybrid score interval, ratio, z and p, status.

    ``strategy``: ``largest`` or ``best`` reference (``reference`` names it where given). ``denominator`` replaces the
    rate's own one (``n_positive`` for every rate, successes then being rounded back from the rate). Attributes with one
    group give no row. The ratio over a reference of 0 is infinite, or 1 if both are 0.
    """
    num, den = rates.RATES[metric]
    base = rates.group_rates(cells.where(F.col("attribute") != C.OVERALL), [metric]).select("attribute", "group", "n", F.col(metric).alias("value"), F.col(num).alias("s"), F.col(den).alias("t"), "n_positive")
    if denominator:
        base = base.withColumn("t", F.col(denominator)).withColumn("s", F.round(F.col("value") * F.col("t")).cast("long"))
    if strategy not in ("largest", "best"):
        raise ValueError(f"unknown strategy: {strategy}")
    refs = groups.references(base, reference, F.desc("value") if strategy == "best" else None)
    both = groups.against_reference(base.drop("n_positive"), refs.drop("n_positive"))
    lo, hi = newcombe("s", "t", "ref_s", "ref_t", alpha, (-1.0, 1.0))
    diff = F.col("value") - F.col("ref_value")
    out = both.select(
        "attribute", F.lit(metric).alias("metric"), F.col("ref_group").alias("reference_group"), F.col("group").alias("comparison_group"),
        F.col("ref_value").alias("reference_value"), F.col("value").alias("comparison_value"), diff.alias("difference"), lo.alias("ci_lower"), hi.alias("ci_upper"),
        F.when(F.col("ref_value") > 0, F.try_divide("value", "ref_value")).when(F.col("value") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("ratio"),
        z_statistic("ref_s", "ref_t", "s", "t").alias("z"),
        F.when(F.abs(diff) >= fail, "fail").when(F.abs(diff) >= warn, "warn").otherwise("pass").alias("status"),
    )
    return out.withColumn("p_value", p_of_z("z")) if p_values else out


def worst_disparity(frame: DataFrame) -> DataFrame:
    """The row of the largest absolute difference of each attribute (ties: first group by name)."""
    w = Window.partitionBy("attribute").orderBy(F.desc(F.abs("difference")), "metric", "comparison_group")
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def count_by_status(frame: DataFrame) -> DataFrame:
    """Counts of pass, warn and fail, zeros included."""
    one = frame.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(f"`{s}`").alias("n")) for s in ("pass", "warn", "fail")))).alias("r")).select("r.*")


def disparity_matrix(frame: DataFrame) -> DataFrame:
    """Antisymmetric closure: every pair in both directions."""
    pair = frame.select("attribute", "metric", F.col("reference_group").alias("a"), F.col("comparison_group").alias("b"), "difference")
    return pair.unionByName(pair.select("attribute", "metric", F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("difference")).alias("difference")))


def disparate_impact(cells: DataFrame, threshold: float = 0.8, reference: dict[str, str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Ratio of selection rates with its log interval, and the decision on the four-fifths rule."""
    base = cells.where(F.col("attribute") != C.OVERALL).select("attribute", "group", "n", "n_flagged")
    both = groups.against_reference(base, groups.references(base, reference))
    lo, hi = katz("n_flagged", "n", "ref_n_flagged", "ref_n", alpha)
    p1, p2 = ratio("n_flagged", "n"), ratio("ref_n_flagged", "ref_n")
    return both.select("attribute", "group", "ref_group", F.when(p2 > 0, F.try_divide(p1, p2)).alias("ratio"), lo.alias("ci_lower"), hi.alias("ci_upper"), impact_decision(lo, hi, threshold).alias("decision"))


def subgroup_disparities(cells: DataFrame, aurocs: DataFrame | None = None, reference: dict[str, str] | None = None) -> DataFrame:
    """tpr, fpr, selection and (if given) AUROC differences and ratios against the reference group; ratios over 0 are null."""
    base = rates.group_rates(cells.where((F.col("attribute") != C.OVERALL) & (F.col("n") >= 10)), ["tpr", "fpr", "ppv", "selection_rate"]).select("attribute", "group", "n", "tpr", "fpr", "ppv", "selection_rate")
    if aurocs is not None:
        base = base.join(aurocs.select("attribute", "group", "auroc"), ["attribute", "group"], "left")
    both = groups.against_reference(base, groups.references(base, reference))
    d = {f"{m}_diff": F.col(m) - F.col(f"ref_{m}") for m in ("tpr", "fpr", "selection_rate", *(["auroc"] if aurocs is not None else []))}
    r = {f"{m}_ratio": F.when(F.col(f"ref_{m}") > 0, F.try_divide(m, f"ref_{m}")) for m in ("ppv", "selection_rate")}
    return both.select("attribute", "group", "ref_group", *(v.alias(k) for k, v in {**d, "equalized_odds_diff": F.greatest(F.abs(d["tpr_diff"]), F.abs(d["fpr_diff"])), **r}.items()))


def fairness(cells: DataFrame, reference: dict[str, str] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Fairness measures of every group against its reference; groups of fewer than 10 rows take no part.

    ``extra``: columns that, with the attribute, tell several sets of cells apart (thresholds).
    """
    base = rates.group_rates(cells.where((F.col("attribute") != C.OVERALL) & (F.col("n") >= 10)), ["tpr", "fpr", "ppv", "selection_rate"])
    base = base.withColumn("calibration_error", ratio("sum_p", "n") - F.col("prevalence")).select(*extra, "attribute", "group", "n", "tpr", "fpr", "ppv", "selection_rate", "calibration_error", "n_flagged")
    named = F.lit(0)
    for a, g in (reference or {}).items():
        named = F.when((F.col("attribute") == a) & (F.col("group") == str(g)), 1).otherwise(named)
    w = Window.partitionBy(*extra, "attribute")
    first = F.struct((-named).alias("named"), (-F.col("n")).alias("n"), F.col("group").alias("group"))
    top = F.min(first).over(w)
    refs = {c: F.max(F.when(F.col("group") == F.col("__top.group"), F.col(c))).over(w) for c in ("tpr", "fpr", "ppv", "selection_rate", "calibration_error")}
    both = base.withColumn("__top", top)
    both = both.withColumns({f"ref_{c}": x for c, x in refs.items()}).withColumn("ref_group", F.col("__top.group")).where(F.col("group") != F.col("ref_group"))
    tpr, fpr = F.col("tpr") - F.col("ref_tpr"), F.col("fpr") - F.col("ref_fpr")
    return both.select(
        *extra, "attribute", "group", "ref_group",
        F.when(F.col("ref_selection_rate") > 0, F.try_divide("selection_rate", "ref_selection_rate")).alias("demographic_parity_ratio"),
        (F.col("selection_rate") - F.col("ref_selection_rate")).alias("demographic_parity_diff"),
        tpr.alias("tpr_diff"), fpr.alias("fpr_diff"), F.greatest(F.abs(tpr), F.abs(fpr)).alias("equalized_odds_diff"),
        F.when(F.col("ref_ppv") > 0, F.try_divide("ppv", "ref_ppv")).alias("ppv_ratio"), (F.col("ppv") - F.col("ref_ppv")).alias("ppv_diff"),
        (F.col("calibration_error") - F.col("ref_calibration_error")).alias("calibration_diff"),
    )


def _largest(c: str) -> Column:
    """The signed value of the largest absolute one; ties: the greater value."""
    return F.max(F.struct(F.abs(c).alias("a"), F.col(c).alias("v")))["v"]


def fairness_summary(frame: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """For each attribute the worst signed difference of each family and whether it is within its limit."""
    low, high = F.min("ppv_ratio"), F.max("ppv_ratio")
    out = frame.groupBy(*extra, "attribute").agg(*(_largest(c).alias(f"worst_{k}") for k, c in WORST.items()), F.max("equalized_odds_diff").alias("worst_equalized_odds"), F.when(low < 1, low).otherwise(high).alias("worst_ppv_ratio"))
    limits = {k: C.CALIBRATION_DIFF if k == "calibration" else C.EO_DIFF for k in [*WORST, "equalized_odds"]}
    return out.withColumns({f"{k}_within": F.abs(f"worst_{k}") <= limit for k, limit in limits.items()})


def disparity_index(summary: DataFrame) -> DataFrame:
    """Weighted mean of the components that are present, each capped at 1, and its band."""
    part = {
        "demographic_parity": F.least(F.lit(1.0), F.abs("worst_demographic_parity") / 0.2),
        "equal_opportunity": F.least(F.lit(1.0), F.abs("worst_equal_opportunity") / 0.2),
        "equalized_odds": F.least(F.lit(1.0), F.abs("worst_equalized_odds") / 0.2),
        "predictive_parity": F.least(F.lit(1.0), F.abs(F.col("worst_ppv_ratio") - 1) / 0.4),
    }
    top, weight = F.lit(0.0), F.lit(0.0)
    for k, x in part.items():
        top = top + F.coalesce(x * C.INDEX_WEIGHTS[k], F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), C.INDEX_WEIGHTS[k]).otherwise(0.0)
    out = summary.select("attribute", *(x.alias(f"{k}_component") for k, x in part.items()), F.try_divide(top, weight).alias("disparity_index"))
    return out.withColumn("level", index_band(F.col("disparity_index")))
