"""Cohort description: overview, outcome and score by attribute, Table 1, association with the outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import OVERALL
from ..functions.intervals import chi2_p, cramers_band, fisher_p, ratio, wilson_plain
from . import groups


def _totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_positive"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max"))


def cohort_overview(df: DataFrame) -> DataFrame:
    """Counts, prevalence, and moments and percentiles of the score (population deviation)."""
    q = groups.quantiles(groups.histogram(df, []), (0.25, 0.5, 0.75, 0.9, 0.95)).select("attribute", "q")
    one = _totals(df).withColumn("attribute", F.lit(OVERALL)).join(q, "attribute", "left")  # a row each
    return one.select("n_total", "n_positive", (F.col("n_total") - F.col("n_positive")).alias("n_negative"), ratio("n_positive", "n_total").alias("prevalence"), "mean", "std", "min", "max", *(F.col("q")[i].alias(n) for i, n in enumerate(("percentile_25", "median", "percentile_75", "percentile_90", "percentile_95"))))


def outcome_by_attribute(df: DataFrame, attributes: Sequence[str], reference: dict[str, str] | None = None) -> DataFrame:
    """Rows, share, outcome rate with interval, rate ratio to the reference, mean and sample deviation of the score by group.

    A null group is shown as ``Unknown``; it cannot be the reference.
    """
    filled = df.select("p", "y", *(F.coalesce(F.col(a), F.lit("Unknown")).alias(a) for a in attributes))
    cells = groups.long(filled, attributes, "p", "y", overall=False).groupBy("attribute", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"), F.avg("p").alias("mean_prob"), F.stddev_samp("p").alias("std_prob"))
    refs = groups.references(cells.where("group <> 'Unknown'"), reference).select("attribute", F.col("group").alias("ref_group"), ratio("n_positive", "n").alias("ref_rate"))
    total = cells.groupBy("attribute").agg(F.sum("n").alias("total"))
    lo, hi = wilson_plain("n_positive", "n")
    rate = ratio("n_positive", "n")
    both = cells.join(F.broadcast(total), "attribute").join(F.broadcast(refs), "attribute", "left")  # a row an attribute
    return both.select("attribute", "group", "n", ratio("n", "total").alias("pct"), "n_positive", rate.alias("outcome_rate"), lo.alias("ci_95_low"), hi.alias("ci_95_high"), F.when(F.col("ref_rate") > 0, F.try_divide(rate, "ref_rate")).alias("rate_ratio"), (F.col("group") == F.coalesce("ref_group", F.lit(""))).alias("is_reference"), "mean_prob", "std_prob")


def table1(df: DataFrame, attributes: Sequence[str], reference: dict[str, str] | None = None) -> DataFrame:
    """category, group, n, percentage, outcome rate, rate ratio and interval: overall first in meaning, groups of each attribute."""
    lo, hi = wilson_plain("n_positive", "n_total")
    top = _totals(df).select(F.lit("Overall").alias("category"), F.lit("All").alias("group"), F.col("n_total").alias("n"), F.lit(100.0).alias("percentage"), ratio("n_positive", "n_total").alias("outcome_rate"), F.lit(1.0).alias("rate_ratio"), lo.alias("ci_95_low"), hi.alias("ci_95_high"))
    rest = outcome_by_attribute(df, attributes, reference).select(F.col("attribute").alias("category"), "group", "n", (100 * F.col("pct")).alias("percentage"), "outcome_rate", "rate_ratio", "ci_95_low", "ci_95_high")
    return top.unionByName(rest)


def continuous_summary(df: DataFrame, column: str, attributes: Sequence[str] = ()) -> DataFrame:
    """n, missing, mean, population deviation, quartiles, least and greatest of a column, overall and by group."""
    rows = groups.long(df, attributes, column)
    hist = rows.where(F.col(column).isNotNull()).groupBy("attribute", "group", F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    q = groups.quantiles(hist, (0.25, 0.5, 0.75), "x", ranges=groups.value_range)
    out = rows.groupBy("attribute", "group").agg(F.count(column).alias("n"), F.count_if(F.col(column).isNull()).alias("n_missing"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).join(q, ["attribute", "group"], "left")
    return out.select("attribute", "group", "n", "n_missing", "mean", "std", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "min", "max")


def crosstab(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attribute, group, n_0, n_1: the outcome by group."""
    rows = groups.long(df, attributes, "y", overall=False)
    return rows.groupBy("attribute", "group").pivot("y", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "n_0", "1": "n_1"})


def chi_square(table: DataFrame) -> DataFrame:
    """Chi-square of a crosstab (with continuity correction for two groups), degrees of freedom, Cramer's V and its band."""
    whole = table.groupBy("attribute").agg(F.sum("n_0").alias("t0"), F.sum("n_1").alias("t1"), F.count(F.lit(1)).alias("r"))
    cells = table.join(F.broadcast(whole), "attribute").withColumn("n", F.col("n_0") + F.col("n_1"))

    def part(c: str, t: str):
        e = F.try_divide(F.col("n") * F.col(t).cast("double"), F.col("t0") + F.col("t1"))
        d = F.abs(F.col(c) - e)
        d = F.when(F.col("r") == 2, d - F.least(F.lit(0.5), d)).otherwise(d)
        return F.coalesce(F.try_divide(d * d, e), F.lit(0.0))

    out = cells.groupBy("attribute").agg(F.sum(part("n_0", "t0") + part("n_1", "t1")).alias("chi2"), (F.max("r") - 1).alias("dof"), F.sum("n").alias("n"))
    v = F.when(F.col("dof") > 0, F.sqrt(F.try_divide("chi2", "n"))).otherwise(F.lit(0.0))
    return out.withColumn("cramers_v", v).withColumn("interpretation", cramers_band(F.col("cramers_v")))


def chi_square_test(table: DataFrame) -> DataFrame:
    return chi_square(table).withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof").cast("double")))


def fisher_against_reference(table: DataFrame, reference: dict[str, str] | None = None) -> DataFrame:
    """Exact two-sided p of each group's outcome against the reference group's."""
    base = table.withColumn("n", F.col("n_0") + F.col("n_1"))
    both = groups.against_reference(base, groups.references(base, reference))
    return both.select("attribute", "group", "ref_group", fisher_p("n_1", "n_0", "ref_n_1", "ref_n_0").alias("p_value"))


def table1_text(rows: list, title: str = "Table 1") -> str:
    """Console text of collected Table 1 rows."""
    lines = [title, "=" * len(title), f"{'':<34}{'n':>9}{'%':>8}{'rate':>9}  95% CI"]
    category = None
    for r in sorted(rows, key=lambda r: (r["category"] != "Overall", r["category"], r["group"])):
        if r["category"] != category:
            category = r["category"]
            lines.append(category)
        lines.append(f"  {r['group']:<32}{r['n']:>9}{r['percentage']:>8.1f}{r['outcome_rate']:>9.3f}  [{r['ci_95_low']:.3f}, {r['ci_95_high']:.3f}]")
    return "\n".join(lines)


