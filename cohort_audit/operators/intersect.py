"""Intersections of attributes and vulnerable groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import auroc_range_band
from . import discrimination, groups, rates

SEPARATOR = " x "


def _crossed(df: DataFrame, sets: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """``df`` with one column for each set, its composite group (null if a part is null)."""
    names = [SEPARATOR.join(s) for s in sets]
    cols = [F.concat(*(x for i, a in enumerate(s) for x in ([F.lit(SEPARATOR)] if i else []) + [F.col(a)])).alias(n) for s, n in zip(sets, names, strict=True)]
    return df.select("p", "y", *cols), names


def _history(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("attribute"), F.col(f"`{n}`").alias("group")) for n in names]
    long = df.select("p", "y", F.explode(F.array(*rows)).alias("g")).select("g.attribute", "g.group", "p", "y").where(F.col("group").isNotNull())
    return long.groupBy("attribute", "group", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))


def intersectional(df: DataFrame, sets: Sequence[Sequence[str]], threshold: float = 0.5, least: int = 30) -> DataFrame:
    """Rates and AUROC of the groups of each set of attributes; groups of fewer than ``least`` rows are left out."""
    cells = rates.group_rates(rates.cells(df, [], threshold, overall=False, sets=sets), ["tpr", "fpr", "ppv", "selection_rate"]).where(F.col("n") >= least)
    wide, names = _crossed(df, sets)
    auc = discrimination.auroc(_history(wide, names)).select("attribute", "group", "auroc")
    return cells.select("attribute", "group", "n", "prevalence", "tpr", "fpr", "ppv", "selection_rate").join(auc, ["attribute", "group"], "left")


def intersection_summary(frame: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Number of groups, best and worst AUROC and group, range and concern of each set (with the number left out, if given)."""
    out = frame.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_intersections"), F.max("auroc").alias("best_auroc"), F.min("auroc").alias("worst_auroc"), F.min(F.struct(-F.col("auroc"), "group"))["group"].alias("best_performing"), F.min(F.struct("auroc", "group"))["group"].alias("worst_performing"))
    out = out.withColumn("auroc_range", F.col("best_auroc") - F.col("worst_auroc")).withColumn("concern_level", auroc_range_band(F.col("auroc_range")))
    return out if excluded is None else out.join(excluded, "attribute", "left")


def vulnerable_subgroups(df: DataFrame, attributes: Sequence[str], threshold: float = 0.5, limit: float = 0.7, least: int = 30) -> DataFrame:
    """Single and paired groups of at least ``least`` rows whose AUROC is below the limit, lowest first."""
    sets = [[a] for a in attributes] + groups.pairs(attributes)
    out = intersectional(df, sets, threshold, least).where(F.col("auroc") < limit)
    return out.select("attribute", "group", "n", "auroc", (F.lit(limit) - F.col("auroc")).alias("gap")).orderBy("auroc", "attribute", "group")


def summarize_vulnerable(frame: DataFrame) -> DataFrame:
    """Count, worst group and status: PASS without any, REVIEW up to two, else CONCERN."""
    return frame.agg(F.count(F.lit(1)).alias("n_vulnerable"), F.min("auroc").alias("worst_auroc"), F.min(F.struct("auroc", "attribute", "group"))["group"].alias("worst_group")).withColumn("status", F.when(F.col("n_vulnerable") == 0, "PASS").when(F.col("n_vulnerable") <= 2, "REVIEW").otherwise("CONCERN"))
