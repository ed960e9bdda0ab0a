"""Correction of p-values for the number of tests, over all rows of a (small, aggregated) frame or within families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjust(frame: DataFrame, column: str = "p_value", family: Sequence[str] = (), method: str = "fdr_bh") -> DataFrame:
    """Adds ``p_adjusted`` by ``holm``, ``fdr_bh`` or ``none``; equal p-values get equal results."""
    if method == "none":
        return frame.withColumn("p_adjusted", F.col(column))
    if method not in ("holm", "fdr_bh"):
        raise ValueError(f"unknown method: {method}")
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    ranked = frame.withColumn("__m", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(column)))
    if method == "holm":
        step = F.least(F.lit(1.0), F.col(column) * (F.col("__m") - F.col("__i") + 1))
        out = ranked.withColumn("p_adjusted", F.max(step).over(w.orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        step = F.least(F.lit(1.0), F.col(column) * F.col("__m") / F.col("__i"))
        out = ranked.withColumn("p_adjusted", F.min(step).over(w.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.drop("__m", "__i")
