"""A streaming monitor: confusion cells and calibration sums by time window, attribute and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups, rates


def windowed_cells(stream: DataFrame, time: str, attributes: Sequence[str], threshold: float = 0.5, window: str = "1 hour", slide: str | None = None, late: str = "2 hours", prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Cells of every window, attribute and group of a stream (or a table); rows later than ``late`` are left out.

    All statistics are sums, so state is one row a window and group.
    """
    base = stream.withWatermark(time, late).select(F.col(time).alias("t"), F.col(prob).cast("double").alias("p"), F.col(label).cast("int").alias("y"), *(F.col(a).cast("string").alias(a) for a in attributes))
    rows = groups.long(base, attributes, "t", "p", "y")
    span = F.window("t", window, slide) if slide else F.window("t", window)
    out = rates.derived(rows.groupBy(span.alias("window"), "attribute", "group").agg(*rates.aggregates(threshold)))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(c for c in out.columns if c != "window"))


def windowed_rates(stream: DataFrame, time: str, attributes: Sequence[str], **options) -> DataFrame:
    """Rates of every window and group, with Brier score and observed to expected."""
    cells = windowed_cells(stream, time, attributes, **options)
    return rates.group_rates(cells).withColumns({"brier_score": F.try_divide("sum_sq", "n"), "oe_ratio": F.when(F.col("sum_p") > 0, F.try_divide(F.col("n_positive").cast("double"), "sum_p"))})
