"""Ordered statistics of a stream: AUROC, calibration error and drift by time window, with outcomes that arrive late.

Scores and outcomes are two streams, joined by id within a time limit. Rows are then counted by window, group and score bucket:
state is a row for each of these, whatever the traffic. When the watermark closes a window its buckets go to a processor
that keeps one histogram a group, that of the window before, and emits one row a window. :func:`of_table` does the same to a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..operators import groups
from ..operators.resampling import _weighted_ace, _weighted_auroc

#: Score buckets; bands of the score for drift.
BUCKETS, BANDS = 1000, 10
RESULT = "attribute string, group string, window_start timestamp, window_end timestamp, n long, n_positive long, auroc double, ace double, drift double"


def with_outcomes(scores: DataFrame, outcomes: DataFrame, on: str, scored: str, known: str, within: str = "30 days", late: str = "2 hours") -> DataFrame:
    """Scores with the outcomes of the same id known at most ``within`` later; rows later than ``late`` are left out.

    ``scored`` and ``known`` are the time columns of the two sides; columns of ``outcomes`` other than these and ``on`` are added.
    """
    left = scores.withWatermark(scored, late)
    right = outcomes.withColumnRenamed(on, "__id").withColumnRenamed(known, "__known").withWatermark("__known", late)
    near = (F.col("__known") >= F.col(scored)) & (F.col("__known") <= F.col(scored) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(on) == F.col("__id")) & near).drop("__id", "__known")


def buckets(rows: DataFrame, time: str, attributes: Sequence[str], window: str = "1 hour", prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """window, attribute, group, bucket, n, k, sp: counts, positives and sum of scores. ``rows`` of a stream have a watermark."""
    base = rows.select(F.col(time).alias("t"), F.col(prob).cast("double").alias("p"), F.col(label).cast("int").alias("y"), *(F.col(a).cast("string").alias(a) for a in attributes))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.col("p") * BUCKETS)).alias("bucket")
    keyed = groups.long(base, attributes, "t", "p", "y")
    return keyed.groupBy(F.window("t", window).alias("window"), "attribute", "group", bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"), F.sum("p").alias("sp"))


def measured(pdf: pd.DataFrame, before: np.ndarray | None) -> tuple[list[tuple], np.ndarray | None]:
    """A row for each window of one group's buckets, in time order, and the last window's bands; ``before``: bands of the one before."""
    out = []
    for (start, end), own in pdf.groupby(["start", "end"], sort=True):
        own = own.sort_values("bucket")
        n, k = own["n"].to_numpy(float), own["k"].to_numpy(float)
        auroc = float(_weighted_auroc((n - k)[None], k[None])[0])
        ace = _weighted_ace(own["sp"].to_numpy() / n, n, k, C.BINS, 5)
        bands = np.bincount(own["bucket"].to_numpy() * BANDS // BUCKETS, n, BANDS)
        drift = None
        if before is not None:
            a, b = ((x + 0.5) / (x + 0.5).sum() for x in (before, bands))
            drift = float(((b - a) * np.log(b / a)).sum())  # population stability index
        out.append((start, end, int(n.sum()), int(k.sum()), *(None if np.isnan(v) else v for v in (auroc, ace)), drift))
        before = bands
    return out, before


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *r) for r in rows], columns=["attribute", "group", "window_start", "window_end", "n", "n_positive", "auroc", "ace", "drift"])


def _ends(counted: DataFrame) -> DataFrame:
    return counted.select("attribute", "group", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "bucket", "n", "k", "sp")


class Closed(StatefulProcessor):
    """Measures the windows of a group as they close; its state is the bands of the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "bands array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # All buckets of a window close together, and windows close in the order of time.
        before = np.array(self.last.get()[0]) if self.last.exists() else None
        out, last = measured(pd.concat(list(rows)), before)
        self.last.update((last.tolist(),))
        yield _frame(key, out)

    def close(self) -> None:
        pass


def of_stream(counted: DataFrame) -> DataFrame:
    """One row a closed window and group of a stream of :func:`buckets` (append mode). Its state needs the RocksDB store, which this sets."""
    counted.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _ends(counted).groupBy("attribute", "group").transformWithStateInPandas(Closed(), RESULT, "append", "none")


def of_table(counted: DataFrame) -> DataFrame:
    """The same rows of a table's :func:`buckets`: a group's windows and buckets are a bounded table for each window."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(key, measured(pdf, None)[0])

    return _ends(counted).groupBy("attribute", "group").applyInPandas(run, RESULT)
