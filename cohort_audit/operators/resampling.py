"""Bootstrap inference.

Replicates are spread over tasks (group x chunk of replicates), each with its own seeded generator, and resample compact
tables (confusion cells, score histograms, per-cluster sums) rather than rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import clusters as cluster_draws
from . import groups, rates

CHUNK = 50


def _generator(seed: int, *names: object) -> np.random.Generator:
    return np.random.default_rng([seed, *(int(h) for h in pd.util.hash_array(np.array([str(n) for n in names], object)) % 2**32)])


def percentile_ci(samples: DataFrame, by: Sequence[str] = ("attribute", "group"), alpha: float = C.ALPHA, value: str = "value") -> DataFrame:
    """Percentile interval of the samples of each key; null with fewer than ten."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = samples.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("se"), q.alias("q"))
    enough = F.col("n_samples") >= C.MIN_SAMPLES
    return out.select(*by, "n_samples", "mean", "se", F.when(enough, F.col("q")[0]).alias("ci_lower"), F.when(enough, F.col("q")[1]).alias("ci_upper"))


def format_ci(frame: DataFrame, value: str = "mean") -> DataFrame:
    return frame.withColumn("ci_fmt", F.when(F.col("ci_lower").isNotNull(), F.format_string("(95% CI: %.3f-%.3f)".replace("95%", "95%%"), "ci_lower", "ci_upper")))


def _weighted_auroc(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """AUROC of each row of counts of negatives and positives by ascending score; nan with one class."""
    before = np.cumsum(n0, axis=1) - n0
    with np.errstate(invalid="ignore", divide="ignore"):
        return (n1 * (before + n0 / 2)).sum(1) / (n0.sum(1) * n1.sum(1))


def weighted_precision(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Average precision of each row of counts of negatives and positives by ascending score; nan without positives."""
    flagged, hits = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (n0 + n1, n1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (n1 * np.divide(hits, flagged, out=np.zeros_like(hits), where=flagged > 0)).sum(1) / n1.sum(1)


def _chunks(frame: DataFrame, replicates: int) -> DataFrame:
    return frame.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // CHUNK) - 1))))


def bootstrap_auroc(df: DataFrame, attributes: Sequence[str] = (), replicates: int = C.N_BOOTSTRAP_SUBGROUP, seed: int = C.SEED, stratified: bool = True, resolution: int = 2000, metric: Callable[[np.ndarray, np.ndarray], np.ndarray] = _weighted_auroc, overall: bool = True) -> DataFrame:
    """AUROC samples: attribute, group, replicate, value.

    A group's scores are joined into about ``resolution`` bins of equal counts where it has more (:func:`groups.binned`, which
    bounds the change of the value), so a task holds a bounded table; a resample draws the counts (two multinomials if ``stratified`` by outcome, else one). Replicates with one class are left out. ``metric``
    maps counts of negatives and positives by ascending score (a row a replicate) to values.
    """
    hist = groups.binned(groups.histogram(df, attributes, overall), resolution)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a, g, chunk = pdf["attribute"].iloc[0], pdf["group"].iloc[0], int(pdf["chunk"].iloc[0])
        pdf = pdf.sort_values("p")
        n1 = pdf["k"].to_numpy()
        n0 = pdf["n"].to_numpy() - n1
        size = min(CHUNK, replicates - chunk * CHUNK)
        rng = _generator(seed, a, g, chunk)
        if stratified:
            if not n0.sum() or not n1.sum():
                return pd.DataFrame({"attribute": [], "group": [], "replicate": [], "value": []})
            s0, s1 = rng.multinomial(n0.sum(), n0 / n0.sum(), size), rng.multinomial(n1.sum(), n1 / n1.sum(), size)
        else:
            both = np.concatenate([n0, n1])
            s = rng.multinomial(both.sum(), both / both.sum(), size)
            s0, s1 = s[:, : len(n0)], s[:, len(n0) :]
        v = metric(s0.astype(float), s1.astype(float))
        ok = ~np.isnan(v)
        return pd.DataFrame({"attribute": a, "group": g, "replicate": (chunk * CHUNK + np.arange(size))[ok], "value": v[ok]})

    return _chunks(hist, replicates).groupBy("attribute", "group", "chunk").applyInPandas(draw, "attribute string, group string, replicate long, value double")


def _weighted_ace(scores: np.ndarray, n: np.ndarray, k: np.ndarray, bins: int, least: int) -> float:
    """Adaptive calibration error of counts by ascending score; nan if no bin is large enough."""
    cum = np.cumsum(n)
    total = cum[-1]
    if total <= 0:
        return float("nan")
    h = (total - 1) * np.arange(bins + 1) / bins
    low, high = (scores[np.searchsorted(cum, np.floor(h) + 1e-9, "right").clip(0, len(scores) - 1)], scores[np.searchsorted(cum, np.ceil(h) + 1e-9, "right").clip(0, len(scores) - 1)])
    edges = np.unique(low + (high - low) * (h - np.floor(h)))
    at = np.searchsorted(edges[1:-1], scores, "right")
    size, pos, sum_p = (np.bincount(at, w, minlength=1) for w in (n, k, n * scores))
    ok = size >= least
    return float(np.abs(pos - sum_p)[ok].sum() / size[ok].sum()) if ok.any() else float("nan")


def bootstrap_ace(df: DataFrame, attributes: Sequence[str] = (), replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, clusters: bool = False, bins: int = C.BINS, least: int = 5, resolution: int = 2000) -> DataFrame:
    """Samples of the adaptive calibration error: attribute, group, replicate, value.

    A group's scores are joined into about ``resolution`` bins of equal counts where it has more. Rows are resampled by multinomial
    counts, or with ``clusters`` whole clusters (column ``cluster``) are drawn, the same ones for all groups.
    """
    schema = "attribute string, group string, replicate long, value double"
    if clusters:

        def each(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
            return np.array([_weighted_ace(x, *(v.astype(float) for v in row), bins, least) for row in zip(n, k, strict=True)])

        return cluster_draws.score_statistic(df, attributes, each, replicates, seed, min(resolution, 500)).where("value is not null")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        a, g, chunk = pdf["attribute"].iloc[0], pdf["group"].iloc[0], int(pdf["chunk"].iloc[0])
        pdf = pdf.sort_values("p")
        k, x = pdf["k"].to_numpy(), pdf["p"].to_numpy()
        both = np.concatenate([pdf["n"].to_numpy() - k, k])
        size = min(CHUNK, replicates - chunk * CHUNK)
        s = _generator(seed, "ace", a, g, chunk).multinomial(both.sum(), both / both.sum(), size).astype(float)
        v = np.array([_weighted_ace(x, r[: len(x)] + r[len(x) :], r[len(x) :], bins, least) for r in s])
        return pd.DataFrame({"attribute": a, "group": g, "replicate": chunk * CHUNK + np.arange(size), "value": v}).dropna()

    return _chunks(groups.binned(groups.histogram(df, attributes), resolution), replicates).groupBy("attribute", "group", "chunk").applyInPandas(draw, schema)


def discrimination_samples(df: DataFrame, attributes: Sequence[str] = (), replicates: int = C.N_BOOTSTRAP_SUBGROUP, seed: int = C.SEED, metric: Callable[[np.ndarray, np.ndarray], np.ndarray] = _weighted_auroc) -> DataFrame:
    """Samples of the AUROC, or of another metric of score counts: all rows drawn simply, groups with their outcomes' numbers kept."""
    whole = bootstrap_auroc(df, [], replicates, seed, False, metric=metric)
    return whole.unionByName(bootstrap_auroc(df, attributes, replicates, seed, True, metric=metric, overall=False)) if attributes else whole


def gap_samples(samples: DataFrame) -> DataFrame:
    """Greatest less least value over the groups of an attribute, in each replicate."""
    return samples.where(F.col("attribute") != C.OVERALL).groupBy("attribute", "replicate").agg((F.max("value") - F.min("value")).alias("value"))


def bootstrap_confusion(cells: DataFrame, replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, stratified: bool = False) -> DataFrame:
    """Samples of sensitivity, specificity, ppv and npv, drawn from the four cells alone; 0 on an empty denominator."""

    def draw(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rng = _generator(seed, r.attribute, r.group)
                tp, fp, tn, fn = r.tp, r.fp, r.tn, r.fn
                if stratified:
                    t = rng.binomial(tp + fn, tp / max(tp + fn, 1), replicates)
                    u = rng.binomial(tn + fp, tn / max(tn + fp, 1), replicates)
                    s = np.stack([t, tn + fp - u, u, tp + fn - t])
                else:
                    s = rng.multinomial(r.n, np.array([tp, fp, tn, fn]) / max(r.n, 1), replicates).T
                a, b, c, d = s.astype(float)
                rate = {"sensitivity": (a, a + d), "specificity": (c, c + b), "ppv": (a, a + b), "npv": (c, c + d)}
                for m, (x, y) in rate.items():
                    yield pd.DataFrame({"attribute": r.attribute, "group": r.group, "metric": m, "replicate": np.arange(replicates), "value": np.divide(x, y, out=np.zeros_like(x), where=y > 0)})

    return cells.select("attribute", "group", "n", "tp", "fp", "tn", "fn").mapInPandas(draw, "attribute string, group string, metric string, replicate long, value double")


def cluster_bootstrap(df: DataFrame, attributes: Sequence[str], threshold: float = 0.5, metric: str = "tpr", replicates: int = 500, seed: int = C.SEED) -> DataFrame:
    """Samples of a rate when whole clusters are drawn with replacement: attribute, group, replicate, value.

    Rows are first summed by cluster and group; :mod:`clusters` draws the clusters and adds up their sums. Clusters without a
    row that counts are drawn too.
    """
    num, den = rates.RATES[metric]
    keyed = cluster_draws.keyed(df)
    sums = rates.derived(groups.long(keyed, attributes, "p", "y", "key").groupBy("attribute", "group", "key").agg(*rates.aggregates(threshold)))
    sums = sums.select("key", "attribute", "group", F.lit(0).cast("long").alias("cell"), F.col(num).cast("double").alias("a"), F.col(den).cast("double").alias("b"))

    def rate(_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a[:, 0], b[:, 0], out=np.full(len(a), np.nan), where=b[:, 0] > 0)

    return cluster_draws.by_replicate(sums, cluster_draws.draws(keyed, replicates, seed), rate)


def cluster_auroc(df: DataFrame, attributes: Sequence[str] = (), replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, resolution: int = 500) -> DataFrame:
    """AUROC samples when whole clusters are drawn: attribute, group, replicate, value (null with one class)."""
    return cluster_draws.score_statistic(df, attributes, lambda _, n, k: _weighted_auroc(n.astype(float) - k, k.astype(float)), replicates, seed, resolution)
