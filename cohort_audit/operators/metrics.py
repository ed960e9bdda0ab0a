"""Metrics of the user's own: over groups, in bootstraps, by cluster, and statistics of a column at any size.

A metric is an object with ``update``, ``merge`` and ``finish``. Tasks update states with batches of rows, states are merged in
two levels, and only states are shuffled; so a metric runs over any number of rows if its state is bounded. Weights are whole
numbers: a row of weight 3 stands for three.

Replicates come from a table function: a seed and a group's compact table go in, a row a replicate comes out, failed
ones among them. Statistics of a column use the bag of little bootstraps: subsets of n**0.6 rows, each blown up to n by
multinomial weights, so a task holds one subset.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import clusters, groups

#: Merges of the first level for each group.
FANS = 32
#: Power of n and least rows of a subset, subsets, replicates of each.
POWER, LEAST, SUBSETS, EACH = 0.6, 2000, 10, 200


#: Errors that mean that a metric has no value for these rows; any other one is raised.
FAILURES = (ValueError, ArithmeticError, RuntimeWarning)


class Metric(Protocol):
    """What a metric has. ``state`` is None before the first rows; one of FAILURES, or nan, means no value."""

    def update(self, state: Any, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> Any: ...

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> float: ...


class Sums:
    """A metric that is a function of sums over rows: ``terms`` maps (p, y) to columns, ``of`` the sums to the value."""

    def __init__(self, terms: Callable[[np.ndarray, np.ndarray], Sequence[np.ndarray]], of: Callable[..., float]):
        self.terms, self.of = terms, of

    def update(self, state: np.ndarray | None, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        new = np.array([float((np.asarray(t, float) * w).sum()) for t in self.terms(p, y)])
        return new if state is None else state + new

    def merge(self, state: np.ndarray, other: np.ndarray) -> np.ndarray:
        return state + other

    def finish(self, state: np.ndarray) -> float:
        return float(self.of(*state))


class Counts:
    """A metric that is a function of arrays, from counts by distinct (p, y): ``of`` takes scores, outcomes and their counts.

    The state has a row for each distinct score and outcome; scores are rounded to ``places`` where that bounds it.
    """

    def __init__(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], float], places: int | None = None):
        self.of, self.places = of, places

    def update(self, state: pd.Series | None, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> pd.Series:
        p = p if self.places is None else np.round(p, self.places)
        new = pd.Series(w, index=pd.MultiIndex.from_arrays([p, y])).groupby(level=[0, 1]).sum()
        return new if state is None else self.merge(state, new)

    def merge(self, state: pd.Series, other: pd.Series) -> pd.Series:
        return pd.concat([state, other]).groupby(level=[0, 1]).sum()

    def finish(self, state: pd.Series) -> float:
        state = state[state > 0].sort_index()
        return float(self.of(state.index.get_level_values(0).to_numpy(), state.index.get_level_values(1).to_numpy(), state.to_numpy()))


def arrays(fn: Callable[[np.ndarray, np.ndarray], float]) -> Counts:
    """A metric from a plain function of (y_true, y_prob), which sees every row of a group at once: for small groups."""
    return Counts(lambda p, y, n: fn(np.repeat(y, n.astype(int)), np.repeat(p, n.astype(int))))


def value_of(metric: Metric, state: Any) -> tuple[float, bool]:
    """The value of a state and whether it failed."""
    try:
        v = float(metric.finish(state))
    except FAILURES:
        return float("nan"), True
    return v, bool(np.isnan(v))


def evaluate(df: DataFrame, attributes: Sequence[str], metric: Metric) -> DataFrame:
    """attribute, group, n, value (null where the metric fails) of every group, over all rows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for key, own in batch.groupby(["attribute", "group"], sort=False):
                state = held.setdefault(key, [None, 0])
                state[0] = metric.update(state[0], own["p"].to_numpy(), own["y"].to_numpy(), own["n"].to_numpy(float))
                state[1] += int(own["n"].sum())
        fan = TaskContext.get().partitionId() % FANS
        if held:
            yield pd.DataFrame([(a, g, fan, n, pickle.dumps(s)) for (a, g), (s, n) in held.items()], columns=["attribute", "group", "fan", "n", "state"])

    def together(pdf: pd.DataFrame) -> tuple[Any, int]:
        states = [pickle.loads(s) for s in pdf["state"]]
        out = states[0]
        for s in states[1:]:
            out = metric.merge(out, s)
        return out, int(pdf["n"].sum())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n = together(pdf)
        return pdf.iloc[:1].assign(n=n, state=[pickle.dumps(state)])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        state, n = together(pdf)
        v, failed = value_of(metric, state)
        return pdf.iloc[:1][["attribute", "group"]].assign(n=n, value=None if failed else v)

    schema = "attribute string, group string, fan long, n long, state binary"
    small = df.groupBy("p", "y", *attributes).agg(F.count(F.lit(1)).alias("n"))
    states = groups.long(small, attributes, "p", "y", "n").mapInPandas(part, schema)
    merged = states.groupBy("attribute", "group", "fan").applyInPandas(merge, schema)
    return merged.groupBy("attribute", "group").applyInPandas(finish, "attribute string, group string, n long, value double")


def _replicates(metric: Metric, stratified: bool, min_classes: int):
    @F.udtf(returnType="replicate: long, value: double, failed: boolean")
    class Replicates:
        """Replicates first, first + 1, ... of one group's table, from a seed."""

        def eval(self, p, n, k, seed, first, count):
            p, n, k = np.asarray(p, float), np.asarray(n, np.int64), np.asarray(k, np.int64)
            rng = np.random.default_rng([seed & 0xFFFFFFFF, first])
            n0 = n - k
            for i in range(count):
                if stratified and n0.sum() and k.sum():
                    s0, s1 = rng.multinomial(n0.sum(), n0 / n0.sum()), rng.multinomial(k.sum(), k / k.sum())
                else:
                    both = np.concatenate([n0, k])
                    s = rng.multinomial(both.sum(), both / both.sum())
                    s0, s1 = s[: len(p)], s[len(p) :]
                if int(s0.sum() > 0) + int(s1.sum() > 0) < min_classes:
                    yield first + i, None, True
                    continue
                x, y, w = np.concatenate([p, p]), np.repeat([0, 1], len(p)), np.concatenate([s0, s1]).astype(float)
                some = w > 0
                try:
                    v, failed = value_of(metric, metric.update(None, x[some], y[some], w[some]))
                except FAILURES:
                    v, failed = None, True
                yield first + i, None if failed else v, failed

    return Replicates


def bootstrap(df: DataFrame, attributes: Sequence[str], metric: Metric, replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, stratified: bool = True, min_classes: int = 2, resolution: int = 2000) -> DataFrame:
    """attribute, group, replicate, value, failed: a metric on resamples of each group's rows.

    ``stratified`` keeps the outcomes' numbers (a group of one outcome is drawn simply). A replicate fails with fewer than
    ``min_classes`` outcomes, on an error and on nan; its value is null. Scores of a group are joined into about ``resolution``
    bins of equal counts where it has more distinct ones.
    """
    table = groups.binned(groups.histogram(df, attributes), resolution).groupBy("attribute", "group").agg(F.array_sort(F.collect_list(F.struct("p", "n", "k"))).alias("t"))  # a bounded table a group
    chunk = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(clusters.CHUNK))).alias("first")
    chunks = table.select("attribute", "group", "t", F.xxhash64("attribute", "group", F.lit(seed)).alias("seed"), chunk).repartition("attribute", "group", "first")
    fn = _replicates(metric, stratified, min_classes)
    count = F.least(F.lit(clusters.CHUNK), F.lit(replicates) - F.col("first"))
    rows = chunks.select("attribute", "group", F.col("t.p").alias("p"), F.col("t.n").alias("n"), F.col("t.k").alias("k"), "seed", F.col("first").cast("long").alias("first"), count.cast("long").alias("count"))
    out = rows.lateralJoin(fn(*(F.col(c).outer() for c in ("p", "n", "k", "seed", "first", "count"))))
    return out.select("attribute", "group", "replicate", "value", "failed")


def metric_ci(df: DataFrame, attributes: Sequence[str], metric: Metric, alpha: float = C.ALPHA, **options: Any) -> DataFrame:
    """attribute, group, n, value, percentile interval (null with fewer than ten values), n_samples and n_failed of every group."""
    samples = bootstrap(df, attributes, metric, **options)
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    found = samples.groupBy("attribute", "group").agg(F.count("value").alias("n_samples"), F.count_if("failed").alias("n_failed"), F.stddev_pop("value").alias("se"), q.alias("q"))
    enough = F.col("n_samples") >= C.MIN_SAMPLES
    both = evaluate(df, attributes, metric).join(found, ["attribute", "group"], "left")
    return both.select("attribute", "group", "n", "value", "se", F.when(enough, F.col("q")[0]).alias("ci_lower"), F.when(enough, F.col("q")[1]).alias("ci_upper"), "n_samples", "n_failed")


def cluster_bootstrap(df: DataFrame, attributes: Sequence[str], metric: Metric, replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, resolution: int = 500) -> DataFrame:
    """attribute, group, replicate, value: a metric when whole clusters (column ``cluster``) are drawn; null where it fails."""

    def each(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        p, y = np.concatenate([x, x]), np.repeat([0, 1], len(x))
        out = []
        for a, b in zip(n, k, strict=True):
            w = np.concatenate([a - b, b]).astype(float)
            some = w > 0
            try:
                out.append(value_of(metric, metric.update(None, p[some], y[some], w[some]))[0])
            except FAILURES:
                out.append(float("nan"))
        return np.array(out)

    return clusters.score_statistic(df, list(attributes), each, replicates, seed, resolution)


def little_bootstraps(values: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float], column: str = "value", subsets: int = SUBSETS, each: int = EACH, seed: int = C.SEED) -> DataFrame:
    """subset, replicate, value: a statistic of one column's values and their weights, by the bag of little bootstraps.

    A subset has about max(n**0.6, 2000) of n rows, chosen by hash; up to 2000 rows it is the table itself, and this is the
    plain bootstrap. Nulls are left out.
    """
    rows = values.select(F.col(f"`{column}`").cast("double").alias("v")).dropna()
    n = rows.count()
    size = max(round(n**POWER), min(n, LEAST))
    parts = max(1, n // size) if n else 1
    many = max(1, min(subsets, parts))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
    chosen = rows.withColumn("subset", part).where(F.col("subset") < many)
    times = -(-each * subsets // many)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x, subset = np.sort(pdf["v"].to_numpy()), int(pdf["subset"].iloc[0])
        rng, out = np.random.default_rng([seed, subset]), []
        for _ in range(times):
            w = rng.multinomial(n, np.full(len(x), 1 / len(x)))
            try:
                out.append(float(statistic(x, w.astype(float))))
            except FAILURES:
                out.append(float("nan"))
        return pd.DataFrame({"subset": subset, "replicate": np.arange(times), "value": out})

    return chosen.groupBy("subset").applyInPandas(draw, "subset long, replicate long, value double").withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def statistic_ci(values: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float], column: str = "value", alpha: float = C.ALPHA, **options: Any) -> DataFrame:
    """estimate, se, ci_lower, ci_upper, n_samples, n_failed: means over the subsets of each one's percentile interval."""
    samples = little_bootstraps(values, statistic, column, **options)
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    own = samples.groupBy("subset").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), q.alias("q"), F.count("value").alias("c"), F.count_if(F.col("value").isNull()).alias("f"))
    return own.agg(F.avg("m").alias("estimate"), F.avg("s").alias("se"), F.avg(F.col("q")[0]).alias("ci_lower"), F.avg(F.col("q")[1]).alias("ci_upper"), F.sum("c").alias("n_samples"), F.sum("f").alias("n_failed"))


def weighted_mean(x: np.ndarray, w: np.ndarray) -> float:
    return float(x @ w / w.sum())


def weighted_quantile(q: float) -> Callable[[np.ndarray, np.ndarray], float]:
    """The least value with at least a share q of the weight at or below it; for values in ascending order."""
    return lambda x, w: float(x[min(len(x) - 1, np.searchsorted(np.cumsum(w), q * w.sum() - 1e-9))])
