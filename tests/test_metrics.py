"""Metrics of the user's own over groups, in bootstraps and by cluster; statistics of a column at any size."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_clusters import cohort

from cohort_audit.operators import metrics, resampling

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks have no tests


def brier():
    return metrics.Sums(lambda p, y: ((p - y) ** 2, np.ones_like(p)), lambda s, n: s / n)


def auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg) + (pos[:, None] == neg) / 2).mean() if len(pos) and len(neg) else np.nan


class Fails:
    """Fails where a group has more than half positives."""

    def update(self, state, p, y, w):
        return (0, 0) if state is None and not len(p) else (w.sum() + (state or (0, 0))[0], (w * y).sum() + (state or (0, 0))[1])

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        if state[1] > 0.27 * state[0]:
            raise ValueError("too many")
        return state[1] / state[0]


def test_a_metric_over_groups(spark):
    df = cohort(spark).repartition(7)
    pdf = df.toPandas()
    for metric, want in ((brier(), lambda d: ((d.p - d.y) ** 2).mean()), (metrics.arrays(auroc), lambda d: auroc(d.y.to_numpy(), d.p.to_numpy()))):
        got = {r["group"]: r for r in metrics.evaluate(df, ["g"], metric).collect()}
        assert set(got) == {"x", "y", "z", "_overall"}
        for g, r in got.items():
            own = pdf if g == "_overall" else pdf[pdf.g == g]
            assert r["n"] == len(own) and r["value"] == pytest.approx(want(own))


def test_intervals_equal_the_library_s_own(spark):
    """The AUROC as a user's metric against the built-in bootstrap; failures are counted."""
    df = cohort(spark)
    own = {r["group"]: r for r in metrics.metric_ci(df, ["g"], metrics.arrays(auroc), replicates=300).collect()}
    built = {r["group"]: r for r in resampling.percentile_ci(resampling.bootstrap_auroc(df, ["g"], 300)).collect()}
    for g, r in own.items():
        assert r["n_samples"] == 300 and r["n_failed"] == 0
        assert r["ci_lower"] == pytest.approx(built[g]["ci_lower"], abs=0.02) and r["ci_upper"] == pytest.approx(built[g]["ci_upper"], abs=0.02)
        assert r["ci_lower"] < r["value"] < r["ci_upper"]


def test_failed_replicates_are_counted(spark):
    df = cohort(spark)
    rows = {r["group"]: r for r in metrics.metric_ci(df, ["g"], Fails(), replicates=200, stratified=False).collect()}
    assert all(r["n_samples"] + r["n_failed"] == 200 for r in rows.values()) and any(0 < r["n_failed"] < 200 for r in rows.values())
    one = df.where("y = 1")
    classes = metrics.metric_ci(one, [], brier(), replicates=50).first()
    assert (classes["n_samples"], classes["n_failed"], classes["ci_lower"]) == (0, 50, None) and classes["value"] is not None
    assert metrics.metric_ci(one, [], brier(), replicates=50, min_classes=1).first()["n_failed"] == 0


def test_replicates_depend_on_the_seed_alone(spark):
    df = cohort(spark)
    a, b, c = (sorted(map(tuple, metrics.bootstrap(t, ["g"], brier(), 120, seed).collect()), key=str) for t, seed in ((df, 1), (df.repartition(9), 1), (df, 2)))
    assert len(a) == 480 and [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b]) and not np.allclose([r[3] for r in a], [r[3] for r in c])


def test_a_metric_by_cluster(spark):
    df = cohort(spark, c=25)
    own = {(r["group"], r["replicate"]): r["value"] for r in metrics.cluster_bootstrap(df, ["g"], metrics.arrays(auroc), 60).collect()}
    built = {(r["group"], r["replicate"]): r["value"] for r in resampling.cluster_auroc(df, ["g"], 60).collect()}
    assert own.keys() == built.keys() and all(own[k] == pytest.approx(built[k], abs=1e-6) for k in own)


@pytest.mark.parametrize("n", [500, 60_000])
def test_little_bootstraps_have_the_plain_interval(spark, n):
    values = spark.range(n).select((F.randn(3) * 2 + 5).alias("value"))
    for statistic, plain in ((metrics.weighted_mean, np.mean), (metrics.weighted_quantile(0.5), np.median)):
        x = np.array([r[0] for r in values.collect()])
        rng = np.random.default_rng(1)
        lo, hi = np.quantile([plain(rng.choice(x, n)) for _ in range(600)], [0.025, 0.975])
        got = metrics.statistic_ci(values, statistic).first()
        width = hi - lo
        assert got["n_failed"] == 0 and got["n_samples"] >= 2000
        assert (got["ci_upper"] - got["ci_lower"]) == pytest.approx(width, rel=0.2)
        # Subsets have estimates of their own; their mean lies within a fraction of a deviation.
        assert got["estimate"] == pytest.approx(plain(x), abs=width * (0.1 if n <= 2000 else 1.5))


def test_little_bootstraps_on_odd_columns(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (None,)], "`a.b` double")
    got = metrics.statistic_ci(df, metrics.weighted_mean, "a.b").first()
    assert 1 <= got["ci_lower"] <= got["ci_upper"] <= 2
    assert metrics.statistic_ci(df.where("false"), metrics.weighted_mean, "a.b").first()["n_samples"] is None
