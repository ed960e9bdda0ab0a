"""Draws of whole clusters: exact counts, sums against a replay of the draws row by row, statistics of scores."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort_audit.operators import clusters, resampling


def cohort(spark, seed=5, n=1500, c=120):
    rng = np.random.default_rng(seed)
    cluster = rng.integers(0, c, n)
    p = np.round(rng.beta(1, 3, n), 2)
    y = rng.binomial(1, p)
    rows = [(float(a), int(b), str(rng.choice(["x", "y", "z"])), None if k == 0 else f"c{k}") for a, b, k in zip(p, y, cluster, strict=True)]
    return spark.createDataFrame(rows, "p double, y int, g string, cluster string")


@pytest.mark.parametrize(("sizes", "replicates"), [([7], 30), ([3, 0, 5, 9], 200), ([1] * 64, 100), ([0, 0, 0, 4], 50)])
def test_counts_sum_to_the_number_of_clusters(sizes, replicates):
    d = clusters.Draws(np.array(sizes), replicates, 3)
    whole = np.concatenate([d.of_clusters(b) for b in range(len(sizes)) if sizes[b]])
    assert whole.shape == (sum(sizes), replicates) and (whole.sum(0) == sum(sizes)).all()
    assert (np.concatenate([clusters.Draws(np.array(sizes), replicates, 3).of_clusters(b) for b in range(len(sizes)) if sizes[b]]) == whole).all()


def test_counts_have_the_moments_of_a_multinomial():
    d = clusters.Draws(np.array([10, 30, 5, 19]), 20_000, 1)
    x = np.concatenate([d.of_clusters(b) for b in range(4)]).astype(float)
    c = len(x)
    assert np.abs(x.mean(1) - 1).max() < 0.05 and abs(x.var(1).mean() - (1 - 1 / c)) < 0.03
    pairs = np.cov(x)
    assert abs(pairs[np.triu_indices(c, 1)].mean() + 1 / c) < 0.01


def replay(df, replicates, seed):
    """Every replicate's weight of each row, by drawing the clusters outside Spark."""
    keyed = clusters.keyed(df)
    drawn = clusters.draws(keyed, replicates, seed)
    pdf = keyed.toPandas()
    count = len(drawn.levels[-1])
    weight = {}
    for bucket in range(count):
        keys = sorted(k for k in pdf["key"].unique() if k % count == bucket)
        if keys:
            weight |= dict(zip(keys, drawn.of_clusters(bucket), strict=True))
    assert sum(w for w in weight.values()).tolist() == [len(weight)] * replicates
    return pdf, np.stack([weight[k] for k in pdf["key"]])


@pytest.mark.parametrize("fill", [4, 256])
def test_samples_equal_a_replay(spark, monkeypatch, fill):
    monkeypatch.setattr(clusters, "FILL", fill)
    df, replicates = cohort(spark), 120
    pdf, w = replay(df, replicates, 42)
    rate = {(r["group"], r["replicate"]): r["value"] for r in resampling.cluster_bootstrap(df, ["g"], 0.3, "tpr", replicates).collect()}
    auroc = {(r["group"], r["replicate"]): r["value"] for r in resampling.cluster_auroc(df, ["g"], replicates).collect()}
    ace = {(r["group"], r["replicate"]): r["value"] for r in resampling.bootstrap_ace(df, ["g"], replicates, clusters=True).collect()}
    assert len(rate) == len(auroc) == 4 * replicates
    for group in ("x", "y", "z", "_overall"):
        own = np.ones(len(pdf), bool) if group == "_overall" else (pdf["g"] == group).to_numpy()
        p, y = pdf["p"].to_numpy()[own], pdf["y"].to_numpy()[own]
        for i in (0, 49, 50, 119):
            v = w[own, i]
            hit = v[(y == 1) & (p >= 0.3)].sum() / v[y == 1].sum()
            assert rate[group, i] == pytest.approx(hit, abs=1e-6)
            x = np.unique(p)
            n0, n1 = (np.array([v[(p == s) & (y == c)].sum() for s in x], float) for c in (0, 1))
            assert auroc[group, i] == pytest.approx(resampling._weighted_auroc(n0[None], n1[None])[0], abs=1e-6)
            assert ace[group, i] == pytest.approx(resampling._weighted_ace(x, n0 + n1, n1, 10, 5), abs=1e-6)


@pytest.mark.parametrize("value", [1, 3, 0.25, 1 << 23])
def test_sums_of_a_bucket_pass_over_its_rows_once(value, monkeypatch):
    """Sums against a direct product; and no more than a layer of the stretches is read at a time, each row's weights once."""
    rng = np.random.default_rng(8)
    part = pd.DataFrame({"key": np.sort(rng.integers(0, 40, 900)), "attribute": "a", "group": rng.choice(["x", "y"], 900), "cell": rng.integers(0, 25, 900), "a": value, "b": rng.integers(0, 2, 900)})
    w = rng.poisson(1, (part["key"].nunique(), 130))
    read = []
    plain = clusters._summed
    monkeypatch.setattr(clusters, "_summed", lambda weights, row, *rest: read.append(len(row)) or plain(weights, row, *rest))
    m = clusters._Matrix(130)
    m.add(part, w)
    m.add(part, w)
    assert read == [900, part["b"].sum()] * 2  # rows without a positive are not multiplied
    at = np.unique(part["key"], return_inverse=True)[1]
    for (_, g, c), i in m.place.items():
        own = ((part["group"] == g) & (part["cell"] == c)).to_numpy()
        for k, column in enumerate("ab"):
            assert m.sums[i, k] == pytest.approx(2 * (part[column].to_numpy(float)[own] @ w[at[own]]), rel=1e-12)


def test_held_matrices_are_flushed(spark, monkeypatch):
    df = cohort(spark)
    want = sorted(map(tuple, resampling.cluster_auroc(df, ["g"], 60).collect()), key=str)
    monkeypatch.setattr(clusters, "HELD", 1)
    monkeypatch.setattr(clusters, "FILL", 8)
    got = sorted(map(tuple, resampling.cluster_auroc(df, ["g"], 60).collect()), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_any_statistic_of_scores(spark):
    """A statistic of the user's own: the mean score of positives; and its spread is that of clusters, not of rows."""
    df = cohort(spark, n=3000, c=30)
    whole = df.unionAll(df).unionAll(df)  # rows three times over: the spread of clusters stays
    out = []
    for table in (df, whole):
        samples = clusters.score_statistic(table, [], lambda x, n, k: (k @ x) / k.sum(1), 400)
        out.append(samples.agg(F.stddev("value"), F.count("value")).first())
    assert out[0][1] == 400 and out[0][0] == pytest.approx(out[1][0], rel=1e-4)


def test_no_row_is_repeated_by_replicate(spark):
    plan = resampling.cluster_auroc(cohort(spark), ["g"], 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(plan.split()).get("sequence", 0) == 0 and "Generate explode(sequence" not in plan


def test_empty(spark):
    df = cohort(spark).where("false")
    assert resampling.cluster_auroc(df, ["g"], 50).count() == 0 and resampling.cluster_bootstrap(df, ["g"], replicates=50).count() == 0


