"""Permutation tests against the enumeration of all permutations of small tables."""

import itertools
import math

import numpy as np
import pytest

from cohort_audit.operators import clusters, permutation

ROWS = "p double, y int, g string"


def auroc(p, y):
    pos, neg = [a for a, b in zip(p, y, strict=True) if b], [a for a, b in zip(p, y, strict=True) if not b]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else math.nan


def gap(units, labels, metric):
    """The range of a metric; a unit is a list of (p, y)."""
    values = []
    for g in set(labels):
        rows = [r for u, lab in zip(units, labels, strict=True) if lab == g for r in u]
        if metric == "auroc":
            values.append(auroc(*zip(*rows, strict=True)))
        else:
            own = [p >= 0.5 for p, y in rows if metric != "tpr" or y == 1]
            values.append(sum(own) / len(own) if own else math.nan)
    values = [v for v in values if not math.isnan(v)]
    return max(values) - min(values) if values else math.nan


def enumerated(units, labels, metric):
    """Observed range, share of all orders of the labels that reach it, and how many ranges there are."""
    seen = gap(units, labels, metric)
    all_ = [gap(units, order, metric) for order in itertools.permutations(labels)]
    return seen, np.mean([v >= seen - 1e-12 for v in all_ if not math.isnan(v)]), np.mean([v for v in all_ if not math.isnan(v)])


SMALL = [(0.9, 1, "x"), (0.2, 0, "x"), (0.7, 1, "x"), (0.4, 0, "y"), (0.3, 1, "y"), (0.6, 0, "y"), (0.1, 1, "y"), (0.8, 0, "x")]


@pytest.mark.parametrize("metric", ["auroc", "selection_rate", "tpr"])
def test_rows_against_enumeration(spark, metric):
    rows = [r for r in SMALL if metric != "tpr" or r[1] == 1]
    seen, share, _ = enumerated([[r[:2]] for r in rows], [r[2] for r in rows], metric)
    got = permutation.permutation_test(spark.createDataFrame(SMALL, ROWS), "g", metric, permutations=4000).first()
    assert got["observed"] == pytest.approx(seen) and abs(got["p_value"] - share) < 0.03


CLUSTERED = [("a", 0.9, 1, "x"), ("a", 0.2, 0, "x"), ("b", 0.7, 1, "x"), ("c", 0.4, 0, "y"), ("c", 0.3, 1, "y"), ("d", 0.6, 0, "y"), ("e", 0.1, 1, "y"), ("e", 0.8, 0, "x"), ("f", 0.55, 1, "x"), ("f", 0.05, 0, "x")]


@pytest.mark.parametrize("metric", ["auroc", "selection_rate"])
@pytest.mark.parametrize("fill", [2, 256])
def test_pairs_of_cluster_and_label_are_units(spark, monkeypatch, metric, fill):
    """Cluster e has two labels, so it is two units."""
    monkeypatch.setattr(clusters, "FILL", fill)
    units = {}
    for c, p, y, g in CLUSTERED:
        units.setdefault((c, g), []).append((p, y))
    seen, share, _ = enumerated(list(units.values()), [g for _, g in units], metric)
    got = permutation.permutation_test(spark.createDataFrame(CLUSTERED, "cluster string, " + ROWS), "g", metric, permutations=4000).first()
    assert got["observed"] == pytest.approx(seen) and abs(got["p_value"] - share) < 0.03


@pytest.mark.parametrize("metric", ["auroc", "selection_rate"])
def test_confounders_keep_labels_in_their_stratum(spark, metric):
    """Each stratum has one label: nothing can be permuted, so every permutation equals the table."""
    rows = [(*r[1:], r[0], "s1" if r[3] == "x" else "s2") for r in CLUSTERED]
    for columns in (ROWS + ", cluster string, site string",):
        df = spark.createDataFrame(rows, columns)
        for table in (df, df.drop("cluster")):
            got = permutation.permutation_test(table, "g", metric, confounders=["site"], permutations=60).first()
            assert got["p_value"] == 1 and got["null_lower"] == pytest.approx(got["observed"])


def test_deals_keep_the_labels_and_are_uniform():
    labels, sizes = np.array([3, 5, 4]), np.array([2, 0, 7, 3])
    d = permutation.Deals(sizes, labels, 30_000, [1])
    whole = np.concatenate([d.of_units(b) for b in range(4)])
    assert all((np.bincount(col, minlength=3) == labels).all() for col in whole[:, :500].T)
    for i, n in enumerate(labels):
        assert np.abs((whole == i).mean(1) - n / 12).max() < 0.02
    both = ((whole[0] == 0) & (whole[-1] == 0)).mean()
    assert both == pytest.approx(3 / 12 * 2 / 11, abs=0.01)


def test_empty_stratum_is_nan(spark):
    rows = [r for r in SMALL if r[1] == 0]
    got = permutation.permutation_test(spark.createDataFrame(rows, ROWS), "g", "tpr", permutations=60).first()
    assert math.isnan(got["observed"]) and math.isnan(got["p_value"]) and math.isnan(got["null_lower"]) and got["n_permutations"] == 0
    none = permutation.permutation_test(spark.createDataFrame([], ROWS), "g", "auroc", permutations=60).first()
    assert math.isnan(none["p_value"])


def test_null_labels_are_left_out(spark):
    rows = [*SMALL, (0.9, 1, None), (0.1, 0, None)]
    got, want = (permutation.permutation_test(spark.createDataFrame(r, ROWS), "g", "selection_rate", permutations=200).first() for r in (rows, SMALL))
    assert got == want


def test_a_clear_gap_is_found(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y, g = int(rng.random() < 0.5), "x" if i % 2 else "y"
        rows.append((float(np.clip(rng.normal(0.5 + (0.3 * y if g == "x" else 0), 0.15), 0, 1)), y, g, f"c{i // 4}"))
    df = spark.createDataFrame(rows, ROWS + ", cluster string")
    for table in (df, df.drop("cluster")):
        assert permutation.permutation_test(table, "g", "auroc", permutations=199).first()["p_value"] < 0.02
