import json
import math
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort_audit.config import FairnessConfig, FairnessMetric, MetricDisplayConfig, UseCaseType, normalize_persona
from cohort_audit.errors import ColumnNotFoundError, ConfigurationError, DataValidationError
from cohort_audit.operators import calibration, descriptive, discrimination, disparity, groups, multiplicity, rates, permutation, resampling, thresholds
from cohort_audit.plans import audit, decision
from cohort_audit.reports import render
from cohort_audit.sources import load


@pytest.fixture(scope="module")
def cohort(spark):
    return load.generate_cohort(spark, 1500, seed=7).persist()


def frame(spark, rows, attrs=("g",)):
    return groups.standard(spark.createDataFrame(rows, "y_prob double, y_true int, " + ", ".join(f"{a} string" for a in attrs)), attributes=list(attrs))


def test_rates_by_hand(spark):
    df = frame(spark, [(0.9, 1, "a"), (0.2, 1, "a"), (0.6, 0, "a"), (0.1, 0, "b"), (0.5, 1, "b"), (0.5, 1, None)])
    got = {r["group"]: r for r in rates.group_rates(rates.cells(df, ["g"], 0.5)).collect()}
    assert set(got) == {"a", "b", "_overall"}
    assert (got["a"]["tp"], got["a"]["fn"], got["a"]["fp"], got["a"]["tn"]) == (1, 1, 1, 0)
    assert got["a"]["tpr"] == 0.5 and got["b"]["tpr"] == 1.0 and got["b"]["ppv"] == 1.0 and got["_overall"]["n"] == 6
    with pytest.raises(ValueError):
        rates.group_rates(rates.cells(df, ["g"]), ["nope"])


def test_auroc_is_the_pair_count(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 8, 60) / 8, rng.integers(0, 2, 60)
    df = frame(spark, [(float(a), int(b), "x") for a, b in zip(p, y)])
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    got = {r["group"]: r["auroc"] for r in discrimination.auroc(groups.histogram(df, ["g"])).collect()}
    assert got["x"] == pytest.approx(want) and got["_overall"] == pytest.approx(want)
    one = frame(spark, [(0.5, 1, "x"), (0.6, 1, "x")])
    assert all(r["auroc"] is None for r in discrimination.auroc(groups.histogram(one, ["g"])).collect())


def test_empty_table_gives_empty_groups(spark):
    df = frame(spark, [])
    assert rates.cells(df, ["g"]).where("attribute <> '_overall'").count() == 0
    assert discrimination.auroc(groups.histogram(df, ["g"])).count() == 0


def test_disparities_and_their_edges(spark):
    df = frame(spark, [(0.9, 1, "a")] * 30 + [(0.1, 1, "b")] * 20 + [(0.2, 0, "a")] * 10)
    row = disparity.disparities(rates.cells(df, ["g"]), "tpr").first()
    assert row["reference_group"] == "a" and row["difference"] == -1.0 and row["ratio"] == 0.0 and row["status"] == "fail" and row["p_value"] < 1e-6
    assert {r["status"]: r["n"] for r in disparity.count_by_status(disparity.disparities(rates.cells(df, ["g"]), "tpr")).collect()} == {"pass": 0, "warn": 0, "fail": 1}
    assert disparity.disparities(rates.cells(frame(spark, [(0.9, 1, "a")]), ["g"])).count() == 0


def test_sweep_equals_single_thresholds(spark, cohort):
    df = groups.standard(cohort, attributes=["race"])
    swept = {(r["attribute"], r["group"], round(r["threshold"], 3)): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in thresholds.sweep(df, ["race"], [0.3, 0.7]).collect()}
    for t in (0.3, 0.7):
        for r in rates.cells(df, ["race"], t).collect():
            assert swept[r["attribute"], r["group"], t] == (r["tp"], r["fp"], r["tn"], r["fn"])


def test_recalibration_solves_its_equations(spark, cohort):
    df = groups.standard(cohort)
    r = calibration.logistic_recalibration(df).first()
    pdf = df.toPandas()
    x = np.log(np.clip(pdf.p, 1e-7, 1 - 1e-7) / (1 - np.clip(pdf.p, 1e-7, 1 - 1e-7)))
    assert abs((pdf.y - 1 / (1 + np.exp(-(r["calibration_intercept"] + x)))).sum()) < 1e-4
    b = r["calibration_slope"]
    a = 0.0
    for _ in range(100):
        s = 1 / (1 + np.exp(-(a + b * x)))
        a += (pdf.y - s).sum() / (s * (1 - s)).sum()
    s = 1 / (1 + np.exp(-(a + b * x)))
    assert abs(((pdf.y - s) * x).sum() - b) < 1e-3


def test_bins_close_where_they_say(spark):
    df = frame(spark, [(0.1, 0, "a"), (0.0, 0, "a"), (1.0, 1, "a"), (0.35, 1, "a")])
    of = lambda closed: {r["bin"]: r["n"] for r in calibration.reliability(df, closed=closed).collect()}
    assert of("right") == {0: 2, 3: 1, 9: 1}
    assert of("left") == {0: 1, 1: 1, 3: 1, 9: 1}
    assert of("open") == {0: 1, 1: 1, 3: 1}


def test_multiplicity(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    holm = [r["p_adjusted"] for r in multiplicity.adjust(df, method="holm").orderBy("i").collect()]
    bh = [r["p_adjusted"] for r in multiplicity.adjust(df, method="fdr_bh").orderBy("i").collect()]
    assert holm == pytest.approx([0.03, 0.06, 0.06, 0.02]) and bh == pytest.approx([0.02, 0.04, 0.04, 0.02])
    assert all(h >= b for h, b in zip(holm, bh))
    with pytest.raises(ValueError):
        multiplicity.adjust(df, method="x")


def test_bootstrap_covers_and_repeats(spark, cohort):
    df = groups.standard(cohort, attributes=["sex"])
    a = resampling.percentile_ci(resampling.bootstrap_auroc(df, ["sex"], 100)).orderBy("attribute", "group").collect()
    b = resampling.percentile_ci(resampling.bootstrap_auroc(df.repartition(7), ["sex"], 100)).orderBy("attribute", "group").collect()
    assert a == b
    auc = {(r["attribute"], r["group"]): r["auroc"] for r in discrimination.auroc(groups.histogram(df, ["sex"])).collect()}
    assert all(r["ci_lower"] <= auc[r["attribute"], r["group"]] + 0.01 and r["ci_upper"] >= auc[r["attribute"], r["group"]] - 0.01 for r in a)
    few = resampling.percentile_ci(resampling.bootstrap_auroc(df, ["sex"], 5)).first()
    assert few["ci_lower"] is None


def test_permutation(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), float(rng.random()), 1, "a" if i % 2 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "cluster string, p double, y int, g string")
    assert permutation.permutation_test(df, "g", "tpr", permutations=99).first()["p_value"] > 0.01
    far = df.withColumn("p", F.when(F.col("g") == "a", 0.9).otherwise(0.1))
    assert permutation.permutation_test(far, "g", "tpr", permutations=99).first()["p_value"] == pytest.approx(0.01)


def test_permutations_keep_label_counts(spark):
    """p and null quantiles against permuted labels in numpy, within a confounder's strata."""
    rng = np.random.default_rng(4)
    rows = [(str(i // 3), float(rng.random()), 1, "a" if (i // 3) % 3 else "b", "s" if (i // 3) % 2 else "t") for i in range(240)]
    df = spark.createDataFrame(rows, "cluster string, p double, y int, g string, site string")
    got = permutation.permutation_test(df, "g", "tpr", confounders=["site"], permutations=2000).first()
    unit = pd.DataFrame(rows, columns=["c", "p", "y", "g", "site"]).assign(a=lambda d: d.p >= 0.5).groupby("c").agg(a=("a", "sum"), b=("y", "sum"), g=("g", "first"), site=("site", "first")).reset_index()

    def spread(labels):
        t = unit.assign(g=labels).groupby("g")[["a", "b"]].sum()
        return np.ptp(t.a / t.b)

    null = []
    for _ in range(2000):
        labels = unit.g.to_numpy().copy()
        for s in ("s", "t"):
            at = np.flatnonzero(unit.site == s)
            labels[at] = rng.permutation(labels[at])
        null.append(spread(labels))
    assert got["observed"] == pytest.approx(spread(unit.g.to_numpy())) and got["n_permutations"] == 2000
    assert got["p_value"] == pytest.approx(np.mean(np.array(null) >= got["observed"] - 1e-12), abs=0.05)
    assert (got["null_lower"], got["null_upper"]) == pytest.approx(tuple(np.quantile(null, [0.025, 0.975])), abs=0.02)


def test_cluster_bootstrap_has_the_spread_of_resampled_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [(str(i // 4), float(rng.beta(2, 2)), 1, "a") for i in range(400)]
    df = spark.createDataFrame(rows, "cluster string, p double, y int, g string")
    got = {r["attribute"]: r for r in resampling.percentile_ci(resampling.cluster_bootstrap(df, ["g"], replicates=800)).collect()}
    hit = (np.array([r[1] for r in rows]) >= 0.5).reshape(-1, 4)
    null = [hit[rng.integers(0, 100, 100)].mean() for _ in range(4000)]
    for r in got.values():
        assert r["n_samples"] == 800 and r["mean"] == pytest.approx(hit.mean(), abs=0.01) and r["se"] == pytest.approx(np.std(null), rel=0.15)


def test_validation(spark):
    good = pd.DataFrame({"p": [0.1, 0.9], "y": [0, 1]})
    assert load.validate(load.load(spark, good), "p", "y") == 2
    for bad in ({"p": [0.1, 1.2], "y": [0, 1]}, {"p": [0.1, math.nan], "y": [0, 1]}, {"p": [0.1, 0.2], "y": [0, 2]}):
        with pytest.raises(DataValidationError):
            load.validate(load.load(spark, pd.DataFrame(bad)), "p", "y")
    with pytest.raises(ColumnNotFoundError):
        load.validate(load.load(spark, good), "p", "z")
    with pytest.raises(TypeError):
        load.load(spark, 3)
    with pytest.raises(DataValidationError):
        load.load(spark, "x.xlsx")


def test_configuration():
    c = FairnessConfig("m")
    assert c.has_errors() and len(c.validate()) == 5 and c.get_threshold("min_auroc") == 0.65
    assert not MetricDisplayConfig.governance().should_show("f1_score") and MetricDisplayConfig.governance().should_show("auroc")
    assert normalize_persona("executive").value == "governance"
    with pytest.raises(ValueError):
        normalize_persona("nobody")
    assert decision.metric_options(UseCaseType.SCREENING)["recommended"] is FairnessMetric.EQUAL_OPPORTUNITY
    assert decision.compare_metrics("calibration", "equalized_odds")["documented"]


def test_audit_end_to_end(spark, cohort, tmp_path):
    config = FairnessConfig("<b>risk</b>", primary_fairness_metric=FairnessMetric.EQUALIZED_ODDS, fairness_justification="test")
    a = audit.Audit(spark, cohort, "y_prob", "y_true", config)
    assert {s["suggested_name"] for s in a.suggestions} >= {"race", "sex", "insurance"}
    with pytest.raises(ConfigurationError):
        a.run()
    a.accept_suggested_attributes(["race", "sex"]).add_intersection(["race", "sex"])
    with pytest.raises(ValueError):
        a.add_intersection(["nope"])
    results = a.run(n_bootstrap=50)
    assert results.governance_recommendation["total_checks"] == 6 and "status" in results.summary()
    assert len(audit.checklist(results)) == 9 and results.audit_summary()["n_groups"] == 7
    doc = json.loads(open(render.to_json(results, str(tmp_path / "a.json"))).read())
    assert doc["governance_recommendation"]["status"] == results.governance_recommendation["status"]
    page = open(render.to_html(results, str(tmp_path / "a.html"), "governance")).read()
    assert "<b>risk</b>" not in page and "&lt;b&gt;" in page
    assert ET.parse(render.to_model_card_xml(results, str(tmp_path / "a.xml"))).getroot().tag == "modelCard"
    assert open(render.to_model_card(results, str(tmp_path / "a.md"))).read().startswith("# Model card")
    assert len(render.checkpoint(results)) == 9


def test_two_tables(spark, cohort):
    table, gaps = audit.two_tables(groups.standard(cohort, attributes=["race", "sex"]), ["race", "sex"])
    assert table.count() == 5 + 2 + 1 and gaps.count() == 4 * (4 + 1)
    assert {r["status"] for r in gaps.collect()} <= {"PASS", "WARN", "FAIL"}


def test_ace_bootstrap(spark, cohort):
    df = groups.standard(cohort, attributes=["sex"], cluster="patient_id")
    for clusters in (False, True):
        ci = {(r["attribute"], r["group"]): r for r in resampling.percentile_ci(resampling.bootstrap_ace(df, ["sex"], 40, clusters=clusters)).collect()}
        one = calibration.ace(df, ["sex"]).where("attribute = '_overall'").first()["ace"]
        assert abs(ci["_overall", "_overall"]["mean"] - one) < 0.05 and ci["_overall", "_overall"]["ci_lower"] <= ci["_overall", "_overall"]["ci_upper"]


def test_permutation_on_sequences(spark):
    got = permutation.permutation_test_arrays(spark, [0, 1] * 40, [1] * 40 + [0] * 40, ["a"] * 40 + ["b"] * 40, permutations=50).first()
    assert got["observed"] == 1.0 and got["p_value"] < 0.05


def test_four_pack(spark, cohort):
    pack = audit.four_pack(groups.standard(cohort, attributes=["race"]), ["race"])
    assert pack["measures"].where("attribute = '_overall'").count() == 1
    assert isinstance(audit.findings(pack), list)


def test_monitor_on_a_stream(spark, cohort, tmp_path):
    from cohort_audit.streaming import monitor

    rows = cohort.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("patient_id") * 10)).select("at", "y_prob", "y_true", "sex")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = monitor.windowed_rates(stream, "at", ["sex"]).writeStream.format("memory").queryName("monitor").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = monitor.windowed_rates(rows, "at", ["sex"])
    assert spark.table("monitor").count() == want.count() > 0
    assert spark.table("monitor").agg(F.sum("n")).first()[0] == 2 * rows.count()


def test_quantiles_of_any_numbers(spark):
    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.normal(0, 50, 301), 1), "b": rng.lognormal(8, 3, 200), "c": np.array([7.0]), "d": np.repeat([1.0, 2.0], [1, 900])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs] + [("e", None)], "g string, x double")
    got = {r["group"]: r for r in descriptive.continuous_summary(df, "x", ["g"]).collect()}
    for g, xs in values.items():
        assert [got[g][c] for c in ("q1", "median", "q3")] == pytest.approx(list(np.quantile(xs, [0.25, 0.5, 0.75])))
    assert got["e"]["n_missing"] == 1 and got["e"]["median"] is None
    assert got["_overall"]["median"] == pytest.approx(np.median(np.concatenate(list(values.values()))))


def crowded(spark, n=20_000):
    """A rare outcome with almost all scores below 0.005, one score that a third of the rows share, and a few near 1."""
    rng = np.random.default_rng(5)
    p = np.where(rng.random(n) < 0.33, 0.0004, rng.beta(0.7, 900, n))
    p[:20] = 1 - rng.random(20) * 1e-9
    y = rng.random(n) < np.minimum(6 * p + 0.001, 1)
    return p, y, spark.createDataFrame([(str(i // 4), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "cluster string, p double, y int")


def test_bins_follow_the_scores(spark):
    p, y, df = crowded(spark)
    hist = groups.histogram(df, [])
    exact = discrimination.auroc(hist).first()["auroc"]
    order = np.argsort(p, kind="stable")
    _, at, m = np.unique(p[order], return_index=True, return_counts=True)
    rank = np.repeat(at + (m + 1) / 2, m)
    assert exact == pytest.approx((rank[y[order]].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()))
    for most in (50, 500):
        few = groups.binned(hist, most)
        rows = few.collect()
        assert len(rows) <= 2 * most and sum(r["n"] for r in rows) == len(p) and sum(r["k"] for r in rows) == y.sum()
        assert abs(discrimination.auroc(few).first()["auroc"] - exact) <= 2 / most
    assert sorted(groups.binned(hist, len(p)).collect()) == sorted(hist.collect())
    each = {r["p"]: r["step"] for r in groups.binned(hist, 50, each=True).collect()}
    assert len(each) == hist.count() and sorted(set(each.values())) == pytest.approx(sorted(r["p"] for r in groups.binned(hist, 50).collect()))
    ci = resampling.percentile_ci(resampling.bootstrap_auroc(df, [], 200)).first()
    assert ci["ci_lower"] <= exact <= ci["ci_upper"] and abs(ci["mean"] - exact) < 0.01
    assert hist.select(groups.score_range(F.col("p"))).distinct().count() > 1000


def test_adaptive_error_of_crowded_scores(spark):
    p, y, df = crowded(spark)
    edges = np.unique(np.quantile(p, np.arange(11) / 10))
    at = np.searchsorted(edges[1:-1], p, "right")
    want = sum(abs(y[at == b].sum() - p[at == b].sum()) for b in range(at.max() + 1) if (at == b).sum() >= 5) / len(p)
    assert calibration.ace(df).first()["ace"] == pytest.approx(want)
    for clusters in (False, True):
        ci = resampling.percentile_ci(resampling.bootstrap_ace(df, [], 40, clusters=clusters)).first()
        assert abs(ci["mean"] - want) < 5 * ci["se"] + 1e-4


def test_average_precision_samples_and_comparison_intervals(spark):
    """The weighted average precision against its steps; comparison intervals hold the difference."""
    rng = np.random.default_rng(3)
    n0, n1 = rng.integers(0, 4, (3, 12)).astype(float), rng.integers(0, 4, (3, 12)).astype(float)
    for row in range(3):
        hits = flagged = total = 0.0
        for k in range(11, -1, -1):
            hits, flagged = hits + n1[row, k], flagged + n0[row, k] + n1[row, k]
            total += n1[row, k] * (hits / flagged if flagged else 0)
        assert resampling.weighted_precision(n0, n1)[row] == pytest.approx(total / n1[row].sum())
    rows = [(float(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)), y, g) for g in "ab" for y in (0, 1) for _ in range(100)]
    df = spark.createDataFrame(rows, "p double, y int, g string")
    samples = resampling.discrimination_samples(df, ["g"], 200)
    r = discrimination.auroc_comparison_ci(discrimination.auroc_comparison(discrimination.auroc(groups.histogram(df, ["g"]))), samples).first()
    assert r["ci_lower"] < r["auroc"] < r["ci_upper"] and r["ref_ci_lower"] < r["ref_auroc"] < r["ref_ci_upper"]
    assert r["diff_ci_lower"] < r["auroc_diff"] < r["diff_ci_upper"]
    assert {x["group"]: x["n_samples"] for x in resampling.percentile_ci(samples).collect()} == {"a": 200, "b": 200, "_overall": 200}


def test_released_results_keep_their_sections(spark):
    rows = [(i / 100, int(i % 3 == 0), "ab"[i % 2]) for i in range(100)]
    config = FairnessConfig("m", primary_fairness_metric=FairnessMetric.EQUALIZED_ODDS, fairness_justification="a test")
    a = audit.Audit(spark, spark.createDataFrame(rows, "y_prob double, y_true int, sex string"), "y_prob", "y_true", config)
    a.add_sensitive_attribute("sex", "sex")
    with a.run(bootstrap_ci=False) as results:
        before = results.frames["rates"].count()
        assert results.held and all(df.is_cached for df in results.held)
        held = list(results.held)
    assert not results.held and not any(df.is_cached for df in held) and results.frames["rates"].count() == before
