"""Registered queries of the audit operators over the scored view of the star schema, and the SQL that restates them.

Doubles are rounded to six places on both sides, since sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .functions import intervals
from .operators import calibration, descriptive, discrimination, disparity, groups, intersect, metrics, multiplicity, permutation, rates, resampling, thresholds
from .plans import audit
from .sources import load, profile
from .streaming import ordered

ATTRIBUTES = ["c_mktsegment", "r_name", "o_orderpriority"]
T = 0.5
Z = C.Z

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def digits(name: str) -> int:
    """Thresholds and scores have eight places, which six would cut at a tie."""
    return 8 if name in ("threshold", "p") else 6


def rounded(df: DataFrame) -> DataFrame:
    """``df`` with its doubles rounded as the SQL does, which rounds the scaled double; the decimal form would round ties such as 41/640 otherwise."""

    def to(c: str) -> Column:
        scale = F.lit(10.0 ** digits(c))
        return F.round(F.col(f"`{c}`") * scale, 0) / scale + F.lit(0.0)

    return df.select(*(to(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(groups.standard(load.scored(spark, sf_dir), attributes=ATTRIBUTES, cluster="cluster_id")))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- pieces of the SQL -----------------------------------------------------------------------------------------------


def r(x: str, name: str) -> str:
    return f"ROUND({x}, {digits(name)}) + 0.0 AS {name}"


S = f"s AS (SELECT *, y_prob AS p, y_true AS y FROM ({load.SCORED_SQL}) q)"
LONG = "l AS (" + " UNION ALL ".join([f"SELECT '{a}' AS attribute, {a} AS \"group\", p, y, cluster_id FROM s" for a in ATTRIBUTES] + ["SELECT '_overall', '_overall', p, y, cluster_id FROM s"]) + ")"


def cells_sql(source: str = "l", keys: str = 'attribute, "group"', t: str = str(T)) -> str:
    return f"""(SELECT {keys}, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_positive, CAST(COUNT(*) - SUM(y) AS BIGINT) AS n_negative,
      COUNT(*) FILTER (WHERE y = 1 AND p >= {t}) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p >= {t}) AS fp,
      COUNT(*) FILTER (WHERE y = 0 AND p < {t}) AS tn, COUNT(*) FILTER (WHERE y = 1 AND p < {t}) AS fn,
      COUNT(*) FILTER (WHERE p >= {t}) AS n_flagged, COUNT(*) FILTER (WHERE p < {t}) AS n_unflagged,
      COUNT(*) FILTER (WHERE (p >= {t}) = (y = 1)) AS n_right, SUM(p) AS sum_p, SUM((p - y) * (p - y)) AS sum_sq
      FROM {source} GROUP BY {keys})"""


CELLS = f"WITH {S}, {LONG}, c AS {cells_sql()}"


def q(a: str, b: str, default: str = "0.0") -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE {default} END"


#: Numerator and denominator of each rate, written out here so that the SQL does not follow the library's own table.
PARTS = {
    "tpr": ("tp", "(tp + fn)"),
    "fpr": ("fp", "(fp + tn)"),
    "tnr": ("tn", "(fp + tn)"),
    "fnr": ("fn", "(tp + fn)"),
    "ppv": ("tp", "(tp + fp)"),
    "npv": ("tn", "(tn + fn)"),
    "selection_rate": ("(tp + fp)", "(tp + fp + tn + fn)"),
    "accuracy": ("(tp + tn)", "(tp + fp + tn + fn)"),
}
RATE = {m: q(*x) for m, x in PARTS.items()}


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    z2 = Z * Z
    c, d = f"(CAST({s} AS DOUBLE)/{n} + {z2 / 2!r}/{n})", f"(1 + {z2!r}/{n})"
    p = f"(CAST({s} AS DOUBLE)/{n})"
    m = f"({Z!r}/{d} * SQRT(({p}*(1-{p}) + {z2 / 4!r}/{n})/{n}))"
    lo = f"CASE WHEN {n} <= 0 THEN NULL WHEN {s} = 0 THEN 0.0 WHEN {s} = {n} THEN CAST({n} AS DOUBLE)/({n} + {z2!r}) ELSE GREATEST(0.0, {c}/{d} - {m}) END"
    hi = f"CASE WHEN {n} <= 0 THEN NULL WHEN {s} = 0 THEN {z2!r}/({n} + {z2!r}) WHEN {s} = {n} THEN 1.0 ELSE LEAST(1.0, {c}/{d} + {m}) END"
    return lo, hi


def ref_sql(source: str, order: str = "n DESC") -> str:
    """The reference row of each attribute."""
    return f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY {order}, \"group\") AS rn FROM {source} WHERE attribute <> '_overall') x WHERE rn = 1)"


_HIST = f"WITH {S}, {LONG}, h AS (SELECT attribute, \"group\", p, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS k FROM l GROUP BY attribute, \"group\", p)"
_AUC = f"{_HIST}, w AS (SELECT *, SUM(n - k) OVER (PARTITION BY attribute, \"group\" ORDER BY p) - (n - k) AS neg FROM h), u AS (SELECT attribute, \"group\", CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS n_positive, SUM(CAST(k AS DOUBLE) * (neg + (n - k)/2.0)) AS pairs FROM w GROUP BY attribute, \"group\"), auc AS (SELECT attribute, \"group\", n, n_positive, CASE WHEN n_positive > 0 AND n > n_positive THEN pairs/(CAST(n_positive AS DOUBLE)*(n - n_positive)) END AS auroc FROM u)"


# ---- rates and disparities -------------------------------------------------------------------------------------------


@query(f"{CELLS} SELECT attribute, \"group\", n, n_positive, tp, fp, tn, fn, {', '.join(r(x, m) for m, x in RATE.items())}, {r(q('n_positive', 'n'), 'prevalence')} FROM c")
def group_rates(df):
    return rates.group_rates(rates.cells(df, ATTRIBUTES, T)).select("attribute", "group", "n", "n_positive", "tp", "fp", "tn", "fn", *rates.RATES, "prevalence")


@query(f"WITH {S}, c AS {cells_sql('s', '1')} SELECT n, n_positive, tp, fp, tn, fn, {r(RATE['accuracy'], 'accuracy')} FROM c".replace("SELECT 1,", "SELECT ").replace("GROUP BY 1)", ")"))
def confusion_matrix(df):
    return rates.group_rates(rates.cells(df, [], T)).select("n", "n_positive", "tp", "fp", "tn", "fn", "accuracy")


_ci = {m: tuple(f"COALESCE({x}, {e})" for x, e in zip(wilson_sql(*PARTS[m]), ("0.0", "1.0"), strict=True)) for m in ("tpr", "fpr", "ppv")}


@query(f"{CELLS} SELECT attribute, \"group\", n, " + ", ".join(f"{r(RATE[m], m)}, {r(lo, m + '_ci_lower')}, {r(hi, m + '_ci_upper')}" for m, (lo, hi) in _ci.items()) + " FROM c")
def group_rates_ci(df):
    m = ["tpr", "fpr", "ppv"]
    return rates.wilson_intervals(rates.group_rates(rates.cells(df, ATTRIBUTES, T), m), m).select("attribute", "group", "n", *(x for a in m for x in (a, f"{a}_ci_lower", f"{a}_ci_upper")))


def disparity_sql(metric: str, order: str = "n DESC") -> str:
    s, t = PARTS[metric]
    (l1, u1), (l2, u2) = wilson_sql("a.s", "a.t"), wilson_sql("b.s", "b.t")
    z = "CASE WHEN a.t > 0 AND b.t > 0 AND SQRT(CAST(a.s + b.s AS DOUBLE)/(a.t + b.t) * (1 - CAST(a.s + b.s AS DOUBLE)/(a.t + b.t)) * (1.0/a.t + 1.0/b.t)) > 0 THEN (a.value - b.value) / SQRT(CAST(a.s + b.s AS DOUBLE)/(a.t + b.t) * (1 - CAST(a.s + b.s AS DOUBLE)/(a.t + b.t)) * (1.0/a.t + 1.0/b.t)) ELSE 0.0 END"
    lo = f"CASE WHEN a.t <= 0 OR b.t <= 0 THEN -1.0 ELSE GREATEST(-1.0, a.value - b.value - SQRT(POW(a.value - {l1}, 2) + POW({u2} - b.value, 2))) END"
    hi = f"CASE WHEN a.t <= 0 OR b.t <= 0 THEN 1.0 ELSE LEAST(1.0, a.value - b.value + SQRT(POW({u1} - a.value, 2) + POW(b.value - {l2}, 2))) END"
    return f"""{CELLS}, m AS (SELECT attribute, "group", n, {s} AS s, {t} AS t, {RATE[metric]} AS value FROM c WHERE attribute <> '_overall'), b AS {ref_sql('m', order)}
      SELECT a.attribute, '{metric}' AS metric, b."group" AS reference_group, a."group" AS comparison_group, {r('b.value', 'reference_value')}, {r('a.value', 'comparison_value')},
      {r('a.value - b.value', 'difference')}, {r(lo, 'ci_lower')}, {r(hi, 'ci_upper')}, {r("CASE WHEN b.value > 0 THEN a.value / b.value WHEN a.value > 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0 END", 'ratio')}, {r(z, 'z')},
      CASE WHEN ABS(a.value - b.value) >= 0.1 THEN 'fail' WHEN ABS(a.value - b.value) >= 0.05 THEN 'warn' ELSE 'pass' END AS status
      FROM m a JOIN b ON a.attribute = b.attribute AND a."group" <> b."group" """


@query(disparity_sql("tpr"))
def disparities_tpr(df):
    return disparity.disparities(rates.cells(df, ATTRIBUTES, T), "tpr", p_values=False)


@query(disparity_sql("ppv", "value DESC"))
def disparities_best_ref(df):
    return disparity.disparities(rates.cells(df, ATTRIBUTES, T), "ppv", strategy="best", p_values=False)


@query(f"SELECT attribute, comparison_group, difference, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY ABS(difference) DESC, comparison_group) AS k FROM ({disparity_sql('fpr')}) d) e WHERE k = 1")
def worst_disparity(df):
    return disparity.worst_disparity(rounded(disparity.disparities(rates.cells(df, ATTRIBUTES, T), "fpr", p_values=False))).select("attribute", "comparison_group", "difference", "status")


@query(f"SELECT v.status, COUNT(d.status) AS n FROM (VALUES ('pass'), ('warn'), ('fail')) v(status) LEFT JOIN ({disparity_sql('tpr')}) d ON v.status = d.status GROUP BY v.status")
def disparity_status_counts(df):
    return disparity.count_by_status(disparity.disparities(rates.cells(df, ATTRIBUTES, T), "tpr", p_values=False))


_c = {x: f"CASE WHEN {x}.n_flagged IN (0, {x}.n) THEN {x}.n_flagged + 0.5 ELSE CAST({x}.n_flagged AS DOUBLE) END" for x in "ab"}
_d = {x: f"CASE WHEN {x}.n_flagged IN (0, {x}.n) THEN {x}.n + 1.0 ELSE CAST({x}.n AS DOUBLE) END" for x in "ab"}
_IMPACT = f"""{CELLS}, b AS {ref_sql('c')}, k AS (SELECT a.attribute, a."group", b."group" AS ref_group, a.n_flagged AS s1, a.n AS n1, b.n_flagged AS s2, b.n AS n2,
  {_c['a']} AS x1, {_d['a']} AS m1, {_c['b']} AS x2, {_d['b']} AS m2 FROM c a JOIN b ON a.attribute = b.attribute AND a."group" <> b."group"),
  i AS (SELECT *, EXP(LN((x1/m1)/(x2/m2)) - {Z!r} * SQRT((1-x1/m1)/x1 + (1-x2/m2)/x2)) AS lo, EXP(LN((x1/m1)/(x2/m2)) + {Z!r} * SQRT((1-x1/m1)/x1 + (1-x2/m2)/x2)) AS hi FROM k)
  SELECT attribute, "group", ref_group, {r('CASE WHEN s2 > 0 THEN (CAST(s1 AS DOUBLE)/n1)/(CAST(s2 AS DOUBLE)/n2) END', 'ratio')}, {r('lo', 'ci_lower')}, {r('hi', 'ci_upper')},
  CASE WHEN hi < 0.8 THEN 'violation_supported' WHEN lo >= 0.8 THEN 'compliant' ELSE 'inconclusive' END AS decision FROM i"""


@query(_IMPACT)
def disparate_impact_katz(df):
    return disparity.disparate_impact(rates.cells(df, ATTRIBUTES, T))


def fairness_sql(source: str = "c", extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    on = "".join(f" AND a.{x.strip()} = b.{x.strip()}" for x in extra.split(",") if x)
    ea = "".join(f"a.{x.strip()}, " for x in extra.split(",") if x)
    return f"""f AS (SELECT {e}attribute, "group", n, {RATE['tpr']} AS tpr, {RATE['fpr']} AS fpr, {RATE['ppv']} AS ppv, {RATE['selection_rate']} AS sr, {q('sum_p', 'n')} - {q('n_positive', 'n')} AS ce FROM {source} WHERE attribute <> '_overall' AND n >= 10),
      fb AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {e}attribute ORDER BY n DESC, "group") AS rn FROM f) x WHERE rn = 1),
      fd AS (SELECT {ea}a.attribute, a."group", b."group" AS ref_group, CASE WHEN b.sr > 0 THEN a.sr / b.sr END AS demographic_parity_ratio, a.sr - b.sr AS demographic_parity_diff, a.tpr - b.tpr AS tpr_diff, a.fpr - b.fpr AS fpr_diff,
        GREATEST(ABS(a.tpr - b.tpr), ABS(a.fpr - b.fpr)) AS equalized_odds_diff, CASE WHEN b.ppv > 0 THEN a.ppv / b.ppv END AS ppv_ratio, a.ppv - b.ppv AS ppv_diff, a.ce - b.ce AS calibration_diff FROM f a JOIN fb b ON a.attribute = b.attribute{on} AND a."group" <> b."group")"""


_FAIR = ["demographic_parity_ratio", "demographic_parity_diff", "tpr_diff", "fpr_diff", "equalized_odds_diff", "ppv_ratio", "ppv_diff", "calibration_diff"]


@query(f"{CELLS}, {fairness_sql()} SELECT attribute, \"group\", ref_group, {', '.join(r(c, c) for c in _FAIR)} FROM fd")
def fairness_metrics(df):
    return disparity.fairness(rates.cells(df, ATTRIBUTES, T))


def summary_sql(extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    worst = ", ".join(f"ARG_MAX({c}, ABS({c})) AS worst_{k}" for k, c in disparity.WORST.items())
    return f"fs AS (SELECT {e}attribute, {worst}, MAX(equalized_odds_diff) AS worst_equalized_odds, CASE WHEN MIN(ppv_ratio) < 1 THEN MIN(ppv_ratio) ELSE MAX(ppv_ratio) END AS worst_ppv_ratio FROM fd GROUP BY {e}attribute)"


_WORST = [f"worst_{k}" for k in disparity.WORST] + ["worst_equalized_odds", "worst_ppv_ratio"]
_WITHIN = [f"ABS(worst_{k}) <= {0.05 if k == 'calibration' else 0.1} AS {k}_within" for k in [*disparity.WORST, "equalized_odds"]]


@query(f"{CELLS}, {fairness_sql()}, {summary_sql()} SELECT attribute, {', '.join(r(c, c) for c in _WORST)}, {', '.join(_WITHIN)} FROM fs")
def fairness_summary(df):
    return disparity.fairness_summary(disparity.fairness(rates.cells(df, ATTRIBUTES, T)))


_PARTS = {"demographic_parity": "LEAST(1.0, ABS(worst_demographic_parity)/0.2)", "equal_opportunity": "LEAST(1.0, ABS(worst_equal_opportunity)/0.2)", "equalized_odds": "LEAST(1.0, ABS(worst_equalized_odds)/0.2)", "predictive_parity": "LEAST(1.0, ABS(worst_ppv_ratio - 1)/0.4)"}
_INDEX = "(" + " + ".join(f"COALESCE({w} * {_PARTS[k]}, 0.0)" for k, w in C.INDEX_WEIGHTS.items()) + ") / (" + " + ".join(f"CASE WHEN {_PARTS[k]} IS NULL THEN 0.0 ELSE {w} END" for k, w in C.INDEX_WEIGHTS.items()) + ")"


@query(f"{CELLS}, {fairness_sql()}, {summary_sql()}, i AS (SELECT *, {_INDEX} AS di FROM fs) SELECT attribute, {', '.join(r(x, k + '_component') for k, x in _PARTS.items())}, {r('di', 'disparity_index')}, CASE WHEN di < 0.25 THEN 'LOW' WHEN di < 0.5 THEN 'MODERATE' WHEN di < 0.75 THEN 'HIGH' ELSE 'SEVERE' END AS level FROM i")
def disparity_index(df):
    return disparity.disparity_index(disparity.fairness_summary(disparity.fairness(rates.cells(df, ATTRIBUTES, T))))


@query(f"{_AUC}, c AS {cells_sql()}, v AS (SELECT c.attribute, c.\"group\", c.n, {RATE['tpr'].replace('n_positive', 'c.n_positive')} AS tpr, {RATE['fpr']} AS fpr, {RATE['ppv']} AS ppv, {q('n_flagged', 'c.n')} AS sr, auc.auroc FROM c JOIN auc ON c.attribute = auc.attribute AND c.\"group\" = auc.\"group\" WHERE c.attribute <> '_overall' AND c.n >= 10), b AS {ref_sql('v')} SELECT a.attribute, a.\"group\", b.\"group\" AS ref_group, {r('a.tpr - b.tpr', 'tpr_diff')}, {r('a.fpr - b.fpr', 'fpr_diff')}, {r('a.sr - b.sr', 'selection_rate_diff')}, {r('a.auroc - b.auroc', 'auroc_diff')}, {r('GREATEST(ABS(a.tpr - b.tpr), ABS(a.fpr - b.fpr))', 'equalized_odds_diff')}, {r('CASE WHEN b.ppv > 0 THEN a.ppv/b.ppv END', 'ppv_ratio')}, {r('CASE WHEN b.sr > 0 THEN a.sr/b.sr END', 'selection_rate_ratio')} FROM v a JOIN b ON a.attribute = b.attribute AND a.\"group\" <> b.\"group\"")
def subgroup_disparities(df):
    return disparity.subgroup_disparities(rates.cells(df, ATTRIBUTES, T), discrimination.auroc(groups.histogram(df, ATTRIBUTES)))


@query(f"WITH d AS ({disparity_sql('tpr')}) SELECT attribute, reference_group AS a, comparison_group AS b, difference FROM d UNION ALL SELECT attribute, comparison_group, reference_group, 0.0 - difference FROM d")
def disparity_matrix(df):
    return disparity.disparity_matrix(disparity.disparities(rates.cells(df, ATTRIBUTES, T), "tpr", p_values=False)).drop("metric")


# ---- thresholds ------------------------------------------------------------------------------------------------------


def grid_sql(ts, source: str = "l") -> str:
    values = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(sorted(ts), 1))
    return f"g(t_index, threshold) AS (VALUES {values}), lt AS (SELECT l.*, g.t_index, g.threshold FROM {source} l, g), c AS " + cells_sql("lt", 'attribute, "group", t_index, threshold', "threshold")


_SWEEP = f"WITH {S}, {LONG}, {grid_sql(C.SWEEP)}"


@query(f"{_SWEEP}, {fairness_sql('c', 't_index, threshold')}, {summary_sql('t_index, threshold')} SELECT t_index, {r('threshold', 'threshold')}, attribute, {', '.join(r(c, c) for c in _WORST)}, {', '.join(_WITHIN)} FROM fs")
def threshold_fairness(df):
    return thresholds.threshold_fairness(df, ATTRIBUTES)


_SE, _SP, _PPV, _NPV = q("tp", "n_positive"), q("tn", "n_negative"), q("tp", "n_flagged"), q("tn", "n_unflagged")
_ROOT = "SQRT(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))"
_EXP = "(CAST(tp + fn AS DOUBLE)/n * CAST(tp + fp AS DOUBLE)/n + (1 - CAST(tp + fn AS DOUBLE)/n) * CAST(fn + tn AS DOUBLE)/n)"
_CLASS = f"""{r('se', 'sensitivity')}, {r('sp', 'specificity')}, {r('ppv', 'ppv')}, {r('npv', 'npv')}, {r('CASE WHEN 2*tp + fp + fn > 0 THEN 2.0*tp/(2*tp + fp + fn) ELSE 0.0 END', 'f1_score')}, {r('CAST(tp + tn AS DOUBLE)/n', 'accuracy')},
  {r('(se + sp)/2', 'balanced_accuracy')}, {r('se + sp - 1', 'youden_index')}, {r(f'CASE WHEN {_ROOT} > 0 THEN (CAST(tp AS DOUBLE)*tn - CAST(fp AS DOUBLE)*fn)/{_ROOT} ELSE 0.0 END', 'mcc')},
  {r('CASE WHEN se > 0 AND se < 1 AND sp > 0 AND sp < 1 THEN (se/(1-sp))/((1-se)/sp) WHEN se = 1 AND sp = 1 THEN NULL ELSE 0.0 END', 'dor')}, {r(f'CASE WHEN {_EXP} < 1 THEN (CAST(tp + tn AS DOUBLE)/n - {_EXP})/(1 - {_EXP}) ELSE 0.0 END', 'kappa')},
  {r('100.0*(tp + fp)/n', 'pct_flagged')}, {r('CASE WHEN ppv > 0 THEN 1/ppv END', 'nne')}"""
_MEASURES = ["sensitivity", "specificity", "ppv", "npv", "f1_score", "accuracy", "balanced_accuracy", "youden_index", "mcc", "dor", "kappa", "pct_flagged", "nne"]


@query(f"{CELLS}, k AS (SELECT *, {_SE} AS se, {_SP} AS sp, {_PPV} AS ppv, {_NPV} AS npv FROM c) SELECT attribute, \"group\", n, {_CLASS} FROM k")
def classification_at_threshold(df):
    return rates.classification(rates.cells(df, ATTRIBUTES, T)).select("attribute", "group", "n", *_MEASURES)


@query(f"{_SWEEP}, k AS (SELECT *, {_SE} AS se, {_SP} AS sp, {_PPV} AS ppv, {_NPV} AS npv FROM c) SELECT attribute, \"group\", t_index, {r('threshold', 'threshold')}, n, tp, fp, tn, fn, {_CLASS} FROM k")
def threshold_sweep(df):
    return thresholds.sweep(df, ATTRIBUTES).select("attribute", "group", "t_index", "threshold", "n", "tp", "fp", "tn", "fn", *_MEASURES)


_CURVE = f"WITH {S}, {LONG}, {grid_sql(C.curve_thresholds())}, k AS (SELECT attribute, \"group\", t_index, threshold, CAST(tp AS DOUBLE)/n - CAST(fp AS DOUBLE)/n * threshold/(1 - threshold) AS nb, CAST(n_positive AS DOUBLE)/n - (1 - CAST(n_positive AS DOUBLE)/n) * threshold/(1 - threshold) AS na FROM c)"


@query(f"{_CURVE} SELECT attribute, \"group\", t_index, {r('threshold', 'threshold')}, {r('nb', 'net_benefit')}, {r('na', 'net_benefit_all')} FROM k")
def decision_curve(df):
    return thresholds.decision_curve(df, ATTRIBUTES).select("attribute", "group", "t_index", "threshold", "net_benefit", "net_benefit_all")


@query(f"{_CURVE} SELECT attribute, \"group\", {r('MIN(threshold)', 'min_threshold')}, {r('MAX(threshold)', 'max_threshold')} FROM k WHERE nb > GREATEST(na, 0.0) GROUP BY attribute, \"group\"")
def useful_range(df):
    return thresholds.useful_range(thresholds.decision_curve(df, ATTRIBUTES))


@query(f"{_SWEEP}, {fairness_sql('c', 't_index, threshold')}, {summary_sql('t_index, threshold')}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY ROUND(worst_equalized_odds, 6), threshold) AS k FROM fs) SELECT attribute, {r('threshold', 'optimal_threshold')} FROM o WHERE k = 1")
def optimal_threshold(df):
    return thresholds.best_threshold(rounded(thresholds.threshold_fairness(df, ATTRIBUTES)))


@query(f"{CELLS}, k AS (SELECT attribute, \"group\", CAST(tp AS DOUBLE)/n - CAST(fp AS DOUBLE)/n AS nb, CAST(n_positive AS DOUBLE)/n AS prev FROM c) SELECT attribute, \"group\", {r('nb', 'net_benefit')}, {r('prev', 'max_net_benefit')}, {r('CASE WHEN prev > 0 THEN nb/prev END', 'standardized_net_benefit')} FROM k")
def net_benefit_by_group(df):
    return thresholds.net_benefit(rates.cells(df, ATTRIBUTES, T), T).drop("interpretation")


# ---- discrimination --------------------------------------------------------------------------------------------------

@query(f"{_AUC} SELECT n, n_positive, {r('auroc', 'auroc')} FROM auc WHERE attribute = '_overall'")
def auroc_overall(df):
    return discrimination.auroc(groups.histogram(df, [])).select("n", "n_positive", "auroc")


@query(f"{_AUC} SELECT attribute, \"group\", n, n_positive, {r('auroc', 'auroc')} FROM auc")
def auroc_by_group(df):
    return discrimination.auroc(groups.histogram(df, ATTRIBUTES))


@query(f"{_AUC}, ok AS (SELECT * FROM auc WHERE n >= 20 AND auroc IS NOT NULL), b AS {ref_sql('ok')} SELECT a.attribute, a.\"group\", b.\"group\" AS ref_group, {r('a.auroc', 'auroc')}, {r('a.auroc - b.auroc', 'auroc_diff')}, CASE WHEN ABS(a.auroc - b.auroc) < 0.02 THEN 'negligible' WHEN ABS(a.auroc - b.auroc) < 0.05 THEN 'small' WHEN ABS(a.auroc - b.auroc) < 0.1 THEN 'moderate' ELSE 'large' END AS interpretation FROM ok a JOIN b ON a.attribute = b.attribute AND a.\"group\" <> b.\"group\"")
def auroc_comparison(df):
    return discrimination.auroc_comparison(discrimination.auroc(groups.histogram(df, ATTRIBUTES))).select("attribute", "group", "ref_group", "auroc", "auroc_diff", "interpretation")


_DESC = "w AS (SELECT *, SUM(k) OVER o AS tps, SUM(n - k) OVER o AS fps, SUM(k) OVER g AS pos, SUM(n - k) OVER g AS neg, LEAD(k) OVER o AS k2, LEAD(n) OVER o AS n2, SUM(n) OVER o AS flagged FROM h WINDOW o AS (PARTITION BY attribute, \"group\" ORDER BY p DESC), g AS (PARTITION BY attribute, \"group\"))"


@query(f"{_HIST}, {_DESC} SELECT attribute, \"group\", {r('p', 'threshold')}, {r(q('fps', 'neg'), 'fpr')}, {r(q('tps', 'pos'), 'tpr')} FROM w WHERE k2 IS NULL OR k2 <> k OR n2 - k2 <> n - k UNION ALL SELECT DISTINCT attribute, \"group\", CAST('inf' AS DOUBLE), 0.0, 0.0 FROM h")
def roc_points(df):
    return discrimination.roc_points(groups.histogram(df, ATTRIBUTES))


@query(f"{_HIST}, {_DESC} SELECT attribute, \"group\", {r('p', 'threshold')}, {r(q('tps', 'flagged'), 'precision')}, {r(q('tps', 'pos'), 'recall')} FROM w")
def pr_points(df):
    return discrimination.pr_points(groups.histogram(df, ATTRIBUTES)).select("attribute", "group", "threshold", "precision", "recall")


@query(f"{_HIST}, {_DESC}, z AS (SELECT *, CASE WHEN flagged - n > 0 THEN CAST(tps - k AS DOUBLE)/(flagged - n) ELSE 1.0 END AS before FROM w) SELECT attribute, \"group\", {r('SUM(CAST(k AS DOUBLE)/pos * tps/flagged)', 'average_precision')}, {r('SUM(CAST(k AS DOUBLE)/pos * (CAST(tps AS DOUBLE)/flagged + before)/2)', 'auprc')} FROM z GROUP BY attribute, \"group\"")
def precision_summaries(df):
    return discrimination.precision_summaries(groups.histogram(df, ATTRIBUTES))


@query(f"WITH {S}, {LONG} SELECT attribute, \"group\", y, COUNT(*) AS n, {r('AVG(p)', 'mean')}, {r('QUANTILE_CONT(p, 0.5)', 'median')}, {r('STDDEV_POP(p)', 'std')}, {r('MIN(p)', 'min')}, {r('MAX(p)', 'max')}, {r('QUANTILE_CONT(p, 0.25)', 'q25')}, {r('QUANTILE_CONT(p, 0.75)', 'q75')}, {r('QUANTILE_CONT(p, 0.75) - QUANTILE_CONT(p, 0.25)', 'iqr')} FROM l GROUP BY attribute, \"group\", y")
def risk_distribution(df):
    return discrimination.risk_distribution(df, ATTRIBUTES)


@query(f"WITH {S}, {LONG} SELECT attribute, \"group\", {r('AVG(p) FILTER (WHERE y = 1) - AVG(p) FILTER (WHERE y = 0)', 'discrimination_slope')} FROM l GROUP BY attribute, \"group\"")
def discrimination_slope(df):
    return discrimination.discrimination_slope(df, ATTRIBUTES)


_EDGES20 = " + ".join(f"CASE WHEN p >= CAST({i / 20!r} AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 20))


@query(f"WITH {S}, {LONG} SELECT attribute, \"group\", y, {_EDGES20} AS bin, COUNT(*) AS n FROM l GROUP BY attribute, \"group\", y, bin")
def risk_histogram(df):
    return discrimination.risk_histogram(df, ATTRIBUTES)


@query(f"{_HIST}, {_DESC} SELECT attribute, \"group\", {r('MAX(ABS(CAST(pos - tps + k AS DOUBLE)/pos - CAST(neg - fps + n - k AS DOUBLE)/neg))', 'ks_statistic')}, CAST(MAX(pos) AS BIGINT) AS n_positive, CAST(MAX(neg) AS BIGINT) AS n_negative FROM w GROUP BY attribute, \"group\"")
def ks_statistic(df):
    return discrimination.ks_statistic(groups.histogram(df, ATTRIBUTES))


# ---- calibration -----------------------------------------------------------------------------------------------------


@query(f"{CELLS}, k AS (SELECT *, sum_sq/n AS b, CAST(n_positive AS DOUBLE)/n AS prev FROM c) SELECT attribute, \"group\", n, {r('b', 'brier_score')}, {r('CASE WHEN prev*(1-prev) > 0 THEN 1 - b/(prev*(1-prev)) ELSE 0.0 END', 'brier_scaled')}, {r('CASE WHEN sum_p > 0 THEN n_positive/sum_p END', 'oe_ratio')}, {r('CASE WHEN n_positive > 0 THEN sum_p/n_positive END', 'eo_ratio')}, {r('sum_p/n - prev', 'mean_calibration_error')} FROM k")
def brier_oe(df):
    return calibration.scalars(rates.cells(df, ATTRIBUTES, T))


_EDGES10 = " + ".join(f"CASE WHEN p > CAST({i / 10!r} AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10))
_BINS = f"WITH {S}, {LONG}, b AS (SELECT attribute, \"group\", {_EDGES10} AS bin, COUNT(*) AS n, AVG(p) AS mp, AVG(y) AS mo FROM l GROUP BY attribute, \"group\", bin)"


@query(f"{_BINS} SELECT attribute, \"group\", bin, n, {r('mp', 'mean_predicted')}, {r('mo', 'mean_observed')} FROM b")
def reliability_bins(df):
    return calibration.reliability(df, ATTRIBUTES)


@query(f"{_BINS} SELECT attribute, \"group\", CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS n_bins, {r('AVG(ABS(mo - mp))', 'ece')}, {r('MAX(ABS(mo - mp))', 'mce')} FROM b GROUP BY attribute, \"group\" HAVING SUM(n) >= 20")
def calibration_by_group(df):
    return calibration.calibration_by_group(calibration.reliability(df, ATTRIBUTES))


_ACE = f"""WITH {S}, {LONG}, e AS (SELECT attribute, "group", LIST_DISTINCT(QUANTILE_CONT(p, [{', '.join(str(i / 10) for i in range(11))}])) AS edges FROM l GROUP BY attribute, "group"), e2 AS (SELECT attribute, "group", LIST_SORT(edges)[2:LEN(edges)-1] AS inside FROM e),
  x AS (SELECT l.attribute, l."group", l.p, l.y, LEN(LIST_FILTER(e2.inside, lambda v : v <= l.p)) AS bin FROM l JOIN e2 ON l.attribute = e2.attribute AND l."group" = e2."group"),
  b AS (SELECT attribute, "group", bin, COUNT(*) AS n, AVG(y) AS o, AVG(p) AS m FROM x GROUP BY attribute, "group", bin HAVING COUNT(*) >= 5)
  SELECT attribute, "group", {r('SUM(n * ABS(o - m))/SUM(n)', 'ace')}, COUNT(*) AS n_bins, CAST(SUM(n) AS BIGINT) AS n_used FROM b GROUP BY attribute, "group" """


@query(_ACE)
def ace_by_group(df):
    return calibration.ace(df, ATTRIBUTES)


@query(f"SELECT attribute, MAX(ace) - MIN(ace) AS gap FROM ({_ACE}) a WHERE attribute <> '_overall' GROUP BY attribute".replace("MAX(ace) - MIN(ace)", "ROUND(MAX(ace) - MIN(ace), 6) + 0.0"))
def ace_gap(df):
    return calibration.ace_gap(rounded(calibration.ace(df, ATTRIBUTES))).drop("worst_group")


# ---- description -----------------------------------------------------------------------------------------------------


@query(f"WITH {S} SELECT COUNT(*) AS n_total, CAST(SUM(y) AS BIGINT) AS n_positive, CAST(COUNT(*) - SUM(y) AS BIGINT) AS n_negative, {r('AVG(y)', 'prevalence')}, {r('AVG(p)', 'mean')}, {r('STDDEV_POP(p)', 'std')}, {r('MIN(p)', 'min')}, {r('MAX(p)', 'max')}, {', '.join(r(f'QUANTILE_CONT(p, {v})', n) for v, n in ((0.25, 'percentile_25'), (0.5, 'median'), (0.75, 'percentile_75'), (0.9, 'percentile_90'), (0.95, 'percentile_95')))} FROM s")
def cohort_overview(df):
    return descriptive.cohort_overview(df)


_plo, _phi = ("GREATEST(0.0, {})".format(f"(CAST(n_positive AS DOUBLE)/n + {Z * Z / 2!r}/n)/(1 + {Z * Z!r}/n) - {Z!r}/(1 + {Z * Z!r}/n) * SQRT((CAST(n_positive AS DOUBLE)/n*(1 - CAST(n_positive AS DOUBLE)/n) + {Z * Z / 4!r}/n)/n)"), "LEAST(1.0, {})".format(f"(CAST(n_positive AS DOUBLE)/n + {Z * Z / 2!r}/n)/(1 + {Z * Z!r}/n) + {Z!r}/(1 + {Z * Z!r}/n) * SQRT((CAST(n_positive AS DOUBLE)/n*(1 - CAST(n_positive AS DOUBLE)/n) + {Z * Z / 4!r}/n)/n)"))
_OUT = f"WITH {S}, {LONG}, c AS (SELECT attribute, \"group\", COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_positive, AVG(p) AS mp, STDDEV_SAMP(p) AS sp FROM l WHERE attribute <> '_overall' GROUP BY attribute, \"group\"), t AS (SELECT COUNT(*) AS total FROM s), b AS {ref_sql('c')}, o AS (SELECT c.attribute, c.\"group\", c.n, CAST(c.n AS DOUBLE)/t.total AS pct, c.n_positive, CAST(c.n_positive AS DOUBLE)/c.n AS rate, c.mp, c.sp, b.\"group\" AS rg, CAST(b.n_positive AS DOUBLE)/b.n AS rr FROM c, t, b WHERE c.attribute = b.attribute)"


@query(f"{_OUT} SELECT attribute, \"group\", n, {r('pct', 'pct')}, n_positive, {r('rate', 'outcome_rate')}, {r(_plo, 'ci_95_low')}, {r(_phi, 'ci_95_high')}, {r('CASE WHEN rr > 0 THEN rate/rr END', 'rate_ratio')}, \"group\" = rg AS is_reference, {r('mp', 'mean_prob')}, {r('sp', 'std_prob')} FROM o")
def outcome_by_attribute(df):
    return descriptive.outcome_by_attribute(df, ATTRIBUTES)


@query(f"{_OUT}, a AS (SELECT COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_positive FROM s) SELECT 'Overall' AS category, 'All' AS \"group\", n, 100.0 AS percentage, {r('CAST(n_positive AS DOUBLE)/n', 'outcome_rate')}, 1.0 AS rate_ratio, {r(_plo, 'ci_95_low')}, {r(_phi, 'ci_95_high')} FROM a UNION ALL SELECT attribute, \"group\", n, {r('100*pct', 'percentage')}, {r('rate', 'outcome_rate')}, {r('CASE WHEN rr > 0 THEN rate/rr END', 'rate_ratio')}, {r(_plo, 'ci_95_low')}, {r(_phi, 'ci_95_high')} FROM o")
def table1(df):
    return descriptive.table1(df, ATTRIBUTES)


@query(f"WITH {S}, {LONG} SELECT attribute, \"group\", COUNT(p) AS n, COUNT(*) - COUNT(p) AS n_missing, {r('AVG(p)', 'mean')}, {r('STDDEV_POP(p)', 'std')}, {r('QUANTILE_CONT(p, 0.25)', 'q1')}, {r('QUANTILE_CONT(p, 0.5)', 'median')}, {r('QUANTILE_CONT(p, 0.75)', 'q3')}, {r('MIN(p)', 'min')}, {r('MAX(p)', 'max')} FROM l GROUP BY attribute, \"group\"")
def continuous_summary(df):
    return descriptive.continuous_summary(df, "p", ATTRIBUTES)


@query(f"WITH {S}, {LONG}, c AS (SELECT attribute, \"group\", COUNT(*) FILTER (WHERE y = 0) AS n0, COUNT(*) FILTER (WHERE y = 1) AS n1, COUNT(*) AS n FROM l WHERE attribute <> '_overall' GROUP BY attribute, \"group\"), t AS (SELECT attribute, SUM(n0) AS t0, SUM(n1) AS t1, COUNT(*) AS rr, SUM(n) AS tn FROM c GROUP BY attribute), x AS (SELECT c.attribute, rr, c.n, POW(n0 - c.n*CAST(t0 AS DOUBLE)/tn, 2)/(c.n*CAST(t0 AS DOUBLE)/tn) + POW(n1 - c.n*CAST(t1 AS DOUBLE)/tn, 2)/(c.n*CAST(t1 AS DOUBLE)/tn) AS v FROM c JOIN t ON c.attribute = t.attribute), z AS (SELECT attribute, SUM(v) AS chi2, MAX(rr) - 1 AS dof, CAST(SUM(n) AS BIGINT) AS n FROM x GROUP BY attribute) SELECT attribute, {r('chi2', 'chi2')}, dof, n, {r('SQRT(chi2/n)', 'cramers_v')}, CASE WHEN SQRT(chi2/n) < 0.1 THEN 'negligible' WHEN SQRT(chi2/n) < 0.2 THEN 'small' WHEN SQRT(chi2/n) < 0.4 THEN 'medium' ELSE 'large' END AS interpretation FROM z")
def crosstab_chi2(df):
    return descriptive.chi_square(descriptive.crosstab(df, ATTRIBUTES))


# ---- intersections, adequacy, multiplicity ---------------------------------------------------------------------------


def crossed_sql(sets) -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT '{' x '.join(s)}' AS attribute, {' || '.join(x for i, a in enumerate(s) for x in ([chr(39) + ' x ' + chr(39)] if i else []) + [a])} AS \"group\", p, y FROM s" for s in sets) + ")"


def intersect_sql(sets) -> str:
    return _AUC.replace(LONG, crossed_sql(sets)) + f", c AS {cells_sql()}, k AS (SELECT c.attribute, c.\"group\", c.n, {q('c.n_positive', 'c.n')} AS prevalence, {', '.join(f'{RATE[m]} AS {m}'.replace('n_positive', 'c.n_positive').replace(' n >', ' c.n >').replace('/ n ', '/ c.n ') for m in ('tpr', 'fpr', 'ppv', 'selection_rate'))}, auc.auroc FROM c JOIN auc ON c.attribute = auc.attribute AND c.\"group\" = auc.\"group\")"


_KEEP = ", ".join(r(c, c) for c in ("prevalence", "tpr", "fpr", "ppv", "selection_rate", "auroc"))


@query(f"{intersect_sql([ATTRIBUTES[:2]])} SELECT attribute, \"group\", n, {_KEEP} FROM k WHERE n >= 30")
def intersectional(df):
    return intersect.intersectional(df, [ATTRIBUTES[:2]], T)


@query(f"{intersect_sql(groups.pairs(ATTRIBUTES))} SELECT attribute, \"group\", n, {_KEEP} FROM k WHERE n >= 30")
def pairwise_intersectional(df):
    return intersect.intersectional(df, groups.pairs(ATTRIBUTES), T)


@query(f"{intersect_sql([[a] for a in ATTRIBUTES] + groups.pairs(ATTRIBUTES))} SELECT attribute, \"group\", n, {r('auroc', 'auroc')}, {r('0.85 - auroc', 'gap')} FROM k WHERE n >= 30 AND auroc < 0.85")
def vulnerable_subgroups(df):
    return intersect.vulnerable_subgroups(df, ATTRIBUTES, T, limit=0.85)


@query(f"{CELLS} SELECT attribute, \"group\", n, CASE WHEN n < 10 THEN 'VERY_LOW' WHEN n < 30 THEN 'LOW' WHEN n < 50 THEN 'MODERATE' WHEN LEAST(n_positive, n - n_positive) < 5 THEN 'LOW' WHEN LEAST(n_positive, n - n_positive) < 10 THEN 'MODERATE' ELSE 'ADEQUATE' END AS sample_status, CASE WHEN n < 10 OR n_positive < 5 OR n_negative < 5 THEN 'VERY_LOW' WHEN n_positive < 10 OR n_negative < 10 OR n < 30 THEN 'LOW' WHEN n < 50 THEN 'MODERATE' ELSE 'ADEQUATE' END AS adequacy FROM c")
def sample_adequacy(df):
    c = rates.cells(df, ATTRIBUTES, T)
    return c.select("attribute", "group", "n", intervals.sample_status(F.col("n"), F.col("n_positive")).alias("sample_status"), intervals.sample_adequacy(F.col("n"), F.col("n_positive"), F.col("n_negative")).alias("adequacy"))


@query(f"WITH {S}, {LONG}, c AS (SELECT attribute, \"group\", y, COUNT(DISTINCT cluster_id) AS n_effective FROM l WHERE attribute <> '_overall' GROUP BY attribute, \"group\", y) SELECT *, CASE WHEN n_effective < 5 THEN 'SUPPRESS' WHEN n_effective < 30 THEN 'FLAG' ELSE 'REPORT' END AS status FROM c")
def stratum_adequacy(df):
    return rates.stratum_adequacy(df, ATTRIBUTES)


@query(f"WITH {S} SELECT COUNT(DISTINCT cluster_id) AS n_effective FROM s")
def effective_sample_size(df):
    return rates.effective_sample_size(df, "cluster")


# Exact tests of each group's outcome against its attribute's largest group: sums of the chances of all tables as likely or less.
_FISHER = f"""{CELLS}, n AS (SELECT attribute, "group", n_positive AS a, n - n_positive AS b, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY n DESC, "group") AS i FROM c WHERE attribute <> '_overall'),
 f AS (SELECT n.attribute, n."group", m."group" AS ref_group, n.a, n.b, m.a AS c, m.b AS d FROM n JOIN n m ON m.attribute = n.attribute AND m.i = 1 WHERE n.i > 1),
 x AS (SELECT attribute, "group", ref_group, a, b, c, d, UNNEST(GENERATE_SERIES(GREATEST(0, a - d), LEAST(a + b, a + c))) AS x FROM f),
 g AS (SELECT *, LGAMMA(a+b+1) - LGAMMA(x+1) - LGAMMA(a+b-x+1) + LGAMMA(c+d+1) - LGAMMA(a+c-x+1) - LGAMMA(d-a+x+1) - LGAMMA(a+b+c+d+1) + LGAMMA(a+c+1) + LGAMMA(b+d+1) AS p FROM x),
 fisher AS (SELECT attribute, "group", ref_group, LEAST(1, SUM(EXP(p)) FILTER (p <= own + 1e-7)) AS p_value FROM (SELECT *, MAX(p) FILTER (x = a) OVER (PARTITION BY attribute, "group") AS own FROM g) GROUP BY ALL)"""
_P = f"{_FISHER}, o AS (SELECT *, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY p_value) AS i FROM fisher)"


def _tests(df):
    return descriptive.fisher_against_reference(descriptive.crosstab(df, ATTRIBUTES)).select("attribute", "group", "p_value")


@query(f"{_P} SELECT attribute, \"group\", {r('p_value', 'p_value')}, {r('MAX(LEAST(1.0, p_value*(m - i + 1))) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)', 'p_adjusted')} FROM o")
def holm_adjust(df):
    return multiplicity.adjust(_tests(df), method="holm")


@query(f"{_P} SELECT attribute, \"group\", {r('p_value', 'p_value')}, {r('MIN(LEAST(1.0, p_value*m/i)) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)', 'p_adjusted')} FROM o")
def bh_adjust(df):
    return multiplicity.adjust(_tests(df), method="fdr_bh")


@query("WITH " + S + " " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, COUNT(DISTINCT {a}) AS n_unique, COUNT(*) - COUNT({a}) AS n_missing, 0.0 + CAST(COUNT(*) - COUNT({a}) AS DOUBLE)/COUNT(*) AS missing_rate FROM s" for a in ATTRIBUTES))
def attribute_profile(df):
    return load.attribute_profile(df, ATTRIBUTES)


@query(f"""{CELLS}, {fairness_sql()}, fl AS (SELECT 'sample_size' AS category, attribute, "group", CAST('n' AS VARCHAR) AS metric, CAST(n AS DOUBLE) AS value FROM c WHERE attribute <> '_overall' AND n < 100
  UNION ALL SELECT 'fairness', attribute, "group", 'demographic_parity', demographic_parity_ratio FROM fd WHERE demographic_parity_ratio < 0.8 OR demographic_parity_ratio > 1.25
  UNION ALL SELECT 'fairness', attribute, "group", 'equalized_odds', equalized_odds_diff FROM fd WHERE equalized_odds_diff > 0.1) SELECT 'warning' AS severity, category, attribute, "group", metric, {r('value', 'value')} FROM fl""")
def flags(df):
    return audit.flags(rates.cells(df, ATTRIBUTES, T), load.attribute_profile(df, ATTRIBUTES)).select("severity", "category", "attribute", "group", "metric", "value")


# ---- without SQL: iteration, resampling, tail functions --------------------------------------------------------------


@query()
def calibration_slope(df):
    return calibration.logistic_recalibration(df, ATTRIBUTES)


# Every place against all rows of its group: the distance of the k-th nearest row, then sums of tricube weights.
_CURVE = f"""WITH {S}, {LONG}, g AS (SELECT attribute, "group", COUNT(*) AS m, MAX(p) - MIN(p) AS span, CAST(GREATEST(1, FLOOR(0.75*COUNT(*) + 1e-9)) AS BIGINT) AS near FROM l GROUP BY ALL),
 h AS (SELECT l.attribute, l."group", p, COUNT(*) AS n, SUM(y) AS k, m, span FROM l JOIN g ON g.attribute = l.attribute AND g."group" = l."group" GROUP BY ALL),
 i AS (SELECT l.attribute, l."group", p, near, ROW_NUMBER() OVER (PARTITION BY l.attribute, l."group" ORDER BY p) AS i FROM l JOIN g ON g.attribute = l.attribute AND g."group" = l."group"),
 o AS (SELECT x.attribute, x."group", x.p AS lo, y.p AS hi FROM i x JOIN i y ON x.attribute = y.attribute AND x."group" = y."group" AND y.i = x.i + x.near - 1),
 d AS (SELECT h.attribute, h."group", h.p, MIN(GREATEST(h.p - o.lo, o.hi - h.p)) AS d FROM h JOIN o ON h.attribute = o.attribute AND h."group" = o."group" WHERE h.m >= 20 GROUP BY ALL),
 w AS (SELECT d.attribute, d."group", d.p, d.d, b.n*POW(1 - POW(ABS(b.p - d.p)/d.d, 3), 3) AS w, (b.p - d.p)/d.d AS t, b.k/b.n AS y FROM d JOIN h b ON d.attribute = b.attribute AND d."group" = b."group" AND ABS(b.p - d.p) < d.d),
 e AS (SELECT attribute, "group", p, d, SUM(w) AS w, SUM(w*t)/SUM(w) AS t, SUM(w*t*t)/SUM(w) AS tt, SUM(w*y)/SUM(w) AS y, SUM(w*t*y)/SUM(w) AS ty FROM w GROUP BY ALL),
 curve AS (SELECT h.attribute, h."group", h.p, h.n, CAST(h.k AS BIGINT) AS k, LEAST(1, GREATEST(0, e.y - CASE WHEN (e.tt - e.t*e.t)*e.d*e.d > POW(0.001*h.span, 2) THEN (e.ty - e.t*e.y)/(e.tt - e.t*e.t)*e.t ELSE 0 END)) AS smoothed FROM e JOIN h ON h.attribute = e.attribute AND h."group" = e."group" AND h.p = e.p)"""


@query(f"{_CURVE} SELECT attribute, \"group\", {r('p', 'p')}, n, k, {r('smoothed', 'smoothed')} FROM curve")
def lowess_curve(df):
    return calibration.lowess_curve(df, ATTRIBUTES)


@query(f"{_CURVE}, q AS (SELECT attribute, \"group\", SUM(n*ABS(smoothed - p))/SUM(n) AS ici, SUM(n*POW(smoothed - p, 2))/SUM(n) AS sq, MAX(ABS(smoothed - p)) AS e_max, SUM(k)/SUM(n) AS prev, SUM(n*p)/SUM(n) AS sp, SUM(n*p*p)/SUM(n) AS spp FROM curve GROUP BY ALL) SELECT attribute, \"group\", {r('ici', 'ici')}, {r('sq/(prev*prev - 2*prev*sp + spp)', 'eci')}, {r('e_max', 'e_max')} FROM q")
def calibration_curve_errors(df):
    return calibration.curve_errors(calibration.lowess_curve(df, ATTRIBUTES))


@query()
def bootstrap_auroc_ci(df):
    return resampling.percentile_ci(resampling.bootstrap_auroc(df, ATTRIBUTES))


@query()
def ace_bootstrap_ci(df):
    return resampling.percentile_ci(resampling.bootstrap_ace(df, ATTRIBUTES))


@query()
def ace_gap_ci(df):
    return resampling.percentile_ci(resampling.gap_samples(resampling.bootstrap_ace(df, ATTRIBUTES, clusters=True)), ("attribute",))


@query()
def cluster_auroc_ci(df):
    return resampling.percentile_ci(resampling.cluster_auroc(df, ATTRIBUTES))


@query()
def cluster_auroc_gap_ci(df):
    return resampling.percentile_ci(resampling.gap_samples(resampling.cluster_auroc(df, ATTRIBUTES)), ("attribute",))


_BAND = "CASE WHEN auroc IS NULL THEN NULL WHEN auroc < 0.6 THEN 'Failed discrimination (no better than chance)' WHEN auroc < 0.7 THEN 'Poor discrimination' WHEN auroc < 0.8 THEN 'Acceptable discrimination' WHEN auroc < 0.9 THEN 'Good discrimination' ELSE 'Excellent discrimination' END"
_ALSO = " ".join(f"JOIN ({ORACLES[name]}) {alias} ON {alias}.attribute = a.attribute AND {alias}.\"group\" = a.\"group\"" for name, alias in (("brier_oe", "b"), ("net_benefit_by_group", "nb"), ("discrimination_slope", "ds")))


@query(f"SELECT a.*, {_BAND} AS interpretation, b.* EXCLUDE (attribute, \"group\", n), nb.* EXCLUDE (attribute, \"group\"), ds.discrimination_slope FROM ({ORACLES['auroc_by_group']}) a {_ALSO}")
def four_pack(df):
    return audit.four_pack(df, ATTRIBUTES, T)["measures"]


@query()
def bootstrap_confusion_ci(df):
    return resampling.percentile_ci(resampling.bootstrap_confusion(rates.cells(df, ATTRIBUTES, T)), ("attribute", "group", "metric"))


@query()
def cluster_bootstrap_ci(df):
    return resampling.percentile_ci(resampling.cluster_bootstrap(df, ATTRIBUTES, T, "tpr"))


@query()
def permutation_test(df):
    return permutation.permutation_test(df, "c_mktsegment", "tpr", T)


@query()
def permutation_test_rows(df):
    return permutation.permutation_test(df.drop("cluster"), "c_mktsegment", "tpr", T)


@query()
def permutation_test_auroc(df):
    return permutation.permutation_test(df.drop("cluster"), "c_mktsegment", "auroc")


@query()
def permutation_test_auroc_clusters(df):
    return permutation.permutation_test(df, "c_mktsegment", "auroc")


@query()
def clopper_pearson(df):
    e = intervals.clopper_pearson("n_positive", "n")
    return rates.cells(df, ATTRIBUTES, T).select("attribute", "group", e["lower"].alias("ci_lower"), e["upper"].alias("ci_upper"))


@query()
def ztest_pvalue(df):
    return disparity.disparities(rates.cells(df, ATTRIBUTES, T), "tpr").select("attribute", "comparison_group", "z", "p_value")


# The upper tail of chi-square at an even number of degrees of freedom is a finite sum.
@query(f"""{CELLS}, t AS (SELECT attribute, SUM(n_positive) AS k, SUM(n) AS n, COUNT(*) - 1 AS dof FROM c WHERE attribute <> '_overall' GROUP BY attribute),
 q AS (SELECT t.attribute, t.n, t.dof, SUM(POW(c.n_positive - c.n*t.k/t.n, 2)/(c.n*t.k/t.n) + POW(c.n - c.n_positive - c.n*(t.n - t.k)/t.n, 2)/(c.n*(t.n - t.k)/t.n)) AS chi2 FROM c JOIN t ON t.attribute = c.attribute GROUP BY ALL),
 e AS (SELECT *, SQRT(chi2/n) AS v, LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(0, CAST(dof/2 AS BIGINT) - 1), lambda i: EXP(-chi2/2)*POW(chi2/2, i)/GAMMA(i + 1))) AS p FROM q)
 SELECT attribute, {r('chi2', 'chi2')}, dof, CAST(n AS BIGINT) AS n, {r('v', 'cramers_v')}, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.2 THEN 'small' WHEN v < 0.4 THEN 'medium' ELSE 'large' END AS interpretation, {r('p', 'p_value')} FROM e""")
def chi2_pvalue(df):
    return descriptive.chi_square_test(descriptive.crosstab(df, ATTRIBUTES))


@query(f"{_FISHER} SELECT attribute, \"group\", ref_group, {r('p_value', 'p_value')} FROM fisher")
def fisher_exact(df):
    return descriptive.fisher_against_reference(descriptive.crosstab(df, ATTRIBUTES))


@query()
def ks_test(df):
    return discrimination.ks_test(discrimination.ks_statistic(groups.histogram(df, ATTRIBUTES)))


@query(f"""{_HIST}, {_DESC}, d AS (SELECT attribute, "group", MAX(ABS(CAST(pos - tps + k AS DOUBLE)/pos - CAST(neg - fps + n - k AS DOUBLE)/neg)) AS d, CAST(MAX(pos) AS BIGINT) AS n_positive, CAST(MAX(neg) AS BIGINT) AS n_negative FROM w GROUP BY attribute, "group"),
 x AS (SELECT *, d*SQRT(CAST(n_positive AS DOUBLE)*n_negative/(n_positive + n_negative)) AS x FROM d)
 SELECT attribute, "group", {r('d', 'ks_statistic')}, n_positive, n_negative, {r('CASE WHEN x < 0.3 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, 2*LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(1, 100), lambda i: POW(-1, i - 1)*EXP(-2*i*i*x*x))))) END', 'p_value')} FROM x""")
def ks_test_asymptotic(df):
    return discrimination.ks_test(discrimination.ks_statistic(groups.histogram(df, ATTRIBUTES)), exact=False)


@query()
def auprc_bootstrap_ci(df):
    return resampling.percentile_ci(resampling.discrimination_samples(df, ATTRIBUTES, metric=resampling.weighted_precision))


@query()
def auroc_comparison_ci(df):
    compared = discrimination.auroc_comparison(discrimination.auroc(groups.histogram(df, ATTRIBUTES)))
    return discrimination.auroc_comparison_ci(compared, resampling.discrimination_samples(df, ATTRIBUTES))


def _log_loss():
    """A metric of a user's own: mean log loss of scores kept away from 0 and 1, with the share of rows beyond 0.9."""
    return metrics.Sums(lambda p, y: (-np.log(np.where(y == 1, np.clip(p, 1e-6, 1 - 1e-6), 1 - np.clip(p, 1e-6, 1 - 1e-6))), p > 0.9, np.ones_like(p)), lambda loss, high, n: loss / n + high / n)


@query(f"WITH {S}, {LONG} SELECT attribute, \"group\", COUNT(*) AS n, {r('AVG(-LN(CASE WHEN y = 1 THEN LEAST(GREATEST(p, 1e-6), 1 - 1e-6) ELSE 1 - LEAST(GREATEST(p, 1e-6), 1 - 1e-6) END)) + AVG(CASE WHEN p > 0.9 THEN 1.0 ELSE 0.0 END)', 'value')} FROM l GROUP BY ALL")
def user_metric(df):
    return metrics.evaluate(df, ATTRIBUTES, _log_loss())


@query()
def user_metric_ci(df):
    return metrics.metric_ci(df, ATTRIBUTES, _log_loss())


@query()
def little_bootstrap_ci(df):
    return metrics.statistic_ci(df, metrics.weighted_quantile(0.9), "p")


def _own(sql: str | None = None):
    """Registers a query that reads its tables itself."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PROFILED = ["c_mktsegment", "r_name", "o_orderpriority", "y_true", "cluster_id"]
_KIND = "CASE WHEN n_unique <= 20 THEN 'categorical' WHEN column_ = 'cluster_id' THEN 'numeric' ELSE 'text' END"


@_own(f"WITH {S}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_, COUNT(DISTINCT {c}) AS n_unique, COUNT(*) - COUNT({c}) AS null_count, CAST(MIN({c}) AS VARCHAR) AS lo, CAST(MAX({c}) AS VARCHAR) AS hi, LIST_SLICE(LIST_SORT(LIST(DISTINCT CAST({c} AS VARCHAR))), 1, 5) AS first_ FROM s" for c in _PROFILED if c != "y_true") + f""")
 SELECT column_ AS "column", {_KIND} AS kind, CASE WHEN n_unique < 1024 THEN n_unique ELSE -1 END AS n_unique, n_unique < 1024 AS exact, null_count, CASE WHEN {_KIND} = 'numeric' THEN ARRAY_TO_STRING(['min: ' || lo || '.0', 'max: ' || hi || '.0'], ',') ELSE ARRAY_TO_STRING(first_, ',') END AS sample_values, column_ LIKE '%region%' AS hinted FROM u""")
def column_profile(spark, sf_dir):
    found = profile.detect_demographics(load.scored(spark, sf_dir).select(*_PROFILED))
    return found.withColumns({"sample_values": F.array_join("sample_values", ","), "n_unique": F.when(F.col("exact"), F.col("n_unique")).otherwise(F.lit(-1))})  # an estimate has no SQL


_DATED = f"""d AS (SELECT s.*, CAST(FLOOR(EPOCH(o_orderdate)/86400/30) AS BIGINT)*30 AS day FROM s JOIN orders ON o_orderkey = row_id), b AS (SELECT attribute, "group", day, LEAST(999, CAST(FLOOR(p*1000) AS BIGINT)) AS bucket, COUNT(*) AS n, SUM(y) AS k FROM (""" + " UNION ALL ".join([f'''SELECT '{a}' AS attribute, {a} AS "group", day, p, y FROM d''' for a in ATTRIBUTES] + ["SELECT '_overall', '_overall', day, p, y FROM d"]) + """) l GROUP BY ALL), o AS (SELECT *, n - k AS neg, SUM(n - k) OVER (PARTITION BY attribute, "group", day ORDER BY bucket) - (n - k) AS below FROM b)"""


@_own(f"WITH {S}, {_DATED} SELECT attribute, \"group\", day, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS n_positive, {r('CASE WHEN SUM(k) > 0 AND SUM(neg) > 0 THEN SUM(k*(below + neg/2.0))/SUM(k)/SUM(neg) END', 'auroc')} FROM o GROUP BY attribute, \"group\", day")
def windowed_auroc(spark, sf_dir):
    """AUROC of windows of 30 days by the streaming monitor's own counts, on the orders' dates."""
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"), F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")) * 86400).alias("at"))
    rows = load.scored(spark, sf_dir).join(dates, "row_id")
    out = ordered.of_table(ordered.buckets(rows, "at", ATTRIBUTES, "30 days"))
    return out.select("attribute", "group", F.floor(F.unix_seconds("window_start") / 86400).cast("long").alias("day"), "n", "n_positive", "auroc")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all groups and their disparities, from one aggregation of the scored view."""
    df = groups.standard(load.scored(spark, sf_dir), attributes=ATTRIBUTES)
    return rounded(disparity.disparities(rates.cells(df, ATTRIBUTES, T), "tpr"))
