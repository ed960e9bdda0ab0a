"""The audit: sections as tidy frames, flags, recommendation, result."""

from __future__ import annotations

import datetime
import math
import os
import platform
from collections.abc import Sequence
from dataclasses import dataclass, field
from importlib.metadata import PackageNotFoundError, version
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..config import FairnessConfig, SensitiveAttribute
from ..errors import ColumnNotFoundError, ConfigurationError
from ..logs import get_logger
from ..operators import calibration, descriptive, discrimination, disparity, groups, intersect, rates, resampling, thresholds
from ..sources import load
from . import decision

FLAG = ["severity", "category", "message", "details", "criteria", "attribute", "group", "metric", "value", "threshold"]


def flags(cells: DataFrame, profile: DataFrame, limits: dict[str, Any] | None = None, fairness: DataFrame | None = None) -> DataFrame:
    """Warnings for small groups, selection ratios and equalized-odds differences out of bounds, and missing attributes."""
    limits = FairnessConfig("").thresholds | (limits or {})
    least, (low, high), odds, missing = limits["min_subgroup_n"], limits["demographic_parity_ratio"], limits["equalized_odds_diff"], limits["max_missing_rate"]
    fair = disparity.fairness(cells) if fairness is None else fairness

    def rows(df: DataFrame, category: str, metric: str, value, text, criteria: str, threshold: str) -> DataFrame:
        group = F.col("group") if "group" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit("warning").alias("severity"), F.lit(category).alias("category"), text.alias("message"), F.concat(F.lit("attribute "), F.col("attribute"), F.coalesce(F.concat(F.lit(", group "), group), F.lit(""))).alias("details"), F.lit(criteria).alias("criteria"), "attribute", group.alias("group"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(threshold).alias("threshold"))

    small = cells.where((F.col("attribute") != C.OVERALL) & (F.col("n") < least))
    parity = fair.where((F.col("demographic_parity_ratio") < low) | (F.col("demographic_parity_ratio") > high))
    unequal = fair.where(F.col("equalized_odds_diff") > odds)
    return (
        rows(small, "sample_size", "n", F.col("n"), F.format_string(f"Subgroup n=%d < {least}", "n"), "AC1.CR82", str(least))
        .unionByName(rows(parity, "fairness", "demographic_parity", F.col("demographic_parity_ratio"), F.format_string(f"Demographic parity ratio %.2f outside [{low}, {high}]", "demographic_parity_ratio"), "AC1.CR92", f"{low}-{high}"))
        .unionByName(rows(unequal, "fairness", "equalized_odds", F.col("equalized_odds_diff"), F.format_string(f"Equalized odds difference %.3f > {odds}", "equalized_odds_diff"), "AC1.CR92", str(odds)))
        .unionByName(rows(profile.where(F.col("missing_rate") > missing), "data_quality", "missing_rate", F.col("missing_rate"), F.format_string(f"Missing rate %.1f%%%% > {missing:.0%}%".replace("%%%%", "%%"), F.col("missing_rate") * 100), "AC1.CR68", str(missing)))
    )


def recommendation(found: Sequence[dict[str, Any]], n_attributes: int, config: FairnessConfig | None = None) -> dict[str, Any]:
    """Advisory status from the flags; three checks an attribute."""
    errors = [f for f in found if f["severity"] == "error"]
    warnings = [f for f in found if f["severity"] == "warning"]
    status, advisory = ("REVIEW", "Issues were found that may call for review before deployment.") if errors else ("CONDITIONAL", "Some measures are near their limits; consider a documented mitigation.") if warnings else ("READY", "No issue at the present limits.")
    total = 3 * n_attributes
    n_pass = max(0, total - len(errors) - len(warnings))
    return {"status": status, "advisory": advisory, "disclaimer": "Guidance only: the decision to deploy rests with the institution's stakeholders.", "outside_threshold_count": len(errors), "near_threshold_count": len(warnings), "within_threshold_count": n_pass, "total_checks": total, "outside_threshold_items": errors, "near_threshold_items": warnings, "primary_fairness_metric": config.primary_fairness_metric.value if config and config.primary_fairness_metric else None, "justification_provided": bool(config and config.fairness_justification), "n_errors": len(errors), "n_warnings": len(warnings), "n_pass": n_pass}


def environment(spark: SparkSession | None = None) -> dict[str, Any]:
    def of(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    return {"python": platform.python_version(), "platform": platform.platform(), "packages": {p: of(p) for p in ("pyspark", "pyarrow", "numpy", "pandas")}, "git_sha": os.environ.get("GIT_SHA"), "spark": spark.version if spark else None, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions") if spark else None}


@dataclass
class AuditResults:
    """Sections of an audit as tidy DataFrames; :meth:`collected` brings them to the driver once (rows a group, not a row)."""

    config: FairnessConfig
    threshold: float
    attributes: list[SensitiveAttribute]
    frames: dict[str, DataFrame]
    metadata: dict[str, Any] = field(default_factory=dict)
    flags: list[dict[str, Any]] = field(default_factory=list)
    governance_recommendation: dict[str, Any] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)
    _tables: dict[str, list[dict[str, Any]]] = field(default_factory=dict)

    def release(self) -> None:
        """Give back the cached tables that the sections share; sections read later are computed from the input again."""
        for df in self.held:
            df.unpersist()
        self.held = []

    def __enter__(self) -> AuditResults:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def collected(self, name: str) -> list[dict[str, Any]]:
        if name not in self._tables:
            self._tables[name] = [r.asDict(recursive=True) for r in self.frames[name].collect()] if name in self.frames else []
        return self._tables[name]

    def table1(self) -> DataFrame:
        return self.frames["table1"]

    def print_table1(self) -> str:
        return descriptive.table1_text(self.collected("table1"))

    def overall(self) -> dict[str, Any]:
        """All overall measures in one record."""
        out: dict[str, Any] = {}
        for name in ("classification", "auroc", "precision", "calibration", "recalibration", "curve_errors", "net_benefit"):
            out |= next((r for r in self.collected(name) if r["attribute"] == C.OVERALL), {})
        return {k: v for k, v in out.items() if k not in ("attribute", "group")}

    def summary(self) -> str:
        o, g = self.overall(), self.governance_recommendation
        show = lambda k: "-" if o.get(k) is None else f"{o[k]:.3f}"
        lines = [f"Audit of {self.config.model_name} {self.config.model_version}", f"rows {o.get('n', 0)}, prevalence {(o.get('n_positive') or 0) / max(o.get('n') or 0, 1):.3f}, threshold {self.threshold}", f"AUROC {show('auroc')}, Brier {show('brier_score')}, slope {show('calibration_slope')}, sensitivity {show('sensitivity')}, specificity {show('specificity')}", f"status {g['status']}: {g['advisory']}", f"{g['n_errors']} errors, {g['n_warnings']} warnings, {g['n_pass']} of {g['total_checks']} checks passed"]
        return "\n".join(lines + [f"  [{f['category']}] {f['message']} ({f['details']})" for f in self.flags])

    def audit_summary(self) -> dict[str, Any]:
        fair = self.collected("fairness")
        worst = max(fair, key=lambda r: (r["equalized_odds_diff"], r["attribute"], r["group"]), default=None)
        return {"model_name": self.config.model_name, "n_groups": sum(1 for r in self.collected("classification") if r["attribute"] != C.OVERALL), "worst_group": worst and worst["group"], "worst_attribute": worst and worst["attribute"], "worst_equalized_odds": worst and worst["equalized_odds_diff"], **{k: self.governance_recommendation[k] for k in ("n_pass", "n_warnings", "n_errors", "status")}}


class Audit:
    """Audit a scored table: choose attributes, run, export."""

    def __init__(self, spark: SparkSession, data: DataFrame | pd.DataFrame | str, pred_col: str, target_col: str, config: FairnessConfig | None = None, threshold: float | None = None):
        self.spark, self.df = spark, load.load(spark, data)
        self.pred_col, self.target_col = pred_col, target_col
        self.config = config or FairnessConfig("model")
        self.threshold = threshold if threshold is not None else self.config.decision_thresholds[0]
        if not 0 < self.threshold < 1:
            raise ConfigurationError("the threshold must lie between 0 and 1", "threshold")
        self.n = load.validate(self.df, pred_col, target_col)
        self.suggestions = load.suggest_attributes(self.df)
        self.attributes: list[SensitiveAttribute] = []
        self.intersections: list[list[str]] = []

    def suggest_attributes(self) -> str:
        return load.display_suggestions(self.suggestions)

    def accept_suggested_attributes(self, selections: Sequence[int | str], modify: dict[str, dict[str, Any]] | None = None) -> Audit:
        for s in selections:
            hit = self.suggestions[s - 1] if isinstance(s, int) and 1 <= s <= len(self.suggestions) else next((x for x in self.suggestions if x["suggested_name"] == s), None)
            if hit is None:
                raise ValueError(f"no such suggestion: {s}")
            own = {"reference": hit["suggested_reference"], "clinical_justification": hit["clinical_justification"]} | (modify or {}).get(hit["suggested_name"], {})
            self.add_sensitive_attribute(hit["suggested_name"], hit["detected_column"], own["reference"], clinical_justification=own["clinical_justification"])
        return self

    def add_sensitive_attribute(self, name: str, column: str | None = None, reference: str | None = None, categories: list[str] | None = None, clinical_justification: str | None = None) -> Audit:
        column = column or name
        if column not in self.df.columns:
            raise ColumnNotFoundError(column, self.df.columns)
        for issue in load.validate_attribute(self.df, name, column, reference, categories):
            get_logger("audit").warning(issue)
        reference = load.reference_group(self.df, column, reference)
        self.attributes = [a for a in self.attributes if a.name != name] + [SensitiveAttribute(name, column, reference, categories, clinical_justification)]
        return self

    def add_intersection(self, names: Sequence[str]) -> Audit:
        known = {a.name for a in self.attributes}
        if gone := [n for n in names if n not in known]:
            raise ValueError(f"not registered: {', '.join(gone)}")
        self.intersections.append(list(names))
        return self

    def suggest_fairness_metric(self) -> dict[str, Any]:
        return decision.metric_options(self.config.use_case_type)

    def run(self, bootstrap_ci: bool = True, n_bootstrap: int = C.N_BOOTSTRAP, random_seed: int = C.SEED) -> AuditResults:
        """All sections. Rows are read into two compact tables (cells and score histograms) that every section shares."""
        problems = [m for level, m in self.config.validate() if level == "ERROR"]
        if problems:
            raise ConfigurationError("; ".join(problems))
        if not self.attributes:
            raise ConfigurationError("no sensitive attribute was chosen", "attributes")
        names = [a.name for a in self.attributes]
        refs = {a.name: a.reference for a in self.attributes if a.reference}
        keep = [F.col(self.pred_col).cast("double").alias("p"), F.col(self.target_col).cast("int").alias("y"), *(F.col(a.column).cast("string").alias(a.name) for a in self.attributes)]
        df = self.df.select(*keep).persist()
        cells = rates.cells(df, names, self.threshold).persist()
        hist = groups.histogram(df, names).persist()
        auc = discrimination.auroc(hist)
        fair = disparity.fairness(cells, refs)
        curve = calibration.lowess_curve(df, names)
        frames = {
            "overview": descriptive.cohort_overview(df), "table1": descriptive.table1(df, names, refs), "outcome": descriptive.outcome_by_attribute(df, names, refs), "profile": load.attribute_profile(df, names),
            "rates": rates.with_intervals(rates.group_rates(cells), ["tpr", "fpr", "ppv", "npv"]), "classification": rates.classification(cells), "auroc": discrimination.auroc_bands(auc), "auroc_comparison": discrimination.auroc_comparison(auc, refs), "precision": discrimination.precision_summaries(hist),
            "roc": discrimination.roc_points(hist), "calibration": calibration.scalars(cells), "reliability": calibration.reliability(df, names), "recalibration": calibration.logistic_recalibration(df, names), "curve": curve, "curve_errors": calibration.curve_errors(curve),
            "sweep": thresholds.sweep(df), "decision_curve": thresholds.decision_curve(df, names), "net_benefit": thresholds.net_benefit(cells, self.threshold), "risk": discrimination.risk_distribution(df, names), "risk_histogram": discrimination.risk_histogram(df, names),
            "subgroup": disparity.subgroup_disparities(cells, auc, refs), "fairness": fair, "fairness_summary": disparity.fairness_summary(fair), "disparities": disparity.disparities(cells, "tpr", refs),
        }
        frames["disparity_index"] = disparity.disparity_index(frames["fairness_summary"])
        if self.intersections:
            frames["intersectional"] = intersect.intersectional(df, self.intersections, self.threshold, self.config.get_threshold("min_subgroup_n", C.SUBGROUP_N))
        if bootstrap_ci:
            samples = resampling.discrimination_samples(df, names, n_bootstrap, random_seed)
            frames["auroc_ci"] = resampling.percentile_ci(samples)
            frames["auprc_ci"] = resampling.percentile_ci(resampling.discrimination_samples(df, names, n_bootstrap, random_seed, resampling.weighted_precision))
            frames["auroc_comparison"] = discrimination.auroc_comparison_ci(frames["auroc_comparison"], samples)
            frames["classification_ci"] = resampling.percentile_ci(resampling.bootstrap_confusion(cells, n_bootstrap, random_seed), ("attribute", "group", "metric"))
        found = [r.asDict() for r in flags(cells, frames["profile"], self.config.thresholds, fair).orderBy("category", "attribute", "group").collect()]
        meta = {"run_timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "n_rows": self.n, "bootstrap_ci": bootstrap_ci, "n_bootstrap": n_bootstrap, "random_seed": random_seed, "environment": environment(self.spark)}
        out = AuditResults(self.config, self.threshold, self.attributes, frames, meta, found)
        out.governance_recommendation = recommendation(found, len(self.attributes), self.config)
        out.held = [df, cells, hist]
        return out


def four_pack(df: DataFrame, attributes: Sequence[str] = (), threshold: float = C.THRESHOLD, reference: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Discrimination, calibration, net benefit and risk distribution, overall and by group, with disparities. ``df`` is a standard frame."""
    cells, hist = rates.cells(df, attributes, threshold), groups.histogram(df, attributes)
    auc, cal = discrimination.auroc_bands(discrimination.auroc(hist)), calibration.scalars(cells)
    nb, slope = thresholds.net_benefit(cells, threshold), discrimination.discrimination_slope(df, attributes)
    key = ["attribute", "group"]
    joined = auc.join(cal.drop("n"), key).join(nb.drop("interpretation"), key).join(slope, key)
    base = joined.where((F.col("attribute") != C.OVERALL) & (F.col("n") >= 10))
    both = groups.against_reference(base, groups.references(base, reference))
    diffs = both.select("attribute", "group", "ref_group", *((F.col(c) - F.col(f"ref_{c}")).alias(f"{n}_diff") for c, n in (("auroc", "auroc"), ("brier_score", "brier"), ("oe_ratio", "oe"), ("net_benefit", "net_benefit"), ("discrimination_slope", "discrimination_slope")))).withColumn("clinically_meaningful", F.abs("auroc_diff") >= 0.05)
    return {"measures": joined, "risk": discrimination.risk_distribution(df, attributes), "histogram": discrimination.risk_histogram(df, attributes), "decision_curve": thresholds.decision_curve(df, attributes), "calibration": calibration.reliability(df, attributes), "disparities": diffs}


def findings(pack: dict[str, DataFrame]) -> list[str]:
    """Sentences on AUROC differences of 0.05 and more, observed-to-expected off by over 0.2, net benefit differences over 0.05."""
    out = []
    for r in pack["disparities"].orderBy("attribute", F.desc(F.abs("auroc_diff"))).collect():
        if r["clinically_meaningful"]:
            out.append(f"AUROC of {r['attribute']}={r['group']} differs by {r['auroc_diff']:+.3f} from {r['ref_group']}")
        if r["net_benefit_diff"] is not None and abs(r["net_benefit_diff"]) > 0.05:
            out.append(f"net benefit of {r['attribute']}={r['group']} differs by {r['net_benefit_diff']:+.3f} from {r['ref_group']}")
    for r in pack["measures"].where(F.abs(F.col("oe_ratio") - 1) > 0.2).orderBy("attribute", "group").collect():
        out.append(f"{r['attribute']}={r['group']}: observed to expected is {r['oe_ratio']:.2f}")
    return out


def two_tables(df: DataFrame, attributes: Sequence[str], threshold: float = C.THRESHOLD, metrics: Sequence[str] = ("tpr", "fpr", "ppv", "npv"), reference: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The audit as two flat frames: rates with intervals of every group and overall, and disparities of every metric. ``df`` is a standard frame."""
    cells = rates.cells(df, attributes, threshold)
    table = rates.with_intervals(rates.group_rates(cells, metrics), metrics)
    gaps = [disparity.disparities(cells, m, reference) for m in metrics]
    out = gaps[0]
    for g in gaps[1:]:
        out = out.unionByName(g)
    return table, out.withColumn("status", F.upper("status"))


def checklist(results: AuditResults) -> list[dict[str, str]]:
    """Nine criteria as pass, warn or fail."""
    o, g, c = results.overall(), results.governance_recommendation, results.config
    n = o.get("n") or 0
    band = lambda x, good, fair, high=True: "fail" if x is None or (isinstance(x, float) and math.isnan(x)) else "pass" if (x >= good if high else x <= good) else "warn" if (x >= fair if high else x <= fair) else "fail"
    slope = o.get("calibration_slope")
    smallest = min((r["n"] for r in results.collected("classification") if r["attribute"] != C.OVERALL), default=0)
    rows = [("AUROC", band(o.get("auroc"), 0.7, 0.65)), ("Brier score", band(o.get("brier_score"), 0.25, 0.30, False)), ("Calibration slope", "fail" if slope is None else "pass" if C.SLOPE_LOW <= slope <= C.SLOPE_HIGH else "warn"), ("No errors", "pass" if not g["n_errors"] else "fail"), ("Warnings", band(-g["n_warnings"], -1, -3)), ("Justification", "pass" if c.fairness_justification else "fail"), ("Sample size", band(n, 1000, 100)), ("Smallest group", "pass" if smallest >= 30 else "warn"), ("Model identified", "pass" if c.model_name and c.model_version else "warn")]
    return [{"criterion": k, "status": v} for k, v in rows]
