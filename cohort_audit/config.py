"""Configuration of an audit, which measures it shows, and what they are called."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from . import constants as C


class OutputPersona(str, Enum):
    DATA_SCIENTIST = "data_scientist"
    GOVERNANCE = "governance"


class ModelType(str, Enum):
    BINARY_CLASSIFIER = "binary_classifier"
    RISK_SCORE = "risk_score"


class UseCaseType(str, Enum):
    INTERVENTION_TRIGGER = "intervention_trigger"
    RISK_COMMUNICATION = "risk_communication"
    RESOURCE_ALLOCATION = "resource_allocation"
    SCREENING = "screening"
    DIAGNOSIS_SUPPORT = "diagnosis_support"


class FairnessMetric(str, Enum):
    DEMOGRAPHIC_PARITY = "demographic_parity"
    EQUALIZED_ODDS = "equalized_odds"
    EQUAL_OPPORTUNITY = "equal_opportunity"
    PREDICTIVE_PARITY = "predictive_parity"
    CALIBRATION = "calibration"


#: Classes of measures by how far a published guideline supports them. Fixed values.
RECOMMENDED = ("auroc", "calibration_plot", "net_benefit", "standardized_net_benefit", "decision_curve", "risk_distribution_plot")
OPTIONAL = ("discrimination_slope", "oe_ratio", "calibration_intercept", "calibration_slope", "ici", "eci", "ece", "brier_score", "brier_scaled", "loglikelihood", "logloss", "mcfadden_r2", "cox_snell_r2", "nagelkerke_r2", "sensitivity", "specificity", "ppv", "npv")
CAUTION = ("auprc", "partial_auroc", "mape", "accuracy", "balanced_accuracy", "youden_index", "f1_score", "mcc", "dor", "kappa")


def metric_category(metric: str) -> str:
    return "RECOMMENDED" if metric in RECOMMENDED else "OPTIONAL" if metric in OPTIONAL else "CAUTION" if metric in CAUTION else "UNKNOWN"


@dataclass(frozen=True)
class MetricDisplayConfig:
    """Which classes of measures a reader sees."""

    persona: OutputPersona = OutputPersona.DATA_SCIENTIST
    show_optional: bool = True
    show_caution: bool = False

    @classmethod
    def governance(cls, include_optional: bool = False) -> MetricDisplayConfig:
        return cls(OutputPersona.GOVERNANCE, include_optional, False)

    @classmethod
    def data_scientist(cls, include_optional: bool = True) -> MetricDisplayConfig:
        return cls(OutputPersona.DATA_SCIENTIST, include_optional, include_optional)

    def should_show(self, metric: str) -> bool:
        kind = metric_category(metric)
        return {"RECOMMENDED": True, "OPTIONAL": self.show_optional, "CAUTION": self.show_caution}.get(kind, self.persona is OutputPersona.DATA_SCIENTIST)

    def filter_metrics(self, metrics: Sequence[str]) -> list[str]:
        return [m for m in metrics if self.should_show(m)]


def sort_by_priority(metrics: Sequence[str], priority: Sequence[str] = RECOMMENDED + OPTIONAL + CAUTION) -> list[str]:
    rank = {m: i for i, m in enumerate(priority)}
    return sorted(metrics, key=lambda m: rank.get(m, len(rank)))


#: metric: (technical name, plain name, plain description)
LABELS: dict[str, tuple[str, str, str]] = {
    "auroc": ("AUROC", "Ranking accuracy", "How often a patient with the outcome scores above one without"),
    "calibration_slope": ("Calibration slope", "Spread of risks", "Whether high and low risks are too extreme"),
    "calibration_intercept": ("Calibration-in-the-large", "Average bias of risks", "Whether risks are too high or too low on average"),
    "brier_score": ("Brier score", "Prediction error", "Mean squared distance of risk and outcome"),
    "oe_ratio": ("O:E ratio", "Observed against expected", "Outcomes seen for each one predicted"),
    "net_benefit": ("Net benefit", "Usefulness", "True alarms less false alarms at their price"),
    "tpr": ("Sensitivity (TPR)", "Detection rate", "Share of cases that are flagged"),
    "fpr": ("False positive rate", "False alarm rate", "Share of non-cases that are flagged"),
    "ppv": ("PPV", "Alarm accuracy", "Share of flagged patients that are cases"),
    "npv": ("NPV", "All-clear accuracy", "Share of unflagged patients that are not cases"),
    "selection_rate": ("Selection rate", "Share flagged", "Share of patients that are flagged"),
    "demographic_parity": ("Demographic parity", "Equal flag rates", "Groups are flagged equally often"),
    "equalized_odds": ("Equalized odds", "Equal error rates", "Detection and false alarms are alike"),
}
AXES = {"roc": ("False positive rate", "True positive rate", "False alarms", "Cases found"), "calibration": ("Predicted probability", "Observed proportion", "Predicted risk", "What happened"), "decision_curve": ("Threshold probability", "Net benefit", "Risk at which to act", "Usefulness")}


def get_label(metric: str, persona: OutputPersona = OutputPersona.DATA_SCIENTIST, kind: str = "name") -> str:
    tech, plain, text = LABELS.get(metric, (metric.replace("_", " ").title(),) * 3)
    return text if kind == "description" else plain if persona is OutputPersona.GOVERNANCE else tech


def axis_labels(plot: str, persona: OutputPersona = OutputPersona.DATA_SCIENTIST) -> tuple[str, str]:
    a = AXES.get(plot, ("x", "y", "x", "y"))
    return a[2:] if persona is OutputPersona.GOVERNANCE else a[:2]


def normalize_persona(persona: OutputPersona | str) -> OutputPersona:
    if isinstance(persona, OutputPersona):
        return persona
    names = {"data_scientist": 0, "full": 0, "technical": 0, "ds": 0, "governance": 1, "executive": 1, "summary": 1}
    if persona.lower() not in names:
        raise ValueError(f"unknown persona: {persona}")
    return list(OutputPersona)[names[persona.lower()]]


@dataclass
class SensitiveAttribute:
    name: str
    column: str
    reference: str | None = None
    categories: list[str] | None = None
    clinical_justification: str | None = None
    is_custom: bool = False


@dataclass
class FairnessConfig:
    model_name: str
    model_version: str = "1.0.0"
    model_type: ModelType = ModelType.BINARY_CLASSIFIER
    primary_fairness_metric: FairnessMetric | None = None
    fairness_justification: str | None = None
    use_case_type: UseCaseType | None = None
    intended_use: str | None = None
    intended_population: str | None = None
    decision_thresholds: list[float] = field(default_factory=lambda: [C.THRESHOLD])
    thresholds: dict[str, Any] = field(default_factory=lambda: {"min_subgroup_n": C.SUBGROUP_N, "demographic_parity_ratio": C.DP_RATIO, "equalized_odds_diff": C.EO_DIFF, "calibration_diff": C.CALIBRATION_DIFF, "min_auroc": C.MIN_AUROC, "max_missing_rate": C.MAX_MISSING})
    extra: dict[str, Any] = field(default_factory=dict)

    def validate(self) -> list[tuple[str, str]]:
        """(ERROR or WARNING, message) of what is missing."""
        need = [("ERROR", self.primary_fairness_metric, "a primary fairness metric"), ("ERROR", self.fairness_justification, "a justification of the fairness metric"), ("WARNING", self.intended_use, "the intended use"), ("WARNING", self.intended_population, "the intended population"), ("WARNING", self.use_case_type, "the use case")]
        return [(level, f"{what} is missing") for level, value, what in need if not value]

    def has_errors(self) -> bool:
        return any(level == "ERROR" for level, _ in self.validate())

    def get_threshold(self, key: str, default: Any = None) -> Any:
        return self.thresholds.get(key, default)
