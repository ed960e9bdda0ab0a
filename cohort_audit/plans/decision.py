"""Which fairness metric suits which use of a model."""

from __future__ import annotations

from typing import Any

from ..config import FairnessMetric as M
from ..config import UseCaseType as U

#: use case: (recommended, alternatives, ill-suited, reason)
OPTIONS: dict[U, tuple[M, list[M], list[M], str]] = {
    U.INTERVENTION_TRIGGER: (M.EQUALIZED_ODDS, [M.EQUAL_OPPORTUNITY], [M.DEMOGRAPHIC_PARITY], "An alarm that leads to action should find cases, and miss the mark, equally often in all groups."),
    U.RISK_COMMUNICATION: (M.CALIBRATION, [M.PREDICTIVE_PARITY], [M.DEMOGRAPHIC_PARITY], "A stated risk should mean the same in all groups."),
    U.RESOURCE_ALLOCATION: (M.DEMOGRAPHIC_PARITY, [M.EQUALIZED_ODDS], [], "Access to a scarce resource should not depend on the group; whether need differs is for the institution to judge."),
    U.SCREENING: (M.EQUAL_OPPORTUNITY, [M.EQUALIZED_ODDS], [M.CALIBRATION], "A case should have the same chance of being found in all groups."),
    U.DIAGNOSIS_SUPPORT: (M.PREDICTIVE_PARITY, [M.CALIBRATION], [M.DEMOGRAPHIC_PARITY], "A positive finding should be right equally often in all groups."),
}
#: metric: (definition, when it suits, its limit)
DESCRIPTIONS: dict[M, tuple[str, str, str]] = {
    M.DEMOGRAPHIC_PARITY: ("equal selection rates", "allocation of resources", "ignores different base rates"),
    M.EQUALIZED_ODDS: ("equal true and false positive rates", "alarms that trigger action", "can lower accuracy in some group"),
    M.EQUAL_OPPORTUNITY: ("equal true positive rates", "screening", "says nothing on false alarms"),
    M.PREDICTIVE_PARITY: ("equal positive predictive values", "support of a diagnosis", "allows different detection rates"),
    M.CALIBRATION: ("equal meaning of a stated risk", "communication of risk", "allows different error rates"),
}
TRADEOFFS: dict[frozenset, str] = {
    frozenset({M.DEMOGRAPHIC_PARITY, M.EQUALIZED_ODDS}): "Where base rates differ, equal selection rates force unequal error rates.",
    frozenset({M.EQUALIZED_ODDS, M.CALIBRATION}): "Where base rates differ, a calibrated score cannot have equal error rates unless it is perfect.",
    frozenset({M.EQUAL_OPPORTUNITY, M.PREDICTIVE_PARITY}): "Where base rates differ, equal detection mostly means unequal precision.",
}
IMPOSSIBILITY = "Where groups differ in prevalence, no imperfect model can at once have equal selection rates, equal error rates, equal predictive values and calibration in all groups. Choose the criterion that fits the use, and record why."


def metric_options(use_case: U | str | None = None, context: str | None = None) -> dict[str, Any]:
    """The recommendation for a use case, or all of them; the choice stays with the user."""
    if use_case is None:
        return {"use_case": None, "options": {u.value: o[0].value for u, o in OPTIONS.items()}, "impossibility": IMPOSSIBILITY}
    u = U(use_case)
    best, others, bad, why = OPTIONS[u]
    return {"use_case": u.value, "recommended": best, "rationale": why, "alternatives": others, "contraindicated": bad, "context": context, "impossibility": IMPOSSIBILITY}


def compare_metrics(a: M | str, b: M | str) -> dict[str, Any]:
    a, b = M(a), M(b)
    said = TRADEOFFS.get(frozenset({a, b}))
    return {"metrics": [a.value, b.value], "tradeoff": said or "No trade-off of this pair is documented here.", "documented": said is not None}


def describe_metric(metric: M | str) -> dict[str, str]:
    m = M(metric)
    return dict(zip(("metric", "definition", "suits", "limit"), (m.value, *DESCRIPTIONS[m]), strict=True))


def decision_text() -> str:
    lines = ["Fairness metric by use case"]
    for u, (best, others, _bad, why) in OPTIONS.items():
        lines += [f"- {u.value}: {best.value} (or {', '.join(o.value for o in others)})", f"    {why}"]
    return "\n".join([*lines, "", IMPOSSIBILITY])
