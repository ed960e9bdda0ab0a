"""Reports of an audit. All of them are made from its collected tables, a row a group or curve point."""

from __future__ import annotations

import html
import json
import math
from dataclasses import asdict
from pathlib import Path
from typing import Any
from xml.etree import ElementTree as ET

from ..config import MetricDisplayConfig, OutputPersona, get_label, normalize_persona
from ..constants import OVERALL
from ..plans.audit import AuditResults, checklist, environment

SECTIONS = {"descriptive_stats": ["overview", "table1", "outcome", "profile"], "overall_performance": ["classification", "auroc", "precision", "calibration", "recalibration", "curve_errors", "sweep", "decision_curve", "net_benefit", "classification_ci"], "subgroup_performance": ["rates", "auroc_comparison", "auroc_ci", "subgroup", "disparities"], "fairness_metrics": ["fairness", "fairness_summary", "disparity_index"], "intersectional": ["intersectional"]}


def plain(x: Any) -> Any:
    """JSON-ready: enums by value, tuples as lists, nan and infinity as null."""
    if isinstance(x, dict):
        return {str(getattr(k, "value", k)): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "value") and isinstance(x, str):
        return x.value
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if hasattr(x, "item"):
        return plain(x.item())
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def document(results: AuditResults) -> dict[str, Any]:
    out: dict[str, Any] = {"audit_metadata": results.metadata, "reproducibility": bundle(results), "config": asdict(results.config)}
    for section, names in SECTIONS.items():
        out[section] = {n: results.collected(n) for n in names if n in results.frames}
    return plain(out | {"flags": results.flags, "governance_recommendation": results.governance_recommendation})


def to_json(results: AuditResults, path: str) -> str:
    Path(path).write_text(json.dumps(document(results), indent=2), encoding="utf-8")
    return path


def bundle(results: AuditResults) -> dict[str, Any]:
    return {"environment": results.metadata.get("environment") or environment(), "parameters": {k: results.metadata.get(k) for k in ("bootstrap_ci", "n_bootstrap", "random_seed")}, "threshold": results.threshold, "attributes": [asdict(a) for a in results.attributes]}


def to_reproducibility_bundle(results: AuditResults, path: str) -> str:
    Path(path).write_text(json.dumps(plain(bundle(results)), indent=2), encoding="utf-8")
    return path


def write_tables(results: AuditResults, path: str) -> str:
    """Every section as a Parquet table under ``path``."""
    for name, frame in results.frames.items():
        frame.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    return path


def _show(x: Any) -> str:
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def _table(rows: list[dict[str, Any]], columns: list[str], persona: OutputPersona) -> str:
    head = "".join(f"<th>{html.escape(get_label(c, persona))}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_show(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def _line_chart(rows: list[dict[str, Any]], x: str, y: str, title: str) -> str:
    """One curve as inline SVG with a text alternative."""
    pts = sorted((r[x], r[y]) for r in rows if r.get(x) is not None and r.get(y) is not None and math.isfinite(r[x]))
    if len(pts) < 2:
        return ""
    pts = pts[:: max(1, len(pts) // 400)]
    lo, hi = min(p[1] for p in pts), max(p[1] for p in pts)
    span = hi - lo or 1.0
    path = " ".join(f"{40 + 340 * a:.1f},{210 - 190 * (b - lo) / span:.1f}" for a, b in pts)
    alt = html.escape(f"{title}: from {pts[0][1]:.3f} at {pts[0][0]:.2f} to {pts[-1][1]:.3f} at {pts[-1][0]:.2f}")
    return f'<figure><svg role="img" aria-label="{alt}" viewBox="0 0 400 230" width="400"><polyline fill="none" stroke="#1f5aa6" stroke-width="2" points="{path}"/><line x1="40" y1="210" x2="380" y2="210" stroke="#888"/><line x1="40" y1="20" x2="40" y2="210" stroke="#888"/></svg><figcaption>{html.escape(title)}</figcaption></figure>'


def key_findings(results: AuditResults) -> list[str]:
    o, g = results.overall(), results.governance_recommendation
    auc, oe = o.get("auroc"), o.get("oe_ratio")
    return [
        "Ranking could not be assessed: one outcome only." if auc is None else f"The model ranks a case above a non-case {auc:.0%} of the time.",
        "Average risk could not be compared." if oe is None else f"For each outcome predicted, {oe:.2f} were seen.",
        f"At the threshold {results.threshold:g} it finds {o.get('sensitivity', 0):.0%} of cases and raises {1 - (o.get('specificity') or 0):.0%} false alarms.",
        f"{g['n_warnings']} warnings and {g['n_errors']} errors across {len(results.attributes)} attributes; status {g['status']}.",
    ]


def to_html(results: AuditResults, path: str, persona: OutputPersona | str = OutputPersona.DATA_SCIENTIST, include_optional: bool = False) -> str:
    who = normalize_persona(persona)
    config = MetricDisplayConfig.governance(include_optional) if who is OutputPersona.GOVERNANCE else MetricDisplayConfig.data_scientist()
    o = results.overall()
    shown = config.filter_metrics([k for k, v in o.items() if isinstance(v, float)])
    by_group = lambda name: [r for r in results.collected(name) if r["attribute"] != OVERALL]
    overall_curve = [r for r in results.collected("decision_curve") if r["attribute"] == OVERALL]
    parts = [
        ("Summary", f"<p><strong>{html.escape(results.governance_recommendation['status'])}</strong>: {html.escape(results.governance_recommendation['advisory'])}</p><ul>" + "".join(f"<li>{html.escape(t)}</li>" for t in key_findings(results)) + "</ul>"),
        ("Cohort", _table(results.collected("table1"), ["category", "group", "n", "percentage", "outcome_rate", "rate_ratio"], who)),
        ("Performance", _table([{"metric": get_label(k, who), "value": o[k]} for k in shown], ["metric", "value"], who) + _line_chart(overall_curve, "threshold", "net_benefit", get_label("net_benefit", who))),
        ("Groups", _table(by_group("rates"), ["attribute", "group", "n", "tpr", "fpr", "ppv", "npv", "warning"], who)),
        ("Fairness", _table(results.collected("fairness"), ["attribute", "group", "ref_group", "demographic_parity_ratio", "tpr_diff", "fpr_diff", "equalized_odds_diff"], who)),
        ("Flags", _table(results.flags, ["severity", "category", "attribute", "group", "message"], who)),
        ("Governance", _table(checklist(results), ["criterion", "status"], who) + f"<p>{html.escape(results.governance_recommendation['disclaimer'])}</p>"),
    ]
    if who is OutputPersona.GOVERNANCE:
        parts = [p for p in parts if p[0] in ("Summary", "Performance", "Fairness", "Flags", "Governance")]
    body = "".join(f"<section><h2>{html.escape(t)}</h2>{x}</section>" for t, x in parts)
    title = html.escape(f"Audit of {results.config.model_name}")
    Path(path).write_text(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>body{{font-family:sans-serif;max-width:70em;margin:2em auto}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:.2em .6em}}</style></head><body><h1>{title}</h1>{body}</body></html>', encoding="utf-8")
    return path


def card(results: AuditResults) -> dict[str, Any]:
    """Sections of a model card."""
    c, o = results.config, results.overall()
    return plain({
        "model": {"name": c.model_name, "version": c.model_version, "type": c.model_type},
        "use": {"intended_use": c.intended_use, "population": c.intended_population, "use_case": c.use_case_type},
        "data": {"rows": results.metadata.get("n_rows"), "attributes": [a.name for a in results.attributes]},
        "performance": {k: o.get(k) for k in ("auroc", "brier_score", "calibration_slope", "calibration_intercept", "oe_ratio", "net_benefit", "sensitivity", "specificity", "ppv", "npv")},
        "fairness": {"metric": c.primary_fairness_metric, "justification": c.fairness_justification, "worst": results.collected("fairness_summary")},
        "limits": [f["message"] + ": " + f["details"] for f in results.flags],
        "governance": {k: results.governance_recommendation[k] for k in ("status", "advisory", "disclaimer")},
    })


def to_model_card(results: AuditResults, path: str) -> str:
    """Markdown."""
    lines = [f"# Model card: {results.config.model_name}", ""]
    for section, x in card(results).items():
        lines.append(f"## {section.title()}")
        for k, v in x.items() if isinstance(x, dict) else enumerate(x, 1):
            lines.append(f"- {k}: {json.dumps(v) if isinstance(v, (dict, list)) else '' if v is None else _show(v)}")
        lines.append("")
    Path(path).write_text("\n".join(lines), encoding="utf-8")
    return path


def to_model_card_json(results: AuditResults, path: str) -> str:
    Path(path).write_text(json.dumps(card(results), indent=2), encoding="utf-8")
    return path


def to_model_card_xml(results: AuditResults, path: str) -> str:
    def add(parent: ET.Element, name: str, x: Any) -> None:
        node = ET.SubElement(parent, name)
        if isinstance(x, dict):
            for k, v in x.items():
                add(node, k, v)
        elif isinstance(x, list):
            for v in x:
                add(node, "item", v)
        elif x is not None:
            node.text = _show(x)

    root = ET.Element("modelCard")
    for k, v in card(results).items():
        add(root, k, v)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
    return path


def checkpoint(results: AuditResults) -> list[dict[str, str]]:
    """Nine items that an audit can evaluate by itself: MET, PARTIAL or NOT_EVALUATED."""
    o, rows = results.overall(), results.frames
    say = lambda ok, part=False: "MET" if ok else "PARTIAL" if part else "NOT_EVALUATED"
    items = {"intended use": say(results.config.intended_use), "population": say(results.config.intended_population), "discrimination": say(o.get("auroc") is not None), "calibration": say(o.get("calibration_slope") is not None, o.get("brier_score") is not None), "intervals": say("auroc_ci" in rows), "confusion matrix": say("classification" in rows), "subgroups": say(results.attributes), "subgroup calibration": say("reliability" in rows), "fairness rationale": say(results.config.fairness_justification)}
    return [{"item": k, "status": v} for k, v in items.items()]


def to_checkpoint(results: AuditResults, path: str) -> str:
    Path(path).write_text(json.dumps({"items": checkpoint(results)}, indent=2), encoding="utf-8")
    return path
