"""Command line: ``python -m cohort_audit.cli audit DATA --pred p --target y --attribute race -o report.html``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import FairnessConfig, FairnessMetric
from .plans.audit import Audit, environment
from .reports import render

WRITERS = {"json": render.to_json, "html": render.to_html, "md": render.to_model_card, "xml": render.to_model_card_xml, "card": render.to_model_card_json, "bundle": render.to_reproducibility_bundle, "checkpoint": render.to_checkpoint, "parquet": render.write_tables}


def session() -> SparkSession:
    return SparkSession.builder.appName("cohort_audit").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("cohort_audit")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit")
    a.add_argument("data")
    a.add_argument("--pred", required=True)
    a.add_argument("--target", required=True)
    a.add_argument("-o", "--output")
    a.add_argument("-f", "--format", choices=sorted(WRITERS))
    a.add_argument("--threshold", type=float, default=0.5)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--model-name", default="model")
    a.add_argument("-a", "--attribute", action="append", default=[])
    a.add_argument("--persona", default="data_scientist")
    a.add_argument("--include-optional", action="store_true")
    sub.add_parser("version")
    sub.add_parser("info")
    args = parser.parse_args(argv)
    if args.command == "version":
        print("cohort_audit 0.1.0")
        return 0
    if args.command == "info":
        print(environment())
        return 0
    config = FairnessConfig(args.model_name, primary_fairness_metric=FairnessMetric.EQUALIZED_ODDS, fairness_justification="Default of the command line.")
    audit = Audit(spark or session(), args.data, args.pred, args.target, config, args.threshold)
    names = {s["suggested_name"] for s in audit.suggestions}
    for name in args.attribute:
        audit.accept_suggested_attributes([name]) if name in names else audit.add_sensitive_attribute(name)
    if not args.attribute:
        audit.accept_suggested_attributes(list(range(1, 1 + min(3, len(audit.suggestions)))))
    results = audit.run(random_seed=args.seed)
    print(results.summary())
    if args.output:
        kind = args.format or args.output.rsplit(".", 1)[-1]
        if kind not in WRITERS:
            parser.error(f"unknown format: {kind}")
        WRITERS[kind](results, args.output, **({"persona": args.persona, "include_optional": args.include_optional} if kind == "html" else {}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
