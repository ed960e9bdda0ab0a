"""Loading, checking and profiling scored tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .. import constants as C
from ..errors import ColumnNotFoundError, DataValidationError, ReferenceGroupError
from ..logs import get_logger

#: Names under which a sensitive attribute is known, its usual reference group, and why it is audited. Fixed names.
ATTRIBUTE_NAMES: dict[str, tuple[list[str], str | None, str]] = {
    "race": (["race", "ethnicity", "race_eth", "patient_race", "race_cd", "race_ethnicity"], "White", "Monitoring of care equity asks for it."),
    "sex": (["sex", "gender", "patient_sex", "sex_cd", "birth_sex"], "Male", "Prevalence and response to treatment can differ by sex."),
    "age_group": (["age_group", "age_cat", "age_bucket", "age_band", "age_category"], None, "Base risk changes with age."),
    "insurance": (["insurance", "payer", "insurance_type", "coverage", "payer_type", "payer_category"], "Commercial", "Coverage goes with access to care."),
    "language": (["language", "primary_language", "lang", "language_cd", "preferred_language"], "English", "Language barriers change care and its records."),
    "disability": (["disability", "disabled", "disability_status", "functional_status"], "No", "Disability changes access to care and how outcomes are measured."),
}

SCORED_SQL = """
SELECT o_orderkey AS row_id, o_custkey AS cluster_id, c_mktsegment, r_name, o_orderpriority,
       CAST(o_totalprice AS DOUBLE) / CAST(500000.0 AS DOUBLE) AS y_prob,
       CAST((CAST(o_totalprice AS DOUBLE) / CAST(500000.0 AS DOUBLE) + CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE)
             - CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) >= CAST(1.2 AS DOUBLE) AS INT) AS y_true
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored cohort derived from the star schema: row_id, cluster_id, three attributes, y_prob, y_true."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region")}
    return spark.sql(SCORED_SQL.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}"), **tables)


def load(spark: SparkSession, data: DataFrame | pd.DataFrame | str) -> DataFrame:
    """A DataFrame from a Spark or pandas frame or from a ``.parquet`` or ``.csv`` path."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if not isinstance(data, str):
        raise TypeError(f"cannot audit a {type(data).__name__}")
    if data.endswith(".parquet"):
        return spark.read.parquet(data)
    if data.endswith(".csv"):
        return spark.read.csv(data, header=True, inferSchema=True)
    raise DataValidationError(f"unsupported file: {data}; use .parquet or .csv")


def need(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise ColumnNotFoundError(c, df.columns)


def validate(df: DataFrame, prob: str, label: str) -> int:
    """Raise unless the score lies in [0, 1] and the label is 0 or 1, both without null or NaN; the number of rows."""
    need(df, prob, label)
    for c in (prob, label):
        if not isinstance(df.schema[c].dataType, NumericType):
            raise DataValidationError(f"column {c!r} must be numeric", c)
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(p.isNull() | F.isnan(p)).alias("p0"), F.count_if(y.isNull() | F.isnan(y)).alias("y0"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.count_if(~y.isin(0.0, 1.0)).alias("odd")).first()
    if r["p0"] or r["y0"]:
        raise DataValidationError("null or NaN in score or label", prob if r["p0"] else label)
    if r["n"] and (r["lo"] < 0 or r["hi"] > 1):
        raise DataValidationError(f"scores must lie in [0, 1]; they span {r['lo']} to {r['hi']}", prob)
    if r["odd"]:
        raise DataValidationError("labels must be 0 or 1", label)
    if r["n"] < C.WARNING_N:
        get_logger("sources").warning("only %d rows", r["n"])
    return r["n"]


def validate_upload(df: DataFrame) -> list[str]:
    """Errors of a table that must have ``y_true`` and ``y_prob`` or ``y_pred`` by name."""
    errors = []
    if "y_true" not in df.columns:
        errors.append("missing column: y_true")
    if not {"y_prob", "y_pred"} & set(df.columns):
        errors.append("missing column: y_prob or y_pred")
    if errors:
        return errors
    checks = [F.count(F.lit(1)).alias("n"), F.count_if(~F.col("y_true").isin(0, 1) | F.col("y_true").isNull()).alias("y")]
    if "y_prob" in df.columns:
        checks.append(F.count_if(~F.col("y_prob").between(0, 1) | F.col("y_prob").isNull()).alias("p"))
    r = df.agg(*checks).first().asDict()
    if not r["n"]:
        errors.append("the table is empty")
    if r["y"]:
        errors.append("y_true must be 0 or 1")
    if r.get("p"):
        errors.append("y_prob must lie in [0, 1]")
    return errors


def attribute_profile(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """attribute, n_unique, n_missing, missing_rate of each attribute, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in attributes:
        aggs += [F.count_distinct(a).alias(f"u_{a}"), F.count_if(F.col(a).isNull()).alias(f"m_{a}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"u_{a}").alias("n_unique"), F.col(f"m_{a}").alias("n_missing"), F.coalesce(F.try_divide(F.col(f"m_{a}").cast("double"), F.col("n")), F.lit(0.0)).alias("missing_rate")) for a in attributes)))
    return wide.select(rows.alias("r")).select("r.*")


def suggest_attributes(df: DataFrame, first: int = 10) -> list[dict[str, Any]]:
    """Suggested sensitive attributes by column name, with their first values, number of values and missing rate."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    found = [(name, by_name[hit], ref, why) for name, (names, ref, why) in ATTRIBUTE_NAMES.items() if (hit := next((n for n in names if n in by_name), None))]
    if not found:
        return []
    profile = {r["attribute"]: r for r in attribute_profile(df, [c for _, c, _, _ in found]).collect()}
    out = []
    for name, c, ref, why in found:
        values = [r[0] for r in df.select(c).dropna().distinct().orderBy(c).limit(first).collect()]
        out.append({"suggested_name": name, "detected_column": c, "unique_values": values, "n_unique": profile[c]["n_unique"], "missing_rate": profile[c]["missing_rate"], "suggested_reference": ref if ref in values else None, "clinical_justification": why})
    return out


def display_suggestions(suggestions: list[dict[str, Any]]) -> str:
    if not suggestions:
        return "No sensitive attributes were detected by name."
    lines = ["Suggested sensitive attributes"]
    for i, s in enumerate(suggestions, 1):
        lines.append(f"[{i}] {s['suggested_name']} (column {s['detected_column']}): {s['n_unique']} values, {s['missing_rate']:.1%} missing, reference {s['suggested_reference'] or 'largest group'}")
        lines.append("    " + ", ".join(map(str, s["unique_values"])))
    return "\n".join(lines)


def validate_attribute(df: DataFrame, name: str, column: str, reference: str | None = None, categories: Sequence[str] | None = None) -> list[str]:
    """Issues of an attribute: missing column, reference or categories, much missing, small groups."""
    if column not in df.columns:
        return [f"{name}: column {column!r} not found"]
    counts = {r[0]: r[1] for r in df.groupBy(F.col(column).cast("string")).count().collect()}  # a row a group
    total, issues = sum(counts.values()), []
    if reference is not None and str(reference) not in counts:
        issues.append(f"{name}: reference {reference!r} not found")
    if categories and (gone := sorted(set(map(str, categories)) - {str(k) for k in counts})):
        issues.append(f"{name}: categories not found: {', '.join(gone)}")
    if total and counts.get(None, 0) / total > C.MAX_MISSING:
        issues.append(f"{name}: {counts[None] / total:.1%} missing")
    issues += [f"{name}: group {g!r} has {n} rows" for g, n in sorted(counts.items(), key=lambda x: str(x[0])) if n < C.SUBGROUP_N]
    return issues


def reference_group(df: DataFrame, column: str, suggested: str | None = None) -> str:
    """The suggested group if it occurs, else the largest (ties: first by name); nulls never win."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("g")).count()
    if suggested is not None and not sizes.where(F.col("g") == str(suggested)).isEmpty():
        return str(suggested)
    top = sizes.orderBy(F.desc("count"), "g").first()
    if top is None:
        raise ReferenceGroupError(str(suggested), [])
    return top["g"]


def unique_groups(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("group")).dropna().distinct().orderBy("group")


def data_summary(df: DataFrame, attributes: Sequence[str], prob: str = "y_prob", label: str = "y_true") -> DataFrame:
    """attribute, group, n, outcome_rate, mean_score, largest groups first."""
    long = df.select(F.col(label).alias("y"), F.col(prob).alias("p"), F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes))).alias("g"))
    return long.groupBy("g.attribute", "g.group").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("outcome_rate"), F.avg("p").alias("mean_score")).orderBy("attribute", F.desc("n"), "group")


def generate_cohort(spark: SparkSession, n: int = 2000, seed: int = 42, disparity: float = 0.08, threshold: float = 0.5) -> DataFrame:
    """A synthetic scored cohort of any size, made by Spark from a seed: demographics, outcome, score, prediction."""

    def draw(name: str, values: list[str], weights: list[float], k: int):
        out, expr = F.lit(values[-1]), None
        u = F.rand(seed + k)
        cum = [sum(weights[: i + 1]) for i in range(len(values))]
        for v, c in list(zip(values, cum, strict=True))[:-1]:
            expr = F.when(F.col(f"u_{name}") < c, v) if expr is None else expr.when(F.col(f"u_{name}") < c, v)
        return u, expr.otherwise(out)

    spec = {"race": (["White", "Black", "Hispanic", "Asian", "Other"], [0.55, 0.2, 0.15, 0.06, 0.04]), "sex": (["Male", "Female"], [0.52, 0.48]), "age_group": (["18-44", "45-64", "65-79", "80+"], [0.2, 0.3, 0.33, 0.17]), "insurance": (["Commercial", "Medicare", "Medicaid", "Uninsured"], [0.4, 0.35, 0.18, 0.07]), "language": (["English", "Spanish", "Other"], [0.82, 0.12, 0.06])}
    df = spark.range(n)
    for k, (name, (values, weights)) in enumerate(spec.items()):
        u, expr = draw(name, values, weights, k)
        df = df.withColumn(f"u_{name}", u).withColumn(name, expr).drop(f"u_{name}")
    age = F.when(F.col("age_group") == "80+", 2.0).when(F.col("age_group") == "65-79", 1.4).when(F.col("age_group") == "45-64", 0.9).otherwise(0.5)
    df = df.withColumn("base", F.greatest(F.lit(0.02), F.least(F.lit(0.5), 0.15 * age))).withColumn("y_true", (F.rand(seed + 20) < F.col("base")).cast("int"))
    shift = F.when((F.col("y_true") == 1) & F.col("race").isin("Black", "Hispanic"), -disparity * 0.4).otherwise(0.0)
    score = F.when(F.col("y_true") == 1, 0.70 + 0.15 * F.randn(seed + 21)).otherwise(0.25 + 0.12 * F.randn(seed + 21)) + shift
    return df.withColumn("y_prob", F.greatest(F.lit(0.01), F.least(F.lit(0.99), score))).withColumn("y_pred", (F.col("y_prob") >= threshold).cast("int")).drop("base").withColumnRenamed("id", "patient_id")
