"""Interval estimators, tests on counts and verbal bands as Column expressions.

Every division is guarded, so they hold under ANSI mode. Each function's docstring gives the value without trials.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..constants import Z
from . import special


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def z_of(alpha: float) -> float:
    return Z if alpha == 0.05 else special.normal_ppf(1 - alpha / 2)


def ratio(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, ``default`` where b is 0 or less."""
    a, b = col(a), col(b)
    return F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))).otherwise(F.lit(default).cast("double"))


def _wilson(s: Column, n: Column, z: float) -> tuple[Column, Column]:
    s, n = s.cast("double"), n.cast("double")
    p = F.try_divide(s, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    c = F.try_divide(p + F.try_divide(F.lit(z * z / 2), n), d)
    m = F.try_divide(F.lit(z), d) * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z / 4), n), n))
    return c - m, c + m


def wilson(s: Column | str, n: Column | str, alpha: float = 0.05, empty: tuple[float | None, float | None] = (None, None)) -> tuple[Column, Column]:
    """Wilson score interval with closed forms at 0 and n successes; ``empty`` without trials (null by default)."""
    s, n, z = col(s), col(n), z_of(alpha)
    lo, hi = _wilson(s, n, z)
    z2 = F.lit(z * z)
    nd = n.cast("double")
    low = F.when(n <= 0, F.lit(empty[0]).cast("double")).when(s == 0, F.lit(0.0)).when(s == n, F.try_divide(nd, nd + z2)).otherwise(F.greatest(F.lit(0.0), lo))
    high = F.when(n <= 0, F.lit(empty[1]).cast("double")).when(s == 0, F.try_divide(z2, nd + z2)).when(s == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), hi))
    return low, high


def wilson_unit(s: Column | str, n: Column | str, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson interval that is (0, 1) without trials."""
    return wilson(s, n, 1 - confidence if confidence != 0.95 else 0.05, (0.0, 1.0))


def wilson_plain(s: Column | str, n: Column | str, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval without closed forms at the ends, (0, 0) without trials."""
    s, n = col(s), col(n)
    lo, hi = _wilson(s, n, z_of(alpha))
    zero = F.lit(0.0)
    return F.when(n <= 0, zero).otherwise(F.greatest(zero, lo)), F.when(n <= 0, zero).otherwise(F.least(F.lit(1.0), hi))


def newcombe(s1: Column | str, n1: Column | str, s2: Column | str, n2: Column | str, alpha: float = 0.05, empty: tuple[float | None, float | None] = (None, None)) -> tuple[Column, Column]:
    """Hybrid score interval of p1 - p2, clipped to [-1, 1]; ``empty`` if an arm has no trials."""
    (l1, u1), (l2, u2) = wilson(s1, n1, alpha), wilson(s2, n2, alpha)
    p1, p2 = ratio(s1, n1, None), ratio(s2, n2, None)
    d = p1 - p2
    lo = d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    hi = d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    none = (col(n1) <= 0) | (col(n2) <= 0)
    return F.when(none, F.lit(empty[0]).cast("double")).otherwise(F.greatest(F.lit(-1.0), lo)), F.when(none, F.lit(empty[1]).cast("double")).otherwise(F.least(F.lit(1.0), hi))


def katz(s1: Column | str, n1: Column | str, s2: Column | str, n2: Column | str, alpha: float = 0.05) -> tuple[Column, Column]:
    """Log interval of p1 / p2; an arm of no or only successes is corrected by a half; null if an arm has no trials."""

    def corrected(s: Column, n: Column) -> tuple[Column, Column]:
        end = (s == 0) | (s == n)
        return F.when(end, s + 0.5).otherwise(s.cast("double")), F.when(end, n + 1.0).otherwise(n.cast("double"))

    (a, m), (b, k) = corrected(col(s1), col(n1)), corrected(col(s2), col(n2))
    p1, p2 = F.try_divide(a, m), F.try_divide(b, k)
    log = F.ln(F.try_divide(p1, p2))
    se = F.sqrt(F.try_divide(1 - p1, a) + F.try_divide(1 - p2, b))
    none = (col(n1) <= 0) | (col(n2) <= 0)
    z = z_of(alpha)
    return F.when(~none, F.exp(log - z * se)), F.when(~none, F.exp(log + z * se))


def z_statistic(s1: Column | str, n1: Column | str, s2: Column | str, n2: Column | str) -> Column:
    """Pooled z of p2 - p1; 0 if an arm is empty or the pooled error is 0."""
    s1, n1, s2, n2 = (col(x).cast("double") for x in (s1, n1, s2, n2))
    p = F.try_divide(s1 + s2, n1 + n2)
    se = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), F.try_divide(F.try_divide(s2, n2) - F.try_divide(s1, n1), se)).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def p_of_z(z: pd.Series) -> pd.Series:
    """Two-sided p of a z statistic (on aggregated rows)."""
    return z.map(special.two_sided_p)


@F.pandas_udf(StructType().add("lower", DoubleType()).add("upper", DoubleType()))
def clopper_pearson(s: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95 % binomial interval (on aggregated rows)."""
    return pd.DataFrame([special.clopper_pearson(int(a), int(b)) for a, b in zip(s, n, strict=True)], columns=["lower", "upper"])


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_sf(float(a), float(b)) if b > 0 else 1.0 for a, b in zip(x, dof, strict=True)])


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([special.fisher_exact(*map(int, t)) for t in zip(a, b, c, d, strict=True)])


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([special.ks_p(float(x), int(a), int(b)) for x, a, b in zip(d, n1, n2, strict=True)])


@F.pandas_udf(DoubleType())
def ks_asymptotic_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([special.ks_asymptotic(float(x), int(a), int(b)) for x, a, b in zip(d, n1, n2, strict=True)])


def impact_decision(lower: Column, upper: Column, threshold: float = 0.8) -> Column:
    """What an interval of the ratio says about the four-fifths rule."""
    none = lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper)
    return F.when(none, "insufficient_data").when(upper < threshold, "violation_supported").when(lower >= threshold, "compliant").otherwise("inconclusive")


def ladder(x: Column, limits: list[tuple[float, str]], above: str) -> Column:
    """The name of the first limit that x is below; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(x < limit, name)
    return out.otherwise(above)


def auroc_band(x: Column) -> Column:
    return ladder(x, [(0.6, "Failed discrimination (no better than chance)"), (0.7, "Poor discrimination"), (0.8, "Acceptable discrimination"), (0.9, "Good discrimination")], "Excellent discrimination")


def auroc_diff_band(x: Column) -> Column:
    return ladder(F.abs(x), [(0.02, "negligible"), (0.05, "small"), (0.1, "moderate")], "large")


def auroc_range_band(x: Column) -> Column:
    return ladder(x, [(0.05, "LOW"), (0.1, "MODERATE"), (0.15, "HIGH")], "SEVERE")


def index_band(x: Column) -> Column:
    return ladder(x, [(0.25, "LOW"), (0.5, "MODERATE"), (0.75, "HIGH")], "SEVERE")


def cramers_band(x: Column) -> Column:
    return ladder(x, [(0.1, "negligible"), (0.2, "small"), (0.4, "medium")], "large")


def net_benefit_band(x: Column) -> Column:
    return ladder(x, [(0.5, "Limited clinical utility"), (0.7, "Moderate clinical utility"), (0.9, "Good clinical utility")], "Excellent clinical utility")


def sample_status(n: Column, n_positive: Column | None = None) -> Column:
    """Ladder by n first, then by the rarer outcome."""
    out = F.when(n < 10, "VERY_LOW").when(n < 30, "LOW").when(n < 50, "MODERATE")
    if n_positive is not None:
        rare = F.least(n_positive, n - n_positive)
        out = out.when(rare < 5, "LOW").when(rare < 10, "MODERATE")
    return out.otherwise("ADEQUATE")


def sample_adequacy(n: Column, n_positive: Column | None = None, n_negative: Column | None = None) -> Column:
    """Ladder by the outcomes before the larger limits of n."""
    out = F.when(n < 10, "VERY_LOW")
    for x in (n_positive, n_negative):
        if x is not None:
            out = out.when(x < 5, "VERY_LOW")
    for x in (n_positive, n_negative):
        if x is not None:
            out = out.when(x < 10, "LOW")
    return out.when(n < 30, "LOW").when(n < 50, "MODERATE").otherwise("ADEQUATE")


def sample_warning(group: Column, n: Column, status: Column) -> Column:
    return F.when(status == "VERY_LOW", F.format_string("%s: only %d rows, estimates are unreliable", group.cast("string"), n)).when(status == "LOW", F.format_string("%s: %d rows or few outcomes, read with caution", group.cast("string"), n)).when(status == "MODERATE", F.format_string("%s: %d rows, intervals are wide", group.cast("string"), n))
