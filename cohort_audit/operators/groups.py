"""Grouping of scored rows by many attributes at once, and the reference row of each attribute."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import OVERALL

#: Score ranges that split an ordered histogram, so that no task holds all scores of a group. Sums over ranges cost a row a range and
#: group, windows inside a range hold a share of about 1 / RANGES of a group's distinct scores.
RANGES = 8192


def standard(df: DataFrame, prob: str = "y_prob", label: str = "y_true", attributes: Sequence[str] = (), cluster: str | None = None) -> DataFrame:
    """The columns an operator needs: ``p``, ``y``, the attributes as strings, and ``cluster``."""
    cols = [F.col(prob).cast("double").alias("p"), F.col(label).cast("int").alias("y"), *(F.col(a).cast("string").alias(a) for a in attributes)]
    return df.select(*cols, *([F.col(cluster).cast("string").alias("cluster")] if cluster else []))


def grouped(df: DataFrame, attributes: Sequence[str], aggs: Sequence[Column], overall: bool = True, sets: Sequence[Sequence[str]] | None = None, separator: str = " x ") -> DataFrame:
    """attribute, group and the aggregates for every group of every attribute, in one GROUPING SETS aggregation.

    ``sets`` replaces the single attributes (for intersections); a group with a null part is left out.
    """
    sets = [[a] for a in attributes] if sets is None else [list(s) for s in sets]
    sets = sets + [[]] if overall else sets
    if not any(sets):
        return df.agg(*aggs).select(F.lit(OVERALL).alias("attribute"), F.lit(OVERALL).alias("group"), "*")
    keys = list(dict.fromkeys(a for s in sets for a in s))
    marks = [F.grouping(a).alias(f"__{a}") for a in keys]
    out = df.groupingSets([[F.col(a) for a in s] for s in sets], *map(F.col, keys)).agg(*marks, *aggs)

    def here(s: Sequence[str]) -> Column:
        cond = F.lit(True)
        for a in keys:
            cond = cond & (F.col(f"__{a}") == (0 if a in s else 1))
        return cond

    attribute, group = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in sets:
        attribute = F.when(here(s), F.lit(separator.join(s) or OVERALL)).otherwise(attribute)
        group = F.when(here(s), F.concat(*(x for i, a in enumerate(s) for x in ([F.lit(separator)] if i else []) + [F.col(a)])) if s else F.lit(OVERALL)).otherwise(group)
    named = out.withColumn("attribute", attribute).withColumn("group", group).where(F.col("group").isNotNull())
    return named.select("attribute", "group", *(c for c in out.columns if c not in keys and not (c.startswith("__") and c[2:] in keys)))


def pairs(attributes: Sequence[str]) -> list[list[str]]:
    return [list(c) for c in combinations(attributes, 2)]


def long(df: DataFrame, attributes: Sequence[str], *keep: str, overall: bool = True) -> DataFrame:
    """One row for each row and attribute: attribute, group and the columns to keep; null groups are left out."""
    entries = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes]
    if overall:
        entries.append(F.struct(F.lit(OVERALL).alias("attribute"), F.lit(OVERALL).alias("group")))
    return df.select(*keep, F.explode(F.array(*entries)).alias("g")).select("g.attribute", "g.group", *keep).where(F.col("group").isNotNull())


def histogram(df: DataFrame, attributes: Sequence[str], overall: bool = True) -> DataFrame:
    """attribute, group, p, n (rows), k (positives): the distinct scores of each group."""
    rows = df.groupBy("p", *attributes).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")) if attributes else df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    return long(rows, attributes, "p", "n", "k", overall=overall).groupBy("attribute", "group", "p").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def score_range(p: Column) -> Column:
    """Range of a score by its log odds: scores crowded near 0 or 1 fall into many ranges too."""
    eps = 2.0**-40
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.floor((F.ln((inside + eps) / (1 - inside + eps)) + 28) * (RANGES / 56)).cast("int")


def value_range(x: Column) -> Column:
    """Range of any number, by its logarithm on both sides of 0."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * 1024).cast("int")


def running(hist: DataFrame, columns: Sequence[str] = ("n", "k"), descending: bool = False, value: str = "p", keys: Sequence[str] = ("attribute", "group"), ranges: Callable[[Column], Column] = score_range) -> DataFrame:
    """``hist`` with ``before_<c>``, the sum of c over a group's earlier values, and ``total_<c>``, its sum over the group.

    Sums come in two levels, over ranges of the value and within a range, so no task needs all values of a group.
    """
    keys = list(keys)
    order = F.desc if descending else F.asc
    ranged = hist.withColumn("range", ranges(F.col(value)))
    sums = ranged.groupBy(*keys, "range").agg(*(F.sum(c).alias(f"of_{c}") for c in columns))
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(order("range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = sums.select(*keys, "range", *((F.sum(f"of_{c}").over(w) - F.col(f"of_{c}")).alias(f"base_{c}") for c in columns), *(F.sum(f"of_{c}").over(whole).alias(f"total_{c}") for c in columns))
    v = Window.partitionBy(*keys, "range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.select("*", *((F.sum(c).over(v) - F.col(c)).alias(f"within_{c}") for c in columns))
    return within.join(base, [*keys, "range"]).select(*hist.columns, *((F.col(f"base_{c}") + F.col(f"within_{c}")).alias(f"before_{c}") for c in columns), *(f"total_{c}" for c in columns))


def moments(hist: DataFrame, keys: Sequence[str], value: str = "p") -> DataFrame:
    """The keys, n, mean, population deviation, least and greatest of values counted in ``n``, from the counts alone.

    Squares are taken about the mean in a second step, so that large offsets lose no digits.
    """
    keys = list(keys)
    whole = hist.groupBy(*keys).agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col(value)), F.sum("n").cast("double")).alias("mean"))
    rows = hist.join(F.broadcast(whole), keys)  # a row a group
    d = F.col(value) - F.col("mean")
    return rows.groupBy(*keys).agg(F.max("total").alias("n"), F.max("mean").alias("mean"), F.sqrt(F.try_divide(F.sum(F.col("n") * d * d), F.max("total").cast("double"))).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def quantiles(hist: DataFrame, probabilities: Sequence[float], value: str = "p", keys: Sequence[str] = ("attribute", "group"), ranges: Callable[[Column], Column] = score_range) -> DataFrame:
    """The keys and ``q``, exact quantiles (linear between neighbours) of values counted in ``n``, from running sums."""
    run = running(hist, ("n",), value=value, keys=keys, ranges=ranges)
    places = [(F.col("total_n") - 1) * F.lit(float(x)) for x in probabilities]

    def at(i: Column) -> Column:  # the value of place i is the last one with no more rows before it
        return F.max(F.when(F.col("before_n") <= i, F.col(value))).cast("double")

    ends = [c for i, h in enumerate(places) for c in (at(F.floor(h)).alias(f"lo{i}"), at(F.ceil(h)).alias(f"hi{i}"))]
    out = run.groupBy(*keys, "total_n").agg(*ends)
    between = [F.when(F.floor(h) == F.ceil(h), F.col(f"lo{i}")).otherwise((F.ceil(h) - h) * F.col(f"lo{i}") + (h - F.floor(h)) * F.col(f"hi{i}")) for i, h in enumerate(places)]
    return out.select(*keys, F.array(*between).alias("q"))


def binned(hist: DataFrame, most: int, each: bool = False) -> DataFrame:
    """``hist`` with at most ``2 * most`` scores a group, for tasks that hold a group's table.

    A group of at most ``most`` distinct scores stays as it is. Else scores are joined into ``most`` bins of equal counts, at
    their mean score; a score that fills a bin alone stays by itself. So a bin of several scores holds at most 2 / most of the
    rows, which bounds the change of an AUROC by 2 / most however the scores are spread. ``each`` keeps a row a score, with
    its bin's score as ``step``.
    """
    keys = ["attribute", "group"]
    run = running(hist.withColumn("one", F.lit(1).cast("long")), ("n", "one"))
    alone = (F.col("total_one") <= most) | (F.col("n") * most > F.col("total_n"))
    rows = run.select(*hist.columns, F.floor(F.col("before_n") * F.lit(float(most)) / F.col("total_n")).alias("bin"), F.when(alone, F.col("p")).alias("own"))
    mean = F.coalesce(F.col("own"), F.try_divide(F.sum(F.col("n") * F.col("p")), F.sum("n").cast("double")))
    bins = rows.groupBy(*keys, "bin", "own").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), mean.alias("step"))
    if not each:
        return bins.select(*keys, F.col("step").alias("p"), "n", "k")
    means = bins.where("own is null").select(*keys, "bin", F.col("step").alias("mean"))
    return rows.join(means, [*keys, "bin"], "left").select(*hist.columns, F.coalesce("own", "mean").alias("step"))


def references(cells: DataFrame, references_: dict[str, str] | None = None, by: Column | None = None) -> DataFrame:
    """The reference row of each attribute: the named group if it occurs, else the first by ``by`` (default: largest n)."""
    named = F.lit(0)
    for a, g in (references_ or {}).items():
        named = F.when((F.col("attribute") == a) & (F.col("group") == str(g)), 1).otherwise(named)
    w = Window.partitionBy("attribute").orderBy(F.desc(named), by if by is not None else F.desc("n"), "group")
    return cells.where(F.col("attribute") != OVERALL).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def against_reference(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Every other group with its attribute's reference row, whose columns are prefixed ``ref_``.

    There is one reference row an attribute, so its side is as small as the list of attributes.
    """
    ref = refs.select(*(F.col(c).alias(c if c == "attribute" else f"ref_{c}") for c in refs.columns))
    return cells.join(F.broadcast(ref), "attribute").where(F.col("group") != F.col("ref_group"))
