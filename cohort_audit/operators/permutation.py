"""Permutation tests of the range of a rate or of the AUROC over groups.

Labels are permuted over units within an outcome stratum and confounders. A unit is a row, or with a column ``cluster`` a pair
of cluster and label (a cluster of two labels is two units). Units of equal sums are interchangeable, so a permutation deals the
labels to *kinds* of units without replacement, by hypergeometric draws: for rates a kind is a pair of sums, for the AUROC of
rows a cell of score bin and outcome. Clusters have score tables of their own; there the labels are dealt down a binary tree of
buckets, and inside a bucket each permutation shuffles what it got (:class:`Deals`). Label counts stay what they are in all of
them. Tasks hold a table of kinds or a bucket, never all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import clusters, groups, rates
from .resampling import CHUNK, _chunks, _generator, _weighted_auroc

STRATA = {"TPR": 1, "Recall": 1, "FNR": 1, "FPR": 0, "TNR": 0, "Specificity": 0}


def metric_type(metric: str) -> str:
    """The outcome stratum in which a metric's labels may be permuted."""
    name = metric.lower()
    return {"tpr": "TPR", "sensitivity": "TPR", "recall": "TPR", "equal_opportunity": "TPR", "fnr": "FNR", "fpr": "FPR", "tnr": "TNR", "specificity": "TNR"}.get(name, "Independence")


def dealt(left: np.ndarray, n: np.ndarray | int, rng: np.random.Generator) -> np.ndarray:
    """How many of n places get each label, drawn without replacement from ``left`` (label, replicate)."""
    out, todo = np.zeros_like(left), np.broadcast_to(n, left.shape[1:]).copy()
    for i in range(len(left)):
        out[i] = rng.hypergeometric(left[i], left[i + 1 :].sum(0), todo) if i + 1 < len(left) else todo
        todo = todo - out[i]
    return out


def _deal(kinds: DataFrame, permutations: int, seed: int, sums: bool) -> DataFrame:
    """Labels dealt to the ``kinds`` (s, label, a, b, m units) of each stratum, permutations by chunks.

    With ``sums`` the sums of a and b by label and permutation (rep, label, a, b; from 1 on); else chunk, label, a, b, and the
    ``counts`` of units of that kind by permutation.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, s = int(pdf["chunk"].iloc[0]), int(pdf["s"].iloc[0])
        size = min(CHUNK, permutations - chunk * CHUNK)
        rng = _generator(seed, "permutation", s, chunk)
        have = pdf.groupby("label")["m"].sum().sort_index()
        labels, left = list(have.index), np.repeat(have.to_numpy()[:, None], size, 1)
        total, out = np.zeros((2, *left.shape)), []
        for (a, b), m in pdf.groupby(["a", "b"])["m"].sum().sort_index().items():
            got = dealt(left, int(m), rng)
            left = left - got
            if sums:
                total += np.array([a, b])[:, None, None] * got
            else:
                out.append(pd.DataFrame({"chunk": chunk, "label": labels, "a": a, "b": b, "counts": [g.tolist() for g in got]}))
        number = chunk * CHUNK + 1 + np.arange(size)
        return pd.concat([pd.DataFrame({"rep": number, "label": g, "a": total[0, i], "b": total[1, i]}) for i, g in enumerate(labels)] if sums else out)

    schema = "rep long, label string, a double, b double" if sums else "chunk long, label string, a long, b long, counts array<long>"
    return _chunks(kinds, permutations).groupBy("s", "chunk").applyInPandas(draw, schema)


class Deals:
    """Labels of units by permutation, from the sizes of buckets (a power of two of them) and the labels' numbers."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, permutations: int, seed: Sequence[int]):
        self.tree, self.labels, self.seed = clusters.Draws(sizes, permutations, 0).levels, np.asarray(labels, np.int64), list(seed)
        self.permutations = permutations

    def of_bucket(self, bucket: int) -> np.ndarray:
        """Numbers of each label (label, permutation) that fall into a bucket."""
        left = np.repeat(self.labels[:, None], self.permutations, 1)
        for depth in range(1, len(self.tree)):
            node = bucket >> (len(self.tree) - 1 - depth)
            first = dealt(left, int(self.tree[depth][node & ~1]), np.random.default_rng([*self.seed, 3, depth, node >> 1]))
            left = left - first if node & 1 else first
        return left

    def of_units(self, bucket: int) -> np.ndarray:
        """Label number of each of a bucket's units (unit, permutation)."""
        n = int(self.tree[-1][bucket])
        upto = np.cumsum(self.of_bucket(bucket), 0)
        label = (upto[:, :, None] <= np.arange(n)).sum(0)
        return np.random.default_rng([*self.seed, 4, bucket]).permuted(label, axis=1).T


def _auroc_gap(table: np.ndarray) -> np.ndarray:
    """Range over labels of the AUROC of counts (label, outcome, replicate, score); nan where fewer than one label has one."""
    each = np.stack([_weighted_auroc(t[0], t[1]) for t in table])
    some = ~np.isnan(each).all(0)
    out = np.full(each.shape[1], np.nan)
    out[some] = np.nanmax(each[:, some], 0) - np.nanmin(each[:, some], 0)
    return out


def _row_aurocs(kinds: DataFrame, permutations: int, seed: int) -> DataFrame:
    """rep, v: range of the AUROC, for rows; ``a`` of a kind is its score bin, ``b`` its outcome."""

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, labels, bins = int(pdf["chunk"].iloc[0]), sorted(pdf["label"].unique()), np.sort(pdf["a"].unique())
        counts = np.stack(pdf["counts"].to_list())
        table = np.zeros((len(labels), 2, counts.shape[1], len(bins)))
        np.add.at(table.transpose(0, 1, 3, 2), (np.searchsorted(labels, pdf["label"].to_numpy(object)), pdf["b"].to_numpy(), np.searchsorted(bins, pdf["a"].to_numpy())), counts)
        return pd.DataFrame({"rep": chunk * CHUNK + 1 + np.arange(counts.shape[1]), "v": _auroc_gap(table)})

    seen = kinds.groupBy("label", "a", "b").agg(F.sum("m").alias("m")).select(F.lit(-1).cast("long").alias("chunk"), "label", "a", "b", F.array("m").alias("counts"))
    drawn = _deal(kinds, permutations, seed, False).groupBy("chunk").applyInPandas(finish, "rep long, v double")
    observed = seen.groupBy("chunk").applyInPandas(finish, "rep long, v double").withColumn("rep", F.lit(0).cast("long"))
    return observed.union(drawn)


def _cluster_aurocs(units: DataFrame, permutations: int, seed: int) -> DataFrame:
    """rep, v: range of the AUROC, for units (s, key, label) with their score tables: cell, a (rows), b (positives)."""
    one = units.select("s", "key", "label").distinct()
    sizes = one.groupBy("s", F.pmod("key", F.lit(clusters.BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    labels = one.groupBy("s", "label").agg(F.count(F.lit(1)).alias("n"))
    names = sorted({r["label"] for r in labels.select("label").distinct().collect()})  # a row a group
    have: dict[int, np.ndarray] = {}
    held: dict[int, np.ndarray] = {}
    for r in sizes.collect():  # at most BUCKETS rows a stratum of confounders
        have.setdefault(r["s"], np.zeros(clusters.BUCKETS, np.int64))[r["bucket"]] = r["n"]
    for r in labels.collect():
        held.setdefault(r["s"], np.zeros(len(names), np.int64))[names.index(r["label"])] = r["n"]
    total = sum(have.values(), np.zeros(clusters.BUCKETS, np.int64))
    count = clusters.BUCKETS
    while count > 1 and total.sum() < clusters.FILL * count:
        count //= 2
    deals = {s: Deals(x.reshape(-1, count).sum(0), held[s], permutations, [seed, s % 2**32]) for s, x in have.items()}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, part, rest = clusters._Matrix(permutations + 1), TaskContext.get().partitionId() % clusters.FANS, None

        def take(rows: pd.DataFrame) -> None:
            label = deals[int(rows["s"].iloc[0])].of_units(int(rows["bucket"].iloc[0]))
            key, at = np.unique(rows["key"].to_numpy(), return_index=True)
            own = np.searchsorted(names, rows["label"].to_numpy(object)[at])
            label = np.concatenate([own[:, None], label], 1)  # the observed labels first
            for i, name in enumerate(names):
                matrix.add(rows.assign(attribute="", group=name), (label == i).astype(float))

        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            group = batch[["s", "bucket"]].to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                take(batch.iloc[lo:hi])
            rest = batch.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            take(rest)
        yield from matrix.pieces(part)

    ordered = units.withColumn("bucket", F.pmod("key", F.lit(count))).repartition("s", "bucket").sortWithinPartitions("s", "bucket", "key").select("s", "bucket", "key", "label", "cell", "a", "b")
    pieces = ordered.mapInPandas(add, clusters.PIECE)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        size = min(clusters.CHUNK, permutations + 1 - chunk * clusters.CHUNK)
        tables = [clusters._merged(own, size) for _, own in pdf.groupby("group")]
        bins = np.unique(np.concatenate([t[0] for t in tables]))
        table = np.zeros((len(tables), 2, size, len(bins)))
        for i, (cells, a, b) in enumerate(tables):
            at = np.searchsorted(bins, cells)
            table[i, 0][:, at], table[i, 1][:, at] = (a - b).T, b.T
        return pd.DataFrame({"rep": chunk * clusters.CHUNK + np.arange(size), "v": _auroc_gap(table)})

    return pieces.groupBy("chunk").applyInPandas(finish, "rep long, v double")


def _rates(kinds: DataFrame, permutations: int, seed: int) -> DataFrame:
    """rep, v: range of the rate a / b, for kinds of sums."""
    seen = kinds.groupBy("label").agg(F.sum(F.col("a") * F.col("m")).cast("double").alias("a"), F.sum(F.col("b") * F.col("m")).cast("double").alias("b"))
    both = _deal(kinds, permutations, seed, True).union(seen.select(F.lit(0).cast("long"), "label", "a", "b"))
    sums = both.groupBy("rep", "label").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("b > 0")
    return sums.withColumn("r", F.col("a") / F.col("b")).groupBy("rep").agg((F.max("r") - F.min("r")).alias("v"))


def permutation_test(df: DataFrame, attribute: str, metric: str = "tpr", threshold: float = 0.5, confounders: Sequence[str] = (), permutations: int = 1000, seed: int = C.SEED, resolution: int = 500) -> DataFrame:
    """p of the range of a metric over groups when group labels are permuted over units: one row.

    ``metric`` is a rate or ``auroc``. Columns: metric, observed, p_value ((1 + permutations that reach it) / (1 + permutations)), null
    quantiles, n_permutations with a value. Without a row in the metric's stratum all but the last are nan. Scores of the AUROC are
    joined into about ``resolution`` bins where there are more distinct ones. Rows without a label are left out.
    """
    want = STRATA.get(metric_type(metric))
    rows = df if want is None else df.where(F.col("y") == want)
    rows = rows.where(F.col(attribute).isNotNull())
    by_cluster = "cluster" in df.columns
    s = F.xxhash64(*confounders) if confounders else F.lit(0).cast("long")
    base = rows.withColumns({"s": s, "label": F.col(attribute).cast("string")})
    if metric == "auroc":
        steps = groups.binned(groups.histogram(rows.select("p", "y"), []), resolution, each=True).select("p", "step")
        base = base.join(steps, "p").withColumn("cell", order_number(F.col("step")))
        if by_cluster:
            unit = base.groupBy("s", F.xxhash64("cluster", "label").alias("key"), "label", "cell").agg(F.count(F.lit(1)).alias("a"), F.sum("y").alias("b"))
            spread = _cluster_aurocs(unit, permutations, seed)
        else:
            kinds = base.groupBy("s", "label", F.col("cell").alias("a"), F.col("y").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("m"))
            spread = _row_aurocs(kinds, permutations, seed)
    else:
        num, den = rates.RATES[metric]
        unit = base.groupBy("cluster", "s", "label") if by_cluster else base.groupBy("s", "label", (F.col("p") >= threshold).alias("flag"), "y")
        each = rates.derived(unit.agg(F.count(F.lit(1)).alias("rows"), *rates.aggregates(threshold)))
        share = F.lit(1) if by_cluster else F.col("rows")  # rows of one flag and outcome are one kind
        kinds = each.groupBy("s", "label", (F.col(num) / share).cast("long").alias("a"), (F.col(den) / share).cast("long").alias("b")).agg(F.sum(share).alias("m"))
        spread = _rates(kinds, permutations, seed)
    spread = spread.where(~F.isnan("v"))
    obs = spread.where("rep = 0").agg(F.first("v").alias("observed"))  # one row, null without a value
    null = spread.where("rep > 0").crossJoin(F.broadcast(obs))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))  # over the permutations
    reached = F.count_if(F.abs("v") >= F.abs("observed") - 1e-12)
    nan = F.lit(float("nan"))
    out = null.agg(reached.alias("reached"), q.alias("q"), F.count(F.lit(1)).alias("n_permutations")).crossJoin(F.broadcast(obs))  # one row each
    p = F.when(F.col("observed").isNotNull(), (1 + F.col("reached")) / F.lit(1.0 + permutations)).otherwise(nan)
    return out.select(F.lit(metric).alias("metric"), F.coalesce("observed", nan).alias("observed"), p.alias("p_value"), F.coalesce(F.col("q")[0], nan).alias("null_lower"), F.coalesce(F.col("q")[1], nan).alias("null_upper"), "n_permutations")


def order_number(p: Column) -> Column:
    """A whole number with the order of a score from 0 to 1, to 2**-52."""
    return F.round(p * F.lit(float(1 << 52))).cast("long")


def permutation_test_arrays(spark, y_true: Sequence[int], y_pred: Sequence[int], labels: Sequence[str], metric: str = "selection_rate", permutations: int = 1000, seed: int = C.SEED) -> DataFrame:
    """:func:`permutation_test` on plain sequences, each row a unit."""
    rows = [(float(p), int(y), str(g)) for y, p, g in zip(y_true, y_pred, labels, strict=True)]
    return permutation_test(spark.createDataFrame(rows, "p double, y int, g string"), "g", metric, 0.5, permutations=permutations, seed=seed)
