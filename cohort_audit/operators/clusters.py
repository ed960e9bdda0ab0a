"""Resampling of whole clusters: exact draws, and sums of any table by replicate.

A replicate draws C of C clusters with replacement, so the clusters' counts are a multinomial of fixed size. Clusters fall into at
most ``BUCKETS`` buckets by hash. A replicate's draws are dealt to the buckets by binomial splitting down a binary tree, each
node with a generator of its own (seed, node), and inside a bucket by a multinomial; so every task finds the same counts for
a bucket whatever else it holds, and counts of a replicate sum to C.

Tasks read buckets one after the other and add ``count x value`` into matrices (cell x replicate) of each group; only these
matrices are shuffled, in pieces of ``CHUNK`` replicates, and merged in two levels. No row is repeated by replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from . import groups

#: Most buckets, clusters of a bucket where there are enough, replicates of a piece of a matrix, numbers that a task holds.
BUCKETS, FILL, CHUNK, HELD = 4096, 256, 50, 1 << 25
#: Merges of the first level for each piece.
FANS = 32
PIECE = "attribute string, group string, chunk long, part long, cells array<long>, a binary, b binary"
SAMPLES = "attribute string, group string, replicate long, value double"


class Draws:
    """Counts of clusters by replicate, from the buckets' sizes (their number is a power of two)."""

    def __init__(self, sizes: np.ndarray, replicates: int, seed: int):
        self.levels, self.replicates, self.seed = [np.asarray(sizes, np.int64)], replicates, seed
        while len(self.levels[0]) > 1:
            self.levels.insert(0, self.levels[0].reshape(-1, 2).sum(1))

    def of_bucket(self, bucket: int) -> np.ndarray:
        """How many draws of each replicate fall into a bucket."""
        left = np.full(self.replicates, self.levels[0][0])
        for depth in range(1, len(self.levels)):
            node = bucket >> (len(self.levels) - 1 - depth)
            whole, first = self.levels[depth - 1][node >> 1], self.levels[depth][node & ~1]
            taken = np.random.default_rng([self.seed, 1, depth, node >> 1]).binomial(left, first / whole if whole else 0.0)
            left = left - taken if node & 1 else taken
        return left

    def of_clusters(self, bucket: int) -> np.ndarray:
        """Counts (cluster, replicate) of a bucket's clusters, in the order of their keys."""
        n = int(self.levels[-1][bucket])
        return np.random.default_rng([self.seed, 2, bucket]).multinomial(self.of_bucket(bucket), np.full(n, 1 / n)).T


def draws(rows: DataFrame, replicates: int, seed: int) -> Draws:
    """The draws for the clusters of ``rows`` (column ``key``). At most ``BUCKETS`` numbers come to the driver."""
    sizes = np.zeros(BUCKETS, np.int64)
    for r in rows.select("key").distinct().groupBy(F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["bucket"]] = r["n"]
    while len(sizes) > 1 and sizes.sum() < FILL * len(sizes):
        sizes = sizes.reshape(2, -1).sum(0)  # bucket numbers are remainders
    return Draws(sizes, replicates, seed)


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the clusters' hashes as ``key``; a null cluster is a cluster."""
    return df.withColumn("key", F.xxhash64("cluster"))


def _summed(weights: np.ndarray, row: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values * weights[row]`` over the stretches that begin at ``first``: the j-th entries of all stretches at a time."""
    size = np.diff(first, append=len(row))
    order = np.argsort(-size, kind="stable")
    begin, left = first[order], size[order]
    plain = bool((values == 1).all())
    out = np.zeros((len(first), weights.shape[1]), weights.dtype)
    for j in range(int(left[0])):
        at = begin[: np.searchsorted(-left, -j, "left")] + j
        x = weights[row[at]]
        out[: len(at)] += x if plain else x * values[at, None].astype(weights.dtype)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


class _Matrix:
    """Sums of two values by (attribute, group, cell) and replicate."""

    def __init__(self, replicates: int):
        self.place: dict[tuple, int] = {}
        self.sums = np.zeros((64, 2, replicates))

    def add(self, part: pd.DataFrame, weights: np.ndarray) -> None:
        """Add a bucket's rows; ``weights`` (cluster, replicate) are those of its clusters in the order of their keys."""
        place = np.unique(part["key"].to_numpy(), return_inverse=True)[1]
        if int(place.max()) + 1 != len(weights):
            raise ValueError("the rows lack clusters that the draws have")
        code = part.groupby(["attribute", "group", "cell"], sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        names = part[["attribute", "group", "cell"]].iloc[order[first]].itertuples(index=False, name=None)
        at = np.array([self.place.setdefault(k, len(self.place)) for k in names])
        while len(self.place) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        row, values = place[order], part[["a", "b"]].to_numpy(float)[order]
        # Whole sums below 2**24 are exact in four bytes.
        whole = bool((values == np.floor(values)).all()) and np.abs(values).sum() * max(float(weights.max()), 1.0) < 1 << 24
        w, number = weights.astype(np.float32 if whole else float), np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
        for i in (0, 1):
            some = np.flatnonzero(values[:, i])
            if len(some):
                here = np.flatnonzero(np.diff(number[some], prepend=-1))
                self.sums[at[number[some[here]]], i] += _summed(w, row[some], values[some, i], here)

    def pieces(self, part: int) -> Iterator[pd.DataFrame]:
        of: dict[tuple, list[int]] = {}
        for (attribute, group, cell), i in self.place.items():
            of.setdefault((attribute, group), []).append((cell, i))
        for (attribute, group), cells in of.items():
            numbers, at = [c for c, _ in cells], [i for _, i in cells]
            for chunk in range(-(-self.sums.shape[2] // CHUNK)):
                x = self.sums[at, :, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.float32)
                yield pd.DataFrame({"attribute": attribute, "group": group, "chunk": chunk, "part": part, "cells": [numbers], "a": [x[:, 0].tobytes()], "b": [x[:, 1].tobytes()]})


def sums(rows: DataFrame, drawn: Draws) -> DataFrame:
    """Sums by replicate of ``rows`` (key, attribute, group, cell, a, b), in which every cluster occurs: pieces of matrices, not yet merged."""
    count = len(drawn.levels[-1])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part, rest = _Matrix(drawn.replicates), TaskContext.get().partitionId() % FANS, None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            cuts = [0, *(np.flatnonzero(np.diff(batch["bucket"].to_numpy())) + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held.add(batch.iloc[lo:hi], drawn.of_clusters(int(batch["bucket"].iloc[lo])))
                if held.sums.size > HELD:
                    yield from held.pieces(part)
                    held = _Matrix(drawn.replicates)
            rest = batch.iloc[cuts[-1] :]  # a bucket may go on in the next batch
        if rest is not None and len(rest):
            held.add(rest, drawn.of_clusters(int(rest["bucket"].iloc[0])))
        yield from held.pieces(part)

    ordered = rows.withColumn("bucket", F.pmod("key", F.lit(count))).repartition("bucket").sortWithinPartitions("bucket", "key")
    ordered = ordered.select("bucket", "key", "attribute", "group", "cell", "a", "b")
    return ordered.mapInPandas(add, PIECE)


def _merged(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = np.unique(np.concatenate([np.asarray(c) for c in pdf["cells"]]))
    total = np.zeros((2, len(cells), width))
    for r in pdf.itertuples():
        at = np.searchsorted(cells, r.cells)
        for i, x in enumerate((r.a, r.b)):
            total[i, at] += np.frombuffer(x, np.float32).reshape(len(at), width)
    return cells, total[0], total[1]


def by_replicate(rows: DataFrame, drawn: Draws, statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], values: DataFrame | None = None) -> DataFrame:
    """attribute, group, replicate, value: a statistic of each group's table in each replicate.

    ``statistic`` maps cells in order (or their ``value`` in the table ``values``: attribute, group, cell, value), and the sums of
    a and of b (replicate, cell), to a value for each replicate (nan: none).
    """

    def width(chunk: int) -> int:
        return min(CHUNK, drawn.replicates - chunk * CHUNK)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, a, b = _merged(pdf, width(int(pdf["chunk"].iloc[0])))
        return pdf.iloc[:1].assign(cells=[cells.tolist()], a=[a.astype(np.float32).tobytes()], b=[b.astype(np.float32).tobytes()])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        cells, a, b = _merged(pdf, width(chunk))
        at = cells.astype(float)
        if "names" in pdf and pdf["names"].iloc[0] is not None:
            at = np.asarray(pdf["at"].iloc[0])[np.searchsorted(np.asarray(pdf["names"].iloc[0]), cells)]
        v = np.asarray(statistic(at, a.T, b.T), float)
        return pd.DataFrame({"attribute": pdf["attribute"].iloc[0], "group": pdf["group"].iloc[0], "replicate": chunk * CHUNK + np.arange(len(v)), "value": v})

    merged = sums(rows, drawn).groupBy("attribute", "group", "chunk", "part").applyInPandas(merge, PIECE)
    if values is not None:
        named = values.groupBy("attribute", "group").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("v"))  # the bins of a group
        merged = merged.join(named.select("attribute", "group", F.col("v.cell").alias("names"), F.col("v.value").alias("at")), ["attribute", "group"])
    out = merged.groupBy("attribute", "group", "chunk").applyInPandas(finish, SAMPLES)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def score_table(df: DataFrame, attributes: list[str], resolution: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, attribute, group, cell, a: rows, b: positives) by cluster and score bin, and the bins' scores."""
    steps = groups.binned(groups.histogram(df, attributes), resolution, each=True).select("attribute", "group", "p", "step")
    # Bins are numbered by their score's order, which its bits have for numbers from 0 on.
    rows = groups.long(keyed(df), attributes, "p", "y", "key").groupBy("attribute", "group", "key", "p").agg(F.count(F.lit(1)).alias("a"), F.sum("y").alias("b"))
    rows = rows.join(steps, ["attribute", "group", "p"]).groupBy("attribute", "group", "key", "step").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bins = steps.select("attribute", "group", "step").distinct()
    bins = bins.withColumn("cell", F.row_number().over(Window.partitionBy("attribute", "group").orderBy("step")).cast("long"))  # the bins of a group
    rows = rows.join(bins, ["attribute", "group", "step"]).select("key", "attribute", "group", "cell", "a", "b")
    return rows, bins.select("attribute", "group", "cell", F.col("step").alias("value"))


def score_statistic(df: DataFrame, attributes: list[str], statistic: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], replicates: int = C.N_BOOTSTRAP, seed: int = C.SEED, resolution: int = 500) -> DataFrame:
    """Samples of any statistic of scores when whole clusters (column ``cluster``) are drawn: attribute, group, replicate, value.

    ``statistic`` takes a group's scores in order and the numbers of rows and of positives (replicate, score). Scores of a
    group are joined into about ``resolution`` bins of equal counts where it has more distinct ones.
    """
    rows, values = score_table(df, attributes, resolution)
    return by_replicate(rows, draws(keyed(df), replicates, seed), statistic, values)
