"""Operator 12 - near duplicates among embeddings by spherical-cap filters.

Filter directions are products of random codes: a rotated vector is cut into blocks, each block has its own random code words, and
every combination of code words is a direction. The directions are never listed: a vector is *list-decoded* to all whose cap
it lies in from the best code words of its blocks. The caps' height is the vector's own, that of its ``LIST`` best directions, which
evens out products of few code words; ``TURNS`` rotations with codes of their own add up. Near vectors share many filters, far
ones hardly any. The number of directions grows with the table, so filters hold a few vectors at any size, and it is
lowered (at low dimensions) until no simulated pair at the limit has fewer than ``COMMON`` filters in common.

Vectors that share their best filter with its least vector and lie within half the limit's angle of it are one *cell* with it: any two
of a cell are linked, by the triangle inequality, without a look at the pair. So a group of copies or near copies of any size
is a few cells. Filters are joined between cells; pairs of cells with ``COMMON`` filters are measured by the angle of
their centres. With the cells' radii this links all their vectors or none, or leaves the pair open; then the vectors
of one cell are measured against the other's centre, and only those still open against its vectors. Every link rests on a cosine in
double precision or on such a bound, with a margin of ``MARGIN``. Cells with a link between them make the components.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with nothing; so do vectors of
different lengths with each other. Repeated rows are vectors of their own, which link with each other; rows without an id link like
others and are kept by no rule (``kept`` is false where a component has an id), the component is named by its least id; a cosine of
exactly the limit is a link; an empty table gives no rows; only ``vec_id`` and ``embedding`` are read, so further columns of any
name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base, minhash

COSINE = 0.95
#: Blocks of a vector, rotations, filters of a vector and rotation, directions a vector of the table, filters that a pair must share.
BLOCKS, TURNS, LIST, WIDTH, COMMON = 3, 3, 16, 256, 2
#: Simulated pairs at the limit, of which none may share fewer filters.
TRIALS = 2000
MARGIN = 1e-6


class Code:
    """A random rotation and code words for each block; directions are numbered by their code words."""

    def __init__(self, length: int, words: int, turn: int):
        rng = np.random.default_rng([12, turn, length])
        self.rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
        self.cuts = [c for c in np.array_split(np.arange(length), BLOCKS) if len(c)]
        book = [rng.standard_normal((words, len(c))) for c in self.cuts]
        self.book = [b / np.linalg.norm(b, axis=1, keepdims=True) for b in book]
        most = min(LIST, words)
        # The best LIST sums lie among those whose ranks multiply to at most LIST.
        at = np.stack(np.meshgrid(*[np.arange(most)] * len(self.cuts), indexing="ij"), -1).reshape(-1, len(self.cuts))
        self.tried = at[np.prod(at + 1, axis=1) <= LIST]

    def decode(self, v: np.ndarray) -> np.ndarray:
        """For each vector its best directions, the very best first; ties go by number."""
        v, total, number = v @ self.rotation, 0.0, 0
        for j, (c, b) in enumerate(zip(self.cuts, self.book, strict=True)):
            score = v[:, c] @ b.T
            most = min(LIST, len(b))
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            value = np.take_along_axis(score, best, 1)
            order = np.lexsort((best, -value), axis=1)
            best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            total = total + value[:, self.tried[:, j]]
            number = number * len(b) + best[:, self.tried[:, j]]
        order = np.lexsort((number, -total), axis=1)[:, :LIST]
        return np.take_along_axis(number, order, 1)


@lru_cache(maxsize=16)
def codes(length: int, n: int, cosine: float) -> list[Code]:
    """The codes for vectors of a length in a table of n: the most directions at which no simulated pair at the limit is missed."""
    words = max(1, int(np.ceil((WIDTH * n) ** (1 / min(BLOCKS, length)))))
    rng = np.random.default_rng([length, 34])
    x = rng.standard_normal((TRIALS, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((TRIALS, length))
    z -= (z * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * np.divide(z, size, out=np.zeros_like(z), where=size > 1e-9)
    while True:
        made, shared = [Code(length, words, turn) for turn in range(TURNS)], np.zeros(TRIALS)
        for code in made:
            shared += (code.decode(x)[:, :, None] == code.decode(y)[:, None, :]).any(2).sum(1)
        if words == 1 or shared.min() >= COMMON:
            return made
        words = (words + 1) // 2


def unit(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors flat[off[i]:off[i + 1]] at length 1 in double precision, and which of them are sound."""
    size = np.diff(off)
    sound = size > 0
    finite = np.isfinite(flat)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    sound &= bad[off[1:]] == bad[off[:-1]]
    v = np.where(finite, flat.astype(np.float64), 0.0)
    if not len(v):
        return v, sound & False
    begin = np.minimum(off[:-1], len(v) - 1)
    top = np.where(size > 0, np.maximum.reduceat(np.abs(v), begin), 0.0)
    sound &= top > 0
    v = v / np.repeat(np.where(top > 0, top, 1.0), size)  # so that squares neither overflow nor vanish
    norm = np.sqrt(np.add.reduceat(v * v, begin))
    return v / np.repeat(np.where(sound, norm, 1.0), size), sound


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets of a list column; a null list is empty, a null number NaN."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def decoded(rows: DataFrame, n: int, cosine: float) -> DataFrame:
    """``node``, ``vec_id``, ``embedding``, ``best`` (best filter of each rotation) and ``filters``; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = _flat(batch.column("embedding"))
            v, sound = unit(flat, off)
            size = np.diff(off)
            best, filters = [None] * len(size), [None] * len(size)
            for length in np.unique(size[sound]).tolist():
                at = np.flatnonzero(sound & (size == length))
                x = v[(off[at][:, None] + np.arange(length)).ravel()].reshape(len(at), length)
                found = [base.mix(c.decode(x).astype(np.uint64), 1000 * length + turn).view(np.int64) for turn, c in enumerate(codes(length, n, cosine))]
                every = np.concatenate(found, 1)
                for i, k in enumerate(at.tolist()):
                    best[k], filters[k] = [f[i, 0] for f in found], every[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.list_(pa.int64())), pa.array(filters, pa.list_(pa.int64()))], [*batch.schema.names, "best", "filters"])

    kind = dict(rows.dtypes)["embedding"]
    return base.batched(rows).mapInArrow(run, f"node long, vec_id long, embedding {kind}, best array<long>, filters array<long>")


def measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with the cosine of their vectors. Nodes with many partners are dealt over tasks."""

    def heavy(c: str) -> DataFrame:
        return pairs.groupBy(c).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > base.HEAVY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, off), (y, _) = _flat(batch.column("x")), _flat(batch.column("y"))
            product = unit(x, off)[0] * unit(y, off)[0]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.add.reduceat(product, off[:-1]) if len(product) else np.zeros(0))], ["a", "b", "cosine"])

    left = base.split_join(pairs, vectors.select(F.col("node").alias("a"), F.col("embedding").alias("x")), ["a"], heavy("a"), ["b"])
    both = base.split_join(left, vectors.select(F.col("node").alias("b"), F.col("embedding").alias("y")), ["b"], heavy("b"), ["a"])
    same = both.where(F.size("x") == F.size("y")).select("a", "b", "x", "y")
    return base.batched(same).mapInArrow(run, "a long, b long, cosine double")


def angle() -> Column:
    return F.acos(F.least(F.col("cosine"), F.lit(1.0)))


def cells_of(vectors: DataFrame, scratch: base.Scratch, cosine: float) -> DataFrame:
    """(node, cell, angle) of the vectors that lie in the cell of another; a cell is named by the node at its centre."""
    keyed = vectors.where("best is not null").select("node", F.explode("best").alias("best"))
    heads = scratch.stored(keyed.groupBy("best").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    pairs = base.split_join(keyed, heads.select("best", "head"), ["best"], heads.where(F.col("n") > base.HEAVY), ["node"])
    pairs = scratch.stored(pairs.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    near = scratch.stored(measured(pairs, vectors).withColumn("angle", angle()).where(F.col("angle") <= acos(cosine) / 2 - MARGIN), "near")
    # A centre lies in no other cell.
    centres = near.select(F.col("b").alias("cell")).distinct().join(near.select(F.col("a").alias("cell")), "cell", "left_anti")
    own = base.split_join(near.withColumnRenamed("b", "cell"), centres, ["cell"], near.groupBy(F.col("b").alias("cell")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > base.HEAVY), ["a"])
    least = own.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("cell", "angle")).alias("of"))
    return scratch.stored(least.select("node", "of.cell", "of.angle"), "members")


def candidates(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of cells that share ``COMMON`` filters or more."""
    many = members.select("node", "cell").union(members.select(F.col("cell").alias("node"), "cell").distinct())
    lists = vectors.where("filters is not null").select("node", "filters")
    alone = lists.join(many, "node", "left_anti").select(F.explode("filters").alias("filter"), F.col("node").alias("cell"))
    shared = lists.join(many, "node").select(F.explode("filters").alias("filter"), "cell").distinct()
    rows = alone.union(shared)
    pairs = rows.withColumnRenamed("cell", "a").join(rows.withColumnRenamed("cell", "b"), "filter").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= COMMON).select("a", "b")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row a vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    scratch, limit = base.Scratch(embeddings.sparkSession), acos(cosine)
    kind = dict(embeddings.dtypes)["embedding"]
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    # A row's number is fixed once it is written.
    rows = embeddings.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    vectors = base.stored(decoded(rows, embeddings.count(), cosine), "vectors")
    members = cells_of(vectors, scratch, cosine)
    cells = scratch.stored(members.groupBy("cell").agg(F.max("angle").alias("radius"), (F.count(F.lit(1)) + 1).alias("size")), "cells")

    def with_cell(df: DataFrame, side: str) -> DataFrame:
        of = cells.select(F.col("cell").alias(side), F.col("radius").alias(f"radius_{side}"), F.col("size").alias(f"size_{side}"))
        return df.join(of, side, "left").fillna({f"radius_{side}": 0.0, f"size_{side}": 1})

    def all_linked(radius: Column) -> Column:
        return F.when(radius > 0, angle() + radius <= limit - MARGIN).otherwise(F.col("cosine") >= cosine)

    pairs = scratch.stored(candidates(vectors, members), "candidates")
    radii = F.col("radius_a") + F.col("radius_b")
    found = with_cell(with_cell(measured(pairs, vectors), "a"), "b").withColumns({"sure": all_linked(radii), "open": (radii > 0) & (angle() - radii <= limit + MARGIN)})
    found = scratch.stored(found.where("sure or open"), "found")
    # Open pairs of cells: vectors of a against the centre of b, and what is open still against the vectors of b.
    inside = members.select("node", "cell").union(cells.select(F.col("cell").alias("node"), "cell"))
    unsure = found.where("open and not sure").select("a", "b", "radius_b", "size_b")

    def vectors_of(df: DataFrame, cell: str, node: str) -> DataFrame:
        own = df.join(inside.select(F.col("cell").alias(cell), F.col("node").alias(node)), cell, "left")
        return own.withColumn(node, F.coalesce(node, cell))

    first = scratch.stored(vectors_of(unsure.withColumnRenamed("a", "cell_a"), "cell_a", "a"), "first")
    seen = measured(first.select("a", "b"), vectors).join(first, ["a", "b"]).withColumns({"sure": all_linked(F.col("radius_b")), "open": (F.col("radius_b") > 0) & (angle() - F.col("radius_b") <= limit + MARGIN)})
    seen = scratch.stored(seen.where("sure or open"), "seen")
    second = scratch.stored(vectors_of(seen.where("open and not sure").select("a", F.col("b").alias("cell_b"), "cell_a"), "cell_b", "b"), "second")
    single = scratch.stored(measured(second.select("a", "b"), vectors).where(F.col("cosine") >= cosine), "single")
    # Links of all vectors of a cell, and of single vectors.
    whole = found.where("sure")
    of_cell = whole.select(F.col("a").alias("cell"), F.col("size_b").alias("more")).union(whole.select("b", "size_a"))
    of_cell = of_cell.union(seen.where("sure").select("b", F.lit(1).cast("long"))).groupBy("cell").agg(F.sum("more").alias("more"))
    of_node = seen.where("sure").select(F.col("a").alias("node"), F.col("size_b").alias("own")).union(single.select("a", F.lit(1).cast("long"))).union(single.select("b", F.lit(1).cast("long")))
    of_node = of_node.groupBy("node").agg(F.sum("own").alias("own"))
    edges = whole.select("a", "b").union(seen.where("sure").select("cell_a", "b")).union(single.join(second, ["a", "b"]).select("cell_a", "cell_b"))
    classes = scratch.stored(minhash.components(edges), "classes")
    # Least id of each component by its cells, then back to their vectors.
    nodes = vectors.select("node", "vec_id").join(members.select("node", "cell"), "node", "left").withColumn("cell", F.coalesce("cell", "node"))
    linked = cells.select("cell").union(classes.select(F.col("id").alias("cell"))).distinct()
    low = base.split_join(nodes, linked, ["cell"], cells.where(F.col("size") > base.HEAVY), ["node"]).groupBy("cell").agg(F.min("vec_id").alias("low"))
    low = low.join(classes.withColumnRenamed("id", "cell"), "cell", "left").withColumn("class_id", F.coalesce("class_id", "cell"))
    of_class = low.groupBy("class_id").agg(F.min("low").alias("component_id"))
    heavy = low.groupBy("class_id").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > base.HEAVY)
    table = base.split_join(low.select("cell", "class_id"), of_class, ["class_id"], heavy, ["cell"])
    table = table.join(cells.select("cell", "size"), "cell", "left").join(of_cell, "cell", "left").select("cell", "component_id", (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).alias("more"))
    table = scratch.stored(table, "table")
    out = base.split_join(nodes, table, ["cell"], cells.where(F.col("size") > base.HEAVY), ["node"], "left").join(of_node, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", (F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    done = base.stored(out, "links")
    scratch.clear()
    return done
