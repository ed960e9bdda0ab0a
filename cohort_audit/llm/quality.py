"""Operator 9 - quality rules with isolation forests on their statistics.

Rule statistics of every whole text are computed by numpy over chunks of UTF-8 bytes. All labelled rows fit two isolation
forests (random splits, path lengths): one on the rows labelled good, one on those labelled bad; as the method has it, each
tree is grown on a draw of its own of ``LEAF_SAMPLE`` rows, out of all of them. Forests of two thirds of the rows score the last
third, by turns, and these scores of all labelled rows, counted in steps of 1 / ``STEPS``, set the limits: a document goes if it is more anomalous among the good than all but ``FALSE_SHARE`` of the good rows, or if its anomaly among
the good exceeds that among the bad by more than a margin. The margin is the one of the best trade-off (share of the bad
rejected less share of the good lost) that loses at most ``LOST_SHARE`` of the good rows. With fewer than 20 rows labelled
bad only the first limit holds.

Defined results: null text is the empty text, which has no words and fails the base rules. Lines are cut at line feeds
alone; words are runs of anything but space and the bytes 9 to 13. Long texts are taken whole. Repeated rows are judged each by
itself, with equal results for equal texts; a score at a limit stays. Without labelled rows only the base rules decide; an
empty table gives no rows; only ``doc_id``, ``text`` and the labels' ``quality`` are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 5
TREES, LEAF_SAMPLE, FOLDS, STEPS = 100, 256, 3, 1 << 16
#: Share of the calibration rows labelled good that the outlier limit may reject, and that both limits may.
FALSE_SHARE, LOST_SHARE = 0.002, 0.01
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COLUMNS = ["n_bytes", "n_chars", "n_upper", "n_digits", "n_marks", "n_lines", "n_distinct"]
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE_COLUMNS + MORE_COLUMNS)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[33, 34, 39, *range(40, 48), 58, 59, 63]] = True


def _repeats(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (group, value): whether the pair occurs twice or more, and whether it is not the pair's first place."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = np.zeros(len(g) + 1, bool)
    same[1:-1] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    twice, later = np.zeros(len(g), bool), np.zeros(len(g), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]  # lexsort is stable: the first of equals is the first in the text
    return twice, later


def statistics_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Statistics of the rows of a chunk, a column each of BASE_COLUMNS and MORE_COLUMNS."""
    rows = len(off) - 1
    size = np.diff(off)

    def per_row(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    rolling = base.Rolling(data, 5)
    inside = ~_SPACE[data]
    lead = (data & 0xC0) != 0x80
    start, end, row = base.runs(inside, off)
    n_words = np.bincount(row, minlength=rows)
    word = base.mix(rolling.of(start, end) ^ (end - start).astype(np.uint64), 1)
    repeat = np.zeros(len(word), bool)
    m = len(word) - WINDOW + 1
    if m > 0:
        whole = row[:m] == row[WINDOW - 1 :]
        with np.errstate(over="ignore"):
            gram = sum((base.mix(word[i : i + m], i + 2) for i in range(WINDOW)), np.zeros(m, np.uint64))
        at = np.flatnonzero(whole)
        twice, _ = _repeats(row[at], gram[at])
        hit = at[twice]
        for i in range(WINDOW):
            repeat[hit + i] = True
    # Lines: cut at line feeds and at row ends.
    breaks = np.flatnonzero(data == 10)
    in_row = np.searchsorted(off, breaks, "right") - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([off[1:], breaks])
    rows_of = np.concatenate([np.arange(rows), in_row])
    order = np.lexsort((starts, rows_of))
    line_start, line_row = starts[order], rows_of[order]
    line_end = ends[np.lexsort((ends, rows_of))]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    worded = np.flatnonzero(sums[line_end] > sums[line_start])
    ls, le, lr = line_start[worded], line_end[worded], line_row[worded]
    line = base.mix(rolling.of(ls, le) ^ (le - ls).astype(np.uint64), 9)
    _, later = _repeats(lr, line)
    _, again = _repeats(row, word)
    columns = [n_words, per_row(inside & lead), per_row(_SYMBOL[data]), np.bincount(lr[later], minlength=rows), np.bincount(row[repeat], minlength=rows)]
    columns += [size, per_row(lead), per_row(_UPPER[data]), per_row(_DIGIT[data]), per_row(_MARK[data]), np.bincount(lr, minlength=rows), n_words - np.bincount(row[again], minlength=rows)]
    return np.stack(columns, 1)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The rule statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in base.byte_chunks(batch):
                x = statistics_of(data, off)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c.astype(np.int64)) for c in x.T)], ["doc_id", *BASE_COLUMNS, *MORE_COLUMNS])

    return base.id_text(docs).mapInArrow(run, STATISTICS)


def features(x: np.ndarray) -> np.ndarray:
    """Ratios of the statistics (columns as in BASE_COLUMNS and MORE_COLUMNS)."""
    x = x.astype(float)
    words, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 6], 1)
    return np.stack([x[:, 1] / words, x[:, 2] / words, x[:, 3] / np.maximum(x[:, 10], 1), x[:, 4] / words, x[:, 7] / chars, x[:, 8] / chars, x[:, 9] / words, x[:, 11] / words ** 0.9, np.log1p(x[:, 0])], 1)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), split value, left child (right is next), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float = 1.0
    bad: Forest | None = None
    margin: float = 1.0

    def rejects(self, x: np.ndarray, anomaly: np.ndarray) -> np.ndarray:
        """Whether rows of these anomalies are outliers of the good rows, or nearer to the bad ones by more than the margin."""
        return (anomaly > self.threshold) | ((anomaly - self.bad.score(x) > self.margin) if self.bad is not None else False)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores: near 1 for points that few random splits isolate."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = self.left[t][at] + (x[inner, f[inner]] >= self.value[t][at])
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


def grow(x: np.ndarray, trees: int = TREES, sample: int = LEAF_SAMPLE, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    most = 2 ** (depth + 1)
    feature, value, left, path = np.full((trees, most), -1), np.zeros((trees, most)), np.zeros((trees, most), np.int64), np.zeros((trees, most))
    for t in range(trees):
        todo, used = [(0, rng.choice(len(x), size, replace=False), 0)], 1
        while todo:
            node, idx, level = todo.pop()
            spread = np.flatnonzero(np.ptp(x[idx], axis=0) > 0) if len(idx) > 1 else []
            if level >= depth or not len(spread):
                path[t, node] = level + float(_expected(len(idx)))
                continue
            f = int(rng.choice(spread))
            v = rng.uniform(x[idx, f].min(), x[idx, f].max())
            feature[t, node], value[t, node], left[t, node] = f, v, used
            todo += [(used, idx[x[idx, f] < v], level + 1), (used + 1, idx[x[idx, f] >= v], level + 1)]
            used += 2
    return Forest(feature, value, left, path, float(_expected(size)))


def best_margin(good: np.ndarray, lost: np.ndarray, bad: np.ndarray, share: float = LOST_SHARE, times: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The threshold on score differences of the most bad rows rejected less good rows lost, in shares; ``lost`` are gone anyway.

    At most ``share`` of the good rows are lost, counting one more than are seen (few rows say little), if the others allow it.
    ``times``: how many rows each of the good and of the bad values stands for (default: one).
    """
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1])
    g, b = (np.ones(len(good)), np.ones(len(bad))) if times is None else times

    def above(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        upto = np.concatenate([[0], np.cumsum(n[order])])
        return upto[-1] - upto[np.searchsorted(x[order], cuts, "right")]

    gone = (1 + g[lost].sum() + above(good[~lost], g[~lost])) / (1 + g.sum())
    hit = above(bad, b) / b.sum()
    gain = np.where(gone <= max(share, gone.min()), hit - gone, -np.inf)
    return float(cuts[gain.argmax()])


def quantile_of(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """Quantile (linear between neighbours) of ascending values that stand for ``times`` rows each."""
    upto, place = np.cumsum(times), (times.sum() - 1) * q
    low, high = (values[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
    return float(low + (high - low) * (place - np.floor(place)))


def forests_of(known: DataFrame, sizes: dict[tuple[int, int], int]) -> dict[tuple[int, int], Forest]:
    """Forests by label and left-out fold (-1: none) from ``known`` (quality, fold, hash, statistics), of ``sizes`` rows by label and fold.

    Each tree takes the ``LEAF_SAMPLE`` rows of least hash under a seed of its own among *all* of its label and folds, which is
    a simple draw without replacement. Tasks pass on the rows below a hash that leaves about 10 deviations more than enough.
    """
    names = [(label, out) for label in sorted({k[0] for k in sizes}) for out in range(-1, FOLDS)]
    count = [sum(n for (k, fold), n in sizes.items() if k == label and fold != out) for label, out in names]
    limits = [np.uint64(min(1.0, (LEAF_SAMPLE + 10 * LEAF_SAMPLE**0.5) / max(n, 1)) * (2**63 - 1)) for n in count]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold, hash_ = (batch.column(c).to_numpy() for c in ("quality", "fold", "hash"))
            x = features(np.stack([batch.column(c).to_numpy() for c in BASE_COLUMNS + MORE_COLUMNS], 1))
            for i, (k, out) in enumerate(names):
                own = np.flatnonzero((label == k) & (fold != out))
                for t in range(TREES) if len(own) else ():
                    key = base.mix(hash_[own].view(np.uint64), i * TREES + t + 1) >> np.uint64(1)
                    hit = np.flatnonzero(key <= limits[i])
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i * TREES + t)), pa.array(key[hit].astype(np.int64)), pa.array([r.tobytes() for r in x[own[hit]]], pa.binary())], ["tree", "key", "x"])

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "x"]).iloc[:LEAF_SAMPLE]
        tree = int(pdf["tree"].iloc[0])
        f = grow(np.stack([np.frombuffer(r) for r in pdf["x"]]), 1, LEAF_SAMPLE, tree)
        return pd.DataFrame({"tree": [tree], "feature": [f.feature.tobytes()], "value": [f.value.tobytes()], "left": [f.left.tobytes()], "path": [f.path.tobytes()], "scale": [f.scale]})

    picked = base.batched(known).mapInArrow(pick, "tree long, key long, x binary")
    trees: dict[int, list] = {}
    # At most TREES trees of 2 LEAF_SAMPLE nodes a forest, of 8 forests.
    for r in picked.groupBy("tree").applyInPandas(plant, "tree long, feature binary, value binary, left binary, path binary, scale double").orderBy("tree").collect():
        trees.setdefault(r["tree"] // TREES, []).append(r)
    out = {}
    for i, rows in trees.items():
        stack = {c: np.stack([np.frombuffer(r[c], float if c in ("value", "path") else np.int64) for r in rows]) for c in ("feature", "value", "left", "path")}
        out[names[i]] = Forest(**stack, scale=rows[0]["scale"])
    return out


def calibration(known: DataFrame, forests: dict[tuple[int, int], Forest]) -> DataFrame:
    """quality, calm, step, near: every row's anomaly among the good, by forests that have not seen its fold, less that among the bad.

    ``step`` and ``near`` are the two in whole steps of 1 / ``STEPS``.
    """
    shared = known.sparkSession.sparkContext.broadcast(pickle.dumps(forests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], Forest] = pickle.loads(shared.value)
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(), features(np.stack([batch.column(c).to_numpy() for c in BASE_COLUMNS + MORE_COLUMNS], 1))
            calm, other = np.zeros(len(x)), np.zeros(len(x))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                calm[at] = own.get((1, f), own[1, -1]).score(x[at])
                if (0, -1) in own:
                    other[at] = own.get((0, f), own[0, -1]).score(x[at])
            steps = [pa.array(np.rint(v * STEPS).astype(np.int64)) for v in (calm, calm - other)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(calm), *steps], ["quality", "calm", "step", "near"])

    return base.batched(known).mapInArrow(run, "quality int, calm double, step long, near long")


def fit(statistics: DataFrame, labels: DataFrame) -> Forest | None:
    """Forests and limits from all labelled rows that pass the base rules."""
    marks = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    rows = statistics.where((F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words"))).join(marks, "doc_id")
    columns = [*BASE_COLUMNS, *MORE_COLUMNS]
    known = base.stored(rows.select("quality", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64("doc_id", *columns).alias("hash"), *columns), "known")
    sizes = {(r["quality"], r["fold"]): r["count"] for r in known.groupBy("quality", "fold").count().collect()}
    good, bad = (sum(n for (k, _), n in sizes.items() if k == label) for label in (1, 0))
    if good < 20:
        return None
    both = bad >= 20
    forests = forests_of(known, sizes if both else {k: n for k, n in sizes.items() if k[0]})
    seen = base.stored(calibration(known, forests), "calibration")
    # Only counts by steps come to the driver, at most 2 STEPS a label.
    calm = seen.where("quality = 1").groupBy("step").count().orderBy("step").toPandas()
    forest = forests[1, -1]
    forest.threshold = quantile_of(calm["step"].to_numpy() / STEPS, calm["count"].to_numpy(), 1 - FALSE_SHARE) + 0.01
    if both:
        near = seen.groupBy("quality", "near", (F.col("calm") > forest.threshold).alias("lost")).count().toPandas()
        g, b = near[near["quality"] == 1], near[near["quality"] == 0]
        forest.bad = forests[0, -1]
        forest.margin = best_margin(g["near"].to_numpy() / STEPS, g["lost"].to_numpy(bool), b["near"].to_numpy() / STEPS, times=(g["count"].to_numpy(float), b["count"].to_numpy(float)))
    return forest


def judge(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """The statistics with ``base_failed``, ``anomaly`` and ``kept``."""
    shared = statistics.sparkSession.sparkContext.broadcast(pickle.dumps(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Forest | None = pickle.loads(shared.value)
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in BASE_COLUMNS + MORE_COLUMNS], 1) if b.num_rows else np.zeros((0, 12), np.int64)
            failed = (x[:, 0] < 10) | (100 * x[:, 4] > 20 * x[:, 0])
            f = features(x)
            anomaly = np.zeros(len(x)) if own is None else own.score(f)
            kept = ~failed & (~own.rejects(f, anomaly) if own is not None else True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *BASE_COLUMNS]), pa.array(failed), pa.array(kept), pa.array(anomaly)], ["doc_id", *BASE_COLUMNS, "base_failed", "kept", "anomaly"])

    return statistics.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = base.stored(rule_statistics(docs), "rules")
    return judge(table, fit(table, labels))
