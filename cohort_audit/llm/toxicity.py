"""Operator 10 - toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and their beginnings of 4 to 6 letters, and either of them as often as each of ``LEVELS`` (unit
vectors do not tell one rude word from five). From a bounded sample of labelled rows (``EXAMPLES``, those with the smallest
hash of their id) the terms whose link with the label is significant, at a false discovery rate of ``ALPHA``, are selected,
however many they are; examples are TF-IDF vectors of unit length over them. Postings lie in blocks of ``BLOCK`` examples, and each
(term, block) keeps its greatest weight: a query takes blocks by falling upper bound and stops when none can still reach
its k-th best, so the top k are exact. The neighbours vote with squared cosines; a monotone (isotonic) map, fitted to
leave-one-out votes of the sample, turns the vote into the score.

Defined results: a text without a selected term (null and empty ones too) has no neighbours and gets the sample's rate of
toxic rows among such texts. Long texts are taken whole. Ties in cosine go to the earlier example. A document labelled more
than once is toxic if any label says so; of labelled rows of one id one is learned from; repeated rows are scored each by
itself, with equal results for equal texts. Without labelled rows of both kinds the score is 0; an empty table gives no rows;
only ``doc_id``, ``text`` and the labels' ``toxic`` are read.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, minhash

EXAMPLES, NEIGHBOURS, BLOCK = 20_000, 15, 128
#: Toxic rows that a term must be in to be tested, and the false discovery rate of the terms selected.
LEAST_ROWS, ALPHA = 3, 0.001
HEADS, LEVELS = (4, 5, 6), (2, 3, 5)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class Terms:
    """A set of terms, what they are made of, and the first four letters of that."""

    def __init__(self, known: Iterable[str]):
        self.known = set(known)
        self.plain = {t.split("+")[0] for t in self.known}
        self.heads = {t.rstrip("*")[:4] for t in self.plain}


def term_counts(text: str, terms: Terms | None = None) -> dict[str, int]:
    """Counts of the terms of a text, of those in ``terms`` if given; a term of a level counts as one."""
    out: dict[str, int] = {}
    for w, n in words(text).items():
        if terms is not None and w[:4] not in terms.heads:
            continue
        if terms is None or w in terms.plain:
            out[w] = out.get(w, 0) + n
        for k in HEADS:
            if len(w) < k:
                break
            t = w[:k] + "*"
            if terms is None or t in terms.plain:
                out[t] = out.get(t, 0) + n
    out.update([(f"{t}+{k}", 1) for t, n in out.items() if n >= LEVELS[0] for k in LEVELS if n >= k])
    return out if terms is None else {t: n for t, n in out.items() if t in terms.known}


@dataclass
class Index:
    """Labelled examples: postings by term and block, and what a vote is worth."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    offsets: np.ndarray  # of (term, block) into the postings
    example: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray
    rest: float  # score of a text without a term
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    vocabulary: Terms = field(default_factory=lambda: Terms(()))

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(self.terms[t] for t in counts), np.int64)
        n = np.array([counts[t] for t in sorted(counts, key=self.terms.__getitem__)], float)
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / np.sqrt(w @ w)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine over 0 (all the same, whatever is pruned), and the cosines."""
        bound = w @ self.block_max[at]
        blocks = self.block_max.shape[1]
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) >= k and bound[b] < best[k - 1] - 1e-12:
                break
            lo = self.offsets[at * blocks + b]
            n = self.offsets[at * blocks + b + 1] - lo
            post = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            scores = np.bincount(self.example[post] - b * BLOCK, np.repeat(w, n) * self.weight[post], BLOCK)
            if b * BLOCK <= skip < (b + 1) * BLOCK:
                scores[skip - b * BLOCK] = 0
            hit = np.flatnonzero(scores)
            best_at, best = np.concatenate([best_at, hit + b * BLOCK]), np.concatenate([best, scores[hit]])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
        return best_at, best

    def vote(self, at: np.ndarray, cosines: np.ndarray) -> float:
        x = cosines**2
        return float((x * self.toxic[at]).sum() / x.sum()) if len(at) else self.rest

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))

    def score(self, text: str) -> tuple[float, np.ndarray]:
        """Score of a text and the neighbours behind it."""
        counts = term_counts(text, self.vocabulary)
        if not counts:
            return self.rest, np.zeros(0, np.int64)
        at, _w = self.vector(counts)
        near, cosines = self.nearest(at, _w)
        if not len(near):
            return self.rest, near
        return self.calibrated(self.vote(near, cosines)), near


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of y on x (pool adjacent violators), with half a prior case each way a pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, least x, greatest x
    for xi, yi in zip(x[order], y[order], strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += yi
            pools[-1][1] += 1
        else:
            pools.append([yi, 1, xi, xi])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, lo, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    xs = [v for p in pools for v in ((p[2], p[3]) if p[2] < p[3] else (p[2],))]
    ys = [v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1)] * (2 if p[2] < p[3] else 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def _tail(k: int, n: int, p: float) -> float:
    """log10 of the binomial chance of k or more of n (an upper bound by the leading terms)."""
    q = k / n
    if q <= p:
        return 0.0
    kl = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return -n * kl / math.log(10)


def build(rows: list[tuple[int, int, dict[str, int]]], total: int, df: dict[str, int], chosen: list[str], rest: float) -> Index:
    """The index of examples (id, label, counts of chosen terms); ``total`` and ``df`` are the sample's."""
    terms = {t: i for i, t in enumerate(chosen)}
    idf = np.array([math.log((total + 1) / (df[t] + 1)) + 1 for t in chosen])
    rows = [r for r in rows if r[2]]
    blocks = max(1, -(-len(rows) // BLOCK))
    posts: list[tuple[int, int, float]] = []
    for e, (_, _, counts) in enumerate(rows):
        w = {terms[t]: (1 + math.log(n)) * idf[terms[t]] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        posts += [(t, e, x / norm) for t, x in w.items()]
    posts.sort()
    t, e, w = (np.array(c, k) for c, k in zip(zip(*posts, strict=True) if posts else ((), (), ()), (np.int64, np.int64, float), strict=True))
    cell = t * blocks + e // BLOCK
    offsets = np.searchsorted(cell, np.arange(len(chosen) * blocks + 1))
    block_max = np.zeros(len(chosen) * blocks)
    np.maximum.at(block_max, cell, w)
    index = Index(terms, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), offsets, e, w, block_max.reshape(len(chosen), blocks), rest, vocabulary=Terms(chosen))
    votes, truth = [], []
    for i, (_, y, counts) in enumerate(rows):
        near, cosines = index.nearest(*index.vector(counts), skip=i)
        if len(near):
            votes.append(index.vote(near, cosines))
            truth.append(y)
    if votes:
        index.steps = isotonic(np.array(votes), np.array(truth, float))
    return index


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index | None:
    """An index from the labelled rows of ``labels`` (doc_id, toxic), at most ``examples`` of them."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    sample = base.bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), examples)
    # At most ``examples`` ids and labels: their size is bounded, so they may be broadcast.
    sample = spark.createDataFrame([tuple(r) for r in sample.collect()], "doc_id long, toxic int")
    texts = base.stored(base.id_text(docs).join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull()).dropDuplicates(["doc_id"]), "labelled")
    # Of near copies with one label one row stays: else a word of one much-copied text would look like a mark of many texts.
    classes = minhash.near_duplicates(texts).select("doc_id", "class_id")
    first = texts.select("doc_id", "toxic").join(classes, "doc_id").groupBy("class_id", "toxic").agg(F.min("doc_id").alias("doc_id"))
    texts = base.stored(texts.join(first.select("doc_id"), "doc_id", "left_semi"), "examples")

    def count(toxic: bool, among: set[str] | None) -> Counter:
        known = None if among is None else Terms(among)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            n = 0
            for batch in batches:
                for text in base.texts_of(batch):
                    seen.update(term_counts(text, known).keys())
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([n, *seen.values()], pa.int64())], ["term", "n"])

        part = texts.where(F.col("toxic") == int(toxic)).select("text").mapInArrow(base.frugal(run), "term string, n long")
        sums = part.groupBy("term").agg(F.sum("n").alias("n"))
        often = sums.where((F.col("n") >= LEAST_ROWS) | (F.col("term") == "")) if among is None else sums
        return Counter({r["term"]: r["n"] for r in often.collect()})  # terms of several toxic rows of the bounded sample

    bad = count(True, None)
    if not bad[""]:
        return None
    good = count(False, set(bad) - {""})
    if not good[""]:
        return None
    rate = bad[""] / (bad[""] + good[""])
    tested = max(1, len(bad) - 1)
    limit = -math.inf
    strength = {t: _tail(k, k + good[t], rate) for t, k in bad.items() if t}
    main: dict[str, int] = {}  # the rows of the most frequent word with a beginning
    for w, n in bad.items():
        for k in HEADS if w.isalpha() else ():
            if len(w) >= k:
                main[w[:k] + "*"] = max(main.get(w[:k] + "*", 0), n)
    for i, x in enumerate(sorted(strength.values()), 1):  # Benjamini and Hochberg's step-up rule
        if x <= math.log10(ALPHA * i / tested):
            limit = x
    # A beginning says more than its words only if no single word makes up half of it.
    chosen = sorted((t for t, x in strength.items() if x <= limit and main.get(t, 0) * 2 < bad[t]), key=lambda t: (strength[t], t))
    pool = Terms(chosen)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(term_counts(x, pool).items()) for x in base.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.map_(pa.string(), pa.int64()))], ["doc_id", "toxic", "counts"])

    rows = [(r["doc_id"], r["toxic"], r["counts"]) for r in texts.select("doc_id", "toxic", "text").mapInArrow(base.frugal(vectors), "doc_id long, toxic int, counts map<string,long>").orderBy("doc_id").collect()]  # at most ``examples`` short rows
    bare = [y for _, y, c in rows if not c]
    rest = (sum(bare) + 0.5) / (len(bare) + 1 + 0.5 / max(rate, 1e-3))
    return build(rows, len(rows), {t: bad[t] + good[t] for t in chosen}, chosen, rest)


def score(docs: DataFrame, index: Index | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` (ids of the three nearest examples) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index | None = pickle.loads(shared.value)
        for whole in batches:
            for batch in base.row_chunks(whole):
                found = [(0.0, np.zeros(0, np.int64)) if own is None else own.score(t) for t in base.texts_of(batch)]
                s = np.array([x for x, _ in found])
                evidence = [own.ids[near[:3]].tolist() if own is not None and len(near) else [] for _, near in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    return base.id_text(docs).mapInArrow(base.frugal(run), "doc_id long, score double, predicted int, evidence array<long>")


def clean(docs: DataFrame, index: Index | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, that :func:`score` does not predict toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index))
    loaded: list[Index | None] = []

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        own = loaded[0]
        return np.array([own is None or own.score(t)[0] < threshold for t in base.texts_of(batch)], bool)

    return base.kept_rows(docs, keep)
