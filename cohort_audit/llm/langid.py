"""Operator 2 - language identification by interpolated Kneser-Ney character models.

A model of order 4 for each language is counted by Spark over a bounded sample of labelled rows (about ``PER_LANGUAGE``
documents a language, those with the smallest hashes of their ids). The models are stored as sorted arrays of 64-bit n-gram
codes with a column a language; a text's n-grams are looked up in them by binary search, all texts of a chunk at once. The
language of the lowest cross-entropy a symbol is predicted. A tenth of the sample is kept out of the counts to calibrate
the score (how often such a margin is right) and the rejection (how far a text's cross-entropy may lie above its language).

Texts are lower-cased, letters are symbols, and any run of other characters is one boundary symbol.

Defined results: null text, or text without a letter, is ``und`` with score 0 and is rejected. A tie goes to the language
that sorts first. Long texts are taken whole. Repeated rows are predicted each by itself, with equal results for equal texts;
rows without an id are predicted but not learned from. With no labelled row at all every text is ``und``; an empty table gives
no rows; only ``doc_id``, ``text`` and, to learn, ``lang`` are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import base

ORDER = 4
#: Labelled documents of a language that a model is fitted on.
PER_LANGUAGE = 1500
#: Share of a language's texts that rejection is set to lose, and the share of calibration rows that its tail is fitted to.
REJECT_SHARE, TAIL = 0.0005, 0.1
SPACE = 32


@lru_cache(1)
def _symbols() -> np.ndarray:
    """The symbol of each code point: itself folded to 16 bits for a letter, else the boundary."""
    return np.array([(c if c < 65536 else 0xE000 | c & 0xFFF) if chr(c).isalpha() else SPACE for c in range(0x110000)], np.uint16)


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes of all texts, the text of each code, and the number of letters of each text."""
    joined = [t.lower() for t in texts]
    length = np.array([len(t) for t in joined], np.int64)
    points = np.frombuffer("".join(joined).encode("utf-32-le", "replace"), np.uint32)
    sym = _symbols()[points]
    row = np.repeat(np.arange(len(texts)), length)
    letter = sym != SPACE
    letters = np.bincount(row[letter], minlength=len(texts))
    first = np.ones(len(sym), bool)
    first[1:] = row[1:] != row[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~first[1:]  # one boundary after a run of letters
    sym, row = sym[keep].astype(np.uint64), row[keep]
    code = sym.copy()
    for back in range(1, ORDER):
        shifted = np.full(len(sym), SPACE, np.uint64)
        if len(sym) > back:
            same = row[back:] == row[:-back]
            shifted[back:][same] = sym[:-back][same]
        code |= shifted << np.uint64(16 * back)
    return code, row, letters


@dataclass
class Models:
    """For each order the sorted codes and their log2 probabilities (a column a language); contexts and their weights."""

    languages: list[str]
    codes: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    unseen: float
    calibration: dict

    def score(self, code: np.ndarray) -> np.ndarray:
        """log2 probabilities of n-grams by language."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        todo, add = np.arange(len(code)), None
        for order in range(ORDER, 0, -1):
            key = code[todo] & np.uint64((1 << 16 * order) - 1)
            at = np.searchsorted(self.codes[order - 1], key)
            at[at == len(self.codes[order - 1])] = 0
            hit = self.codes[order - 1][at] == key
            found = todo[hit]
            out[found] += self.logp[order - 1][at[hit]]
            todo, key = todo[~hit], key[~hit]
            if not len(todo):
                return out
            if order > 1:
                ctx = key >> np.uint64(16)
                at = np.searchsorted(self.contexts[order - 1], ctx)
                at[at == len(self.contexts[order - 1])] = 0
                seen = self.contexts[order - 1][at] == ctx
                out[todo[seen]] += self.back[order - 1][at[seen]]
        out[todo] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol, by text and language, and the letters of each text."""
        code, row, letters = sequences(texts)
        p = self.score(code)
        n = np.bincount(row, minlength=len(texts))
        total = np.stack([np.bincount(row, weights=p[:, k], minlength=len(texts)) for k in range(len(self.languages))], 1)
        return -total / np.maximum(n, 1)[:, None], letters


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from the counts of order-``ORDER`` n-grams of each language: (sorted codes, counts)."""
    languages = sorted(counts)
    levels: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang in languages:
        code, n = counts[lang]
        own = [(code, n.astype(float))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct n-grams that end so
            lower, c = np.unique(own[0][0] & np.uint64((1 << 16 * order) - 1), return_counts=True)
            own.insert(0, (lower, c.astype(float)))
        levels[lang] = own
    codes = [np.unique(np.concatenate([levels[x][o][0] for x in languages])) for o in range(ORDER)]
    size = len(codes[0]) + 1
    logp, contexts, back = [], [], []
    below = None
    for o in range(ORDER):
        union = codes[o]
        ctx = union >> np.uint64(16)
        names = np.unique(ctx)
        prob, weight = np.zeros((len(union), len(languages))), np.ones((len(names), len(languages)))
        where = np.searchsorted(names, ctx)
        for k, lang in enumerate(languages):
            code, n = levels[lang][o]
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(union, code)
            mine = where[at]
            total = np.bincount(mine, weights=n, minlength=len(names))
            kinds = np.bincount(mine, minlength=len(names))
            seen = total > 0
            weight[seen, k] = d * kinds[seen] / total[seen]
            prob[at, k] = np.maximum(n - d, 0) / total[mine]
        lower = np.full((len(union), len(languages)), 1 / size) if below is None else below[np.searchsorted(codes[o - 1], union & np.uint64((1 << 16 * o) - 1))]
        prob += weight[where] * lower
        below = prob
        logp.append(np.log2(prob).astype(np.float32))
        contexts.append(names)
        back.append(np.log2(weight).astype(np.float32))
    return Models(languages, codes, logp, contexts, back, float(np.log2(back[0].shape and 1 / size)), {})


def calibrate(models: Models, ce: np.ndarray, letters: np.ndarray, langs: list[str]) -> None:
    """Fit the score and the rejection to cross-entropies and letters of labelled texts that were not counted."""
    ok = letters > 0
    ce, letters = ce[ok], letters[ok]
    truth = np.array([models.languages.index(x) for x in langs])[ok]
    guess = ce.argmin(1)
    margin = _margin(ce, letters)
    right = (guess == truth).astype(float)
    # Logistic regression on the margin, with one prior case each way.
    x, y = np.concatenate([margin, [0.0, 0.0]]), np.concatenate([right, [0.0, 1.0]])
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    low = ce.min(1)
    mean, spread, far = np.zeros(len(models.languages)), np.ones(len(models.languages)), [np.zeros(0)]
    root = np.sqrt(np.minimum(letters, 400))
    for k in range(len(models.languages)):
        own = (truth == k) & (guess == k)
        if own.sum() >= 5:
            mean[k] = np.median(low[own])
            spread[k] = max(0.05, float(np.sqrt(np.mean(((low[own] - mean[k]) * root[own]) ** 2))))
            far.append((low[own] - mean[k]) * root[own] / spread[k])
        else:
            mean[k] = np.inf  # too few rows to tell: never rejected
    z, limit = np.concatenate(far), np.inf
    if len(z):
        # The tail of all languages' distances as an exponential, of a mean two standard errors above the one seen: few
        # calibration rows say little about so rare a distance.
        start = float(np.quantile(z, 1 - TAIL))
        tail = z[z >= start] - start
        limit = max(float(z.max()), start + float(tail.mean() * (1 + 2 / np.sqrt(len(tail))) * np.log(TAIL / REJECT_SHARE)))
    models.calibration = {"a": a, "b": max(b, 0.0), "mean": mean, "spread": spread, "limit": limit}


def _margin(ce: np.ndarray, letters: np.ndarray) -> np.ndarray:
    if ce.shape[1] < 2:
        return np.full(len(ce), 10.0)
    two = np.partition(ce, 1, axis=1)
    return np.minimum((two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(letters, 400)), 50.0)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Models | None:
    """Models of the languages in ``labelled`` (doc_id, text, lang; nulls are left out)."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("text", "lang", base.id_share().alias("share"))
    # A row a language: how many documents it has, and so the share of id hashes that holds about ``per_language``.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    limits = {lang: min(1.0, per_language / n) for lang, n in sizes.items()}
    taken, held = F.lit(False), F.lit(False)
    for lang, until in limits.items():
        taken = taken | ((F.col("lang") == lang) & (F.col("share") < until))
        held = held | ((F.col("lang") == lang) & (F.col("share") < until / 10))
    sample = rows.where(taken).withColumn("held", held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in base.row_chunks(batch):
                code, row, _ = sequences(base.texts_of(part))
                langs = np.array(part.column("lang").to_pylist(), object)[row]
                for lang in dict.fromkeys(langs):
                    codes, n = np.unique(code[langs == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), base.to_long(codes), pa.array(n)], ["lang", "code", "n"])

    grams = sample.where(~F.col("held")).select("text", "lang").mapInArrow(base.frugal(count), "lang string, code long, n long")
    # Bounded: n-grams of at most ``per_language`` documents a language. They come as Arrow columns, without a Python object a row.
    table = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        own = table.filter(pc.equal(table["lang"], lang))
        code = own["code"].to_numpy().view(np.uint64)
        order = np.argsort(code)
        counts[lang] = code[order], own["n"].to_numpy()[order]
    if not counts:
        return None
    models = kneser_ney(counts)
    # A tenth of the sample. Its whole texts stay in the tasks; a row of a few numbers a text comes back.
    spare = cross_entropies(sample.where(F.col("held") & F.col("lang").isin(list(counts))).select("text", "lang"), models)
    calibrate(models, np.array([r["ce"] for r in spare]).reshape(-1, len(counts)), np.array([r["letters"] for r in spare], np.int64), [r["lang"] for r in spare])
    return models


def cross_entropies(labelled: DataFrame, models: Models) -> list[Row]:
    """``lang``, ``letters`` and ``ce`` (bits a symbol by language) of every text."""
    shared = labelled.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models = pickle.loads(shared.value)
        for whole in batches:
            for batch in base.row_chunks(whole, most=1 << 20):
                ce, letters = own.entropies(base.texts_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(letters), pa.array(list(ce), pa.list_(pa.float64()))], ["lang", "letters", "ce"])

    out = base.batched(labelled).mapInArrow(base.frugal(run), "lang string, letters long, ce array<double>").collect()
    shared.destroy()
    return out


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models | None = pickle.loads(shared.value)
        for whole in batches:
            for batch in base.row_chunks(whole, most=1 << 20):
                yield _predict(own, batch)

    return base.id_text(docs).mapInArrow(base.frugal(run), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def known(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of ``docs``, all their columns, that :func:`identify` does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    loaded: list[Models | None] = []

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        return ~_judged(loaded[0], base.texts_of(batch))[3]

    return base.kept_rows(docs, keep)


def _judged(models: Models | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of each text."""
    n = len(texts)
    names, score, low, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    if models is not None and n:
        ce, letters = models.entropies(texts)
        best, c = ce.argmin(1), models.calibration
        low = ce.min(1)
        known = letters > 0
        score = np.where(known, 1 / (1 + np.exp(-np.clip(c["a"] + c["b"] * _margin(ce, letters), -30, 30))), 0.0)
        with np.errstate(invalid="ignore"):  # a text without a letter in a language that is never rejected
            z = (low - c["mean"][best]) * np.sqrt(np.minimum(letters, 400)) / c["spread"][best]
        rejected = ~known | (z > c["limit"])
        names = [models.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
        low = np.where(known, low, 0.0)
    return names, score, low, rejected


def _predict(models: Models | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    names, score, low, rejected = _judged(models, base.texts_of(batch))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the fold that models never learn from; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
