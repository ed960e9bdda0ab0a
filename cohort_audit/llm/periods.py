"""Operator 13 - periodic runs of words by Karp-Miller-Rosenberg naming.

Words become numbers, and every window of 2**k words gets a name from the pair of names of its halves: equal windows have equal
names, exactly (names are places in the sorted distinct pairs; nothing is hashed). The longest common extension of two places
is read off the names by descending levels, many places at a time in numpy.

A run of period q has length max(LEAST, REPEATS * q) or more, so its places i with word i = word i + q fill a stretch of at
least ``step(q)`` places, which holds a multiple of ``step(q)``. Only these multiples (about n / 2q for a period, n log n / 2
in all) are tried: those whose two words are equal are extended both ways. Of extensions with equal ends the smallest period is
the run's: by Fine and Wilf any smaller period divides it and gives the same ends.

The texts of a chunk are named together, with a number of its own at each text's end, so that no window matches across
texts. Names are kept up to windows of 2**TOP words; longer extensions repeat the top level, so memory stays within TOP + 1
numbers a word however long a text is.

The query's plants (:func:`planted`) make a tenth of the texts periodic from some word on, by the hash of the id alone.

Defined results: null and empty texts have no words, no runs, four nulls and the hashes of the empty text; very long texts are
taken whole; repeated rows, also of one id, are judged each by itself; a null id plants nothing; of runs with equal exponents the
smallest start counts, then the smallest period; an empty table gives no rows; only ``doc_id`` and ``text`` are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base

#: A run has at least so many words, and at least so many periods.
LEAST, REPEATS = 24, 3
#: The longest named windows have 2**TOP words.
TOP = 12
#: Bytes between words.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Grid places that are compared at a time.
GRID = 1 << 20
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(n: int, doc_id: int | None) -> np.ndarray:
    """For each word of a text the word that stands there instead: by the id's hash, from some word on the text repeats."""
    at = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def names(word: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of all windows of 1, 2, 4, ... words, as far as the longest text and TOP need."""
    out = [word]
    while len(out) <= TOP and 1 << len(out) <= longest:
        low, half = out[-1], 1 << (len(out) - 1)
        if len(low) <= half:
            break
        pair = low[: len(low) - half].astype(np.int64) * (int(low.max()) + 1) + low[half:]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    return out


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Number of equal words from places i and j on (``back``: up to and before them); a text's end equals nothing."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, size = levels[k], 1 << k
        live = np.arange(len(i))
        while len(live):
            x, y = (i[live] - got[live] - size, j[live] - got[live] - size) if back else (i[live] + got[live], j[live] + got[live])
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(name))
            live, x, y = live[inside], x[inside], y[inside]
            live = live[name[x] == name[y]]
            got[live] += size
            if k < len(levels) - 1:
                break  # below the top a level is taken once at most
    return got


def grid(off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places of the texts [off[t], off[t + 1]), some periods at a time."""
    n = np.diff(off)
    longest = int(n.max(initial=0))
    period = np.arange(1, longest // REPEATS + 1)
    period = period[np.maximum(LEAST, REPEATS * period) <= longest]
    step = np.maximum(LEAST, REPEATS * period) - period
    by_size = np.argsort(-n, kind="stable")
    sizes = -n[by_size]
    fits = np.searchsorted(sizes, -np.maximum(LEAST, REPEATS * period), "right")  # texts long enough for a period
    total = np.cumsum(n[by_size])
    places = np.cumsum(total[fits - 1] // step + fits)  # at least as many as there are
    lo = 0
    while lo < len(period):
        hi = max(lo + 1, int(np.searchsorted(places, (places[lo - 1] if lo else 0) + GRID, "right")))
        q, g = np.repeat(period[lo:hi], fits[lo:hi]), np.repeat(step[lo:hi], fits[lo:hi])
        texts = by_size[np.arange(len(q)) - np.repeat(np.cumsum(fits[lo:hi]) - fits[lo:hi], fits[lo:hi])]
        count = (n[texts] - q - 1) // g + 1
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(off[texts], count) + inner * np.repeat(g, count), np.repeat(q, count)
        lo = hi


def runs_of(word: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the texts word[off[t]:off[t + 1]], by start, then period. Words are numbers from 0."""
    n, rows = len(word), len(off) - 1
    at = np.arange(n) + np.repeat(np.arange(rows), np.diff(off))  # each text ends in a number of its own
    marked = np.zeros(n + rows, np.int64)
    marked[at] = word
    marked[off[1:] + np.arange(rows)] = (int(word.max()) if n else 0) + 1 + np.arange(rows)
    begin = off + np.arange(rows + 1)
    levels, found = None, []
    for i, q in grid(off):
        i = i + np.searchsorted(off, i, "right") - 1
        same = marked[i] == marked[i + q]
        i, q = i[same], q[same]
        if not len(i):
            continue
        levels = levels or names(marked.astype(np.int32), int(np.diff(off).max()))
        right = extension(levels, i, i + q)
        enough = np.maximum(LEAST, REPEATS * q) - q
        left = extension(levels, i, i + q, back=True)
        ok = left + right >= enough
        found.append(np.unique(np.stack([(i - left)[ok], (i + q + right)[ok], q[ok]], 1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    text = np.searchsorted(begin, out[:, 0], "right") - 1
    out[:, :2] -= text[:, None]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def best(runs: np.ndarray) -> int:
    """The run of greatest exact length / period; ties go to the smallest start, then period."""
    at = 0
    for k in range(1, len(runs)):  # a text's runs are few: by their number below 1.5 n, here those of three periods
        if int(runs[k, 1] - runs[k, 0]) * int(runs[at, 2]) > int(runs[at, 1] - runs[at, 0]) * int(runs[k, 2]):
            at = k
    return at


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row a document: its runs, the one of greatest exponent, and hashes of all runs and of the text without repeats.

    ``plant`` first makes some texts periodic, as :func:`planted` says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, size in base.byte_chunks(batch):
                ids = batch.column("doc_id").slice(lo, hi - lo)
                inside = ~SPACE[data]
                begin, end, row = base.runs(inside, size)
                off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
                at = np.arange(len(begin))
                if plant:
                    at = np.concatenate([at[:0], *(off[t] + planted(int(off[t + 1] - off[t]), d) for t, d in enumerate(ids.to_pylist()))])
                word = words.dictionary_encode().indices.to_numpy().astype(np.int64)[at]
                runs = runs_of(word, off)
                drop = np.zeros(len(word) + 1, np.int64)
                np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                np.add.at(drop, runs[:, 1], -1)
                kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
                lists = pa.LargeListArray.from_arrays(np.searchsorted(kept, off).astype(np.int64), words.take(pa.array(at[kept], pa.int64())))
                collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
                cut, out = np.searchsorted(runs[:, 0], off), []
                for t in range(hi - lo):
                    own, row = runs[cut[t] : cut[t + 1]] - [off[t], off[t], 0], (None,) * 4
                    if len(own):
                        s, e, q = own[best(own)].tolist()
                        row = (s, e - s, q, 1000 * (e - s) // q)
                    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own.tolist())
                    out.append((len(own), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed[t].as_buffer()).hexdigest()))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    return base.id_text(docs).mapInArrow(run, SCHEMA)
