"""Operator 7 - packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers, however many documents) comes to the driver. The program
has a variable for each configuration (multiset of lengths that fits a sequence) and asks for the fewest sequences that cover
every length as often as it occurs. It is solved by multiplicative weights: each round a knapsack dynamic program prices all
configurations, those of nearly the best price are taken as far as they cover no length more than wholly, and a length's weight
falls with how much of it the round covered. The rounds' sum, scaled until every length is covered, is a fractional solution;
the weights give a lower bound on any packing (:func:`program`). Shares of the solution are rounded down to whole
sequences that hold no length too often, what is left is placed best-fit decreasing, on groups of equal sequences, and the
plan of the fewest sequences stays. Pieces then find their place by the rank among pieces of their length.

Defined results: null text is the empty text, which still has its end id; documents longer than ``capacity`` are cut into
full pieces with a shorter first one; repeated rows are packed as often as they occur; pieces of equal length are
interchangeable, and which of them goes where follows the order in which Spark reads them; an empty table gives no rows; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, tokens

#: Rounds of multiplicative weights, rate of the weights' change, how far below the best price a configuration is taken, and
#: the shares of the fractional solution of which the best rounding stays.
ROUNDS, RATE, NEAR, SHARES = 100, 0.5, 0.02, (1.0, 0.8, 0.6, 0.4, 0.2, 0.1)
#: Distinct parts that a worker remembers: the pipeline packs beside a full heap of the JVM.
MEMO = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


@lru_cache(4)
def _encoder(path: str) -> tokens.Encoder:
    return tokens.Encoder(path, memo=MEMO)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents, each with its task and its rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        tail = np.array([end_id], encoder.dtype).tobytes()
        seen = [0] * (capacity + 1)
        for whole in batches:
            for batch in base.row_chunks(whole, most=tokens.CHUNK_BYTES):
                rows: list[tuple] = []
                for doc, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(base.texts_of(batch)), strict=True):
                    raw = memoryview(np.frombuffer(x + tail, encoder.dtype).astype("<u4").tobytes())
                    n = len(raw) // 4
                    at = 0
                    end = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        rows.append((doc, piece, at, end - at, zlib.crc32(raw[4 * at : 4 * end]), task, seen[end - at]))
                        seen[end - at] += 1
                        at, end = end, end + capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    return base.id_text(docs).mapInArrow(base.frugal(run), PIECES)


def knapsack(lengths: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest weight that fits each room (unbounded knapsack), and the length taken last (the longest of equals; -1: none)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    down, worth = lengths[::-1], weight[::-1]
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        gain = best[c - down[-k:]] + worth[-k:]
        i = int(gain.argmax())
        best[c], took[c] = (gain[i], k - 1 - i) if gain[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    return best, took


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE, near: float = NEAR) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """A fractional solution of the covering program by multiplicative weights.

    ``lengths`` ascend. Returns how often each configuration (places of its lengths, ascending) is taken, how much of each
    length's demand that covers (1 in the mean over all tokens), and a lower bound on the sequences of any packing.
    """
    weight = lengths / capacity
    tokens = lengths * demand / (lengths @ demand)
    taken: dict[tuple[int, ...], float] = {}
    covered, mean, bound = np.zeros(len(lengths)), np.zeros(len(lengths)), 0.0
    for _ in range(rounds):
        best, took = knapsack(lengths, weight, capacity)
        mean += weight / best[capacity]
        bound = max(bound, float(weight @ demand / best[capacity]))  # the weights over the best price are a dual solution
        columns = []
        for i in np.flatnonzero(weight + best[capacity - lengths] >= (1 - near) * best[capacity]).tolist():  # the best with each length
            room, column = capacity - int(lengths[i]), [i]
            while room > 0:
                j = int(took[room])
                room -= 1 if j < 0 else int(lengths[j])
                column += [] if j < 0 else [j]
            columns.append((i, np.array(sorted(column))))
        times = np.array([demand[i] / np.count_nonzero(c == i) for i, c in columns])
        items, sizes = np.concatenate([c for _, c in columns]), [len(c) for _, c in columns]
        share = np.bincount(items, np.repeat(times, sizes), len(lengths)) / demand
        times /= np.maximum(1, np.maximum.reduceat(share[items], np.cumsum(sizes) - sizes))
        share = np.bincount(items, np.repeat(times, sizes), len(lengths)) / demand
        for (_, c), t in zip(columns, times.tolist(), strict=True):
            key = tuple(c.tolist())
            taken[key] = taken.get(key, 0.0) + t
        covered += share
        weight = weight * np.exp(-rate * (share - share @ tokens))
    bound = max(bound, float(mean @ demand / knapsack(lengths, mean, capacity)[0][capacity]))
    scale = float(covered @ tokens)
    return {c: t / scale for c, t in taken.items()}, covered / scale, bound


def configurations(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, how often) that hold every piece of the histogram exactly once."""
    left = {n: k for n, k in histogram.items() if k > 0}
    out: list[tuple[dict[int, int], int]] = []
    if capacity in left:
        out.append(({capacity: 1}, left.pop(capacity)))
    if not left:
        return out
    lengths = np.array(sorted(left))
    demand = np.array([left[n] for n in lengths])
    taken, _, _ = program(lengths, demand, capacity, rounds)
    columns = [(*np.unique(c, return_counts=True), t) for c, t in sorted(taken.items(), key=lambda x: (-x[1], x[0]))]
    plans = [rounded(columns, lengths, demand, capacity, share) for share in SHARES]
    return out + min(plans, key=lambda plan: sum(times for _, times in plan))


def rounded(columns: list[tuple], lengths: np.ndarray, demand: np.ndarray, capacity: int, share: float) -> list[tuple[dict[int, int], int]]:
    """Whole sequences of a share of a fractional solution that hold no length too often, and best-fit for the rest."""
    rest, out = demand.copy(), []
    for at, counts, times in columns:
        k = int(min(share * times, (rest[at] // counts).min()))
        if k > 0:
            rest[at] -= k * counts
            out.append(({int(n): int(c) for n, c in zip(lengths[at], counts, strict=True)}, k))
    return out + best_fit({int(n): int(k) for n, k in zip(lengths, rest, strict=True) if k}, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: equal sequences are one group, so the work doesn't grow with the pieces."""
    groups: dict[int, dict[tuple, int]] = {}  # free space -> configuration -> how often

    def put(free: int, config: tuple, times: int) -> None:
        at = groups.setdefault(free, {})
        at[config] = at.get(config, 0) + times

    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            free = min((f for f in groups if f >= n), default=None)
            if free is None:
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, ((n, each),), todo // each)
                    todo %= each
                if todo:
                    put(capacity - todo * n, ((n, todo),), 1)
                break
            config, times = groups[free].popitem()
            if not groups[free]:
                del groups[free]
            each = min(free // n, todo)
            full = min(times, todo // each)
            put(free - each * n, (*config, (n, each)), full)
            if times > full:
                put(free, config, times - full)
            todo -= each * full
    out = []
    for at in groups.values():
        for config, times in at.items():
            merged: dict[int, int] = {}
            for n, c in config:
                merged[n] = merged.get(n, 0) + c
            out.append((merged, times))
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how many a sequence, first sequence, offset in the sequence) of each share of a plan."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for config, times in plan:
        at = 0
        for n, c in sorted(config.items(), reverse=True):
            first = taken.get(n, 0)
            out.append((n, first, first + c * times, c, sequence, at))
            taken[n] = first + c * times
            at += n * c
        sequence += times
    return out


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, rounds: int = ROUNDS) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = base.stored(pieces(docs, path, end_id, capacity), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most ``capacity`` rows, whatever the input: bounded for the driver.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = places(configurations(histogram, capacity, rounds))
    # Its rows come from configurations over at most ``capacity`` lengths, not from documents.
    table = spark.createDataFrame(shares or [(0, 0, 0, 1, 0, 0)], "length long, first long, until long, each long, sequence long, at long")
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    within = F.col("rank") - F.col("first")
    slot = F.pmod(within, F.col("each"))
    return placed.select("doc_id", "piece", "start", cut["length"], "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"), (F.col("at") + slot * cut["length"]).alias("offset"))
