"""Operator 3 - removal of strings that repeat across the corpus.

A unit (a byte, or a word with ``unit="words"``) goes if a string of ``minimum`` units that covers it also starts anywhere
else in the corpus. The work is split by content, so that strings that may be equal meet in one task and nothing else does:

1. Each string of ``minimum`` units picks an anchor, the least hash of its windows of ``anchor`` units (winnowing). Equal
   strings pick the same anchor at the same distance; neighbouring strings mostly share one. A *context* is the stretch of
   all neighbouring strings with one anchor.
2. Contexts are compared by anchor and 128-bit hash: a context that occurs twice is repeated as a whole. An anchor with one
   context is done. Only anchors with different contexts need their units.
3. Those contexts are put together by anchor in blocks of bounded size. Strings at about the same distance from the anchor
   share a core; where a core occurs once among an anchor's contexts its strings do too, and are left out. The suffix array
   and Burrows-Wheeler transform of the rest of a block are built, and intervals are extended backwards breadth-first, which settles longest common prefixes by
   increasing value, up to ``minimum``; neighbours still open then share at least ``minimum`` units. Contexts end in a
   separator that no extension passes, so no match crosses documents.
4. Anchors with more than ``HOT`` contexts never meet in a task: their contexts are cut into ever narrower classes of
   strings (widths ``REFINE``), keyed by what all strings of the class share, and counted by hash, until a class is one
   string. Keys that many contexts share are split over tasks where only membership is asked.

Words are runs of anything but space and the bytes 9 to 13, compared by 64-bit hash. :data:`BYTES` is the operator's measure;
:data:`PASSAGES` finds passages of over 50 words, whatever their length in bytes: a passage of 51 words whose first and last
word run into their neighbours still has 49 whole ones.

Defined results: null text is the empty text; a text of fewer than ``minimum`` units keeps all, however long texts are taken
whole; repeated rows are documents of their own, whatever their ids, so all their strings of ``minimum`` units go; every place
of a repeated string counts alike, so there are no ties; strings are judged on the input; an empty table gives no rows; only
``doc_id`` and ``text`` are read, and further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


@dataclass(frozen=True)
class Measure:
    """What a string is made of, how many units repeat at least, and the units of an anchor."""

    unit: str
    minimum: int
    anchor: int

    @property
    def dtype(self) -> np.dtype:
        """How contexts are kept: bytes, or 64-bit hashes of words."""
        return np.dtype(np.uint8 if self.unit == "bytes" else "<u8")

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of a chunk and the offsets of its rows in them."""
        if self.unit == "bytes":
            return data, off
        start, end, row = base.runs(~SPACE[data], off)
        n = np.bincount(row, minlength=len(off) - 1)
        return base.mix(base.Rolling(data, 3).of(start, end) ^ (end - start).astype(np.uint64), 4), np.concatenate([[0], np.cumsum(n)])


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTES, PASSAGES = Measure("bytes", 400, 48), Measure("words", 49, 8)
HOT, REFINE, CORES = 1000, (64, 8, 1), 8
BLOCK_UNITS = 1 << 20


# ---- the interval expansion ------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols from 0 by prefix doubling; only groups still tied are sorted again."""
    n = len(text)
    bits = int(text.max() + 1).bit_length()
    width = min(n, 63 // bits)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: n - i] |= text[i:] + 1  # 0 is past the end
    order = np.argsort(key)
    slots = np.arange(n)
    sa, rank, h = order.copy(), np.zeros(n, np.int64), width
    idx, key = order, key[order]
    while True:
        new = np.ones(len(idx), bool)
        new[1:] = key[1:] != key[:-1]
        rank[idx] = np.maximum.accumulate(np.where(new, slots, 0))
        alone = new.copy()
        alone[:-1] &= new[1:]
        idx, slots = idx[~alone], slots[~alone]
        if not len(idx):
            return sa
        after = idx + h
        key = rank[idx] << 32
        there = after < n
        key[there] |= rank[after[there]] + 1
        order = np.argsort(key)
        idx, key = idx[order], key[order]
        sa[slots] = idx
        h *= 2


def shares_prefix(text: np.ndarray, sa: np.ndarray, minimum: int) -> np.ndarray:
    """For each place of the suffix array: false if its common prefix with the place before was found shorter than ``minimum``.

    Symbol 0 separates and is never extended over; places whose suffix has a separator within ``minimum`` symbols are not
    to be used.
    """
    n = len(text)
    bwt = text[sa - 1].astype(np.uint16 if text.max() < 1 << 16 else np.int64)
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following, previous = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    settled = np.zeros(n + 1, bool)
    settled[0] = settled[n] = True
    count = np.bincount(text, minlength=2)
    end = np.cumsum(count)
    symbols = np.flatnonzero(count[1:]) + 1
    low, high = (end - count)[symbols], end[symbols] - 1
    for _ in range(minimum):
        open_ = ~settled[high + 1]
        low, high = low[open_], high[open_]
        if not len(low):
            break
        settled[high + 1] = True
        size = high - low + 1
        at = np.arange(int(size.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        word = bwt[at] > 0
        last = word & (following[at] > np.repeat(high, size))
        first = word & (previous[at] < np.repeat(low, size))
        high, low = np.sort(step[at[last]]).astype(np.int64), np.sort(step[at[first]]).astype(np.int64)
    return ~settled[:n]


def repeated_starts(contexts: list[np.ndarray], minimum: int) -> list[np.ndarray]:
    """For each context the starts of strings of ``minimum`` units that start at another place of the contexts too."""
    length = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(length + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    units = np.concatenate(contexts)
    text[inside] = (units if units.dtype == np.uint8 else np.unique(units, return_inverse=True)[1]).astype(np.int64) + 1
    sa = suffix_array(text)
    room = np.repeat(ends - 1, length + 1) - np.arange(len(text)) >= minimum
    fits = room[sa]
    pair = shares_prefix(text, sa, minimum)
    pair[1:] &= fits[1:] & fits[:-1]
    pair[0] = False
    hit = np.zeros(len(text), bool)
    at = np.flatnonzero(pair)
    hit[sa[at]] = True
    hit[sa[at - 1]] = True
    starts = ends - length - 1
    return [np.flatnonzero(hit[a:b]) for a, b in zip(starts, ends, strict=True)]


def alike(data: list[np.ndarray], anchor: np.ndarray, back: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first start, last start) of the stretches of strings that can occur in another context of their anchor.

    ``back`` is the distance of the anchor from the context's start. The strings of a context are cut into ``CORES`` classes
    by their distance to the anchor; those of one class share its core, so a core of one context alone rules them out.
    """
    width = (measure.minimum - measure.anchor) // CORES + 1
    length = np.array([len(x) for x in data])
    most = back  # greatest and least distance of a string's start to the anchor
    least = back - (length - measure.minimum)
    n = most // width - least // width + 1
    row = np.repeat(np.arange(len(data)), n)
    kind = np.repeat(least // width, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(length) - length + back, n)
    core = base.Rolling(np.concatenate(data), 17).of(place - kind * width, place - (kind + 1) * width + 1 + measure.minimum)
    key = base.mix(base.mix(core, 18) ^ anchor[row].view(np.uint64) ^ base.mix(kind, 19), 20)
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[of] > 1)
    row, kind = row[at], kind[at]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    row = row[first]
    far, near = np.minimum(most[row], kind[last] * width + width - 1), np.maximum(least[row], kind[first] * width)
    return row, back[row] - far, back[row] - near


def spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


# ---- anchors and contexts --------------------------------------------------------------------------------------------


def anchors(units: np.ndarray, off: np.ndarray, measure: Measure = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor place, first start, last start) of each context of a chunk; places count from the chunk's start."""
    none = np.zeros(0, np.int64)
    minimum, anchor = measure.minimum, measure.anchor
    n, w = len(units), minimum - anchor + 1
    if n < minimum:
        return none, none, none, none
    m = n - anchor + 1
    value = base.mix(base.Rolling(units, 7).of(slice(0, m), slice(anchor, None)), 8)
    # The first place of the least value of each window of w: 32 bits of the value stand before the place, and the least is
    # taken by prefixes and suffixes of blocks of w.
    low = np.uint64(32)
    value = (value >> low << low) | np.arange(m, dtype=np.uint64)
    blocks = np.concatenate([value, np.full(-m % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    fits = np.repeat(off[1:], np.diff(off))[: n - minimum + 1] >= np.arange(minimum, n + 1)
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none, none, none, none
    place = (np.minimum(back[starts], ahead[starts + w - 1]) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], len(starts)) - 1
    s0, s1 = starts[begin], starts[final]
    return np.searchsorted(off, s0, "right") - 1, place[begin], s0, s1


_CONTEXT = "did long, key long, anchor long, back int, first int, last int, c1 long, c2 long"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key that tells rows of one id and different texts apart."""
    return base.id_text(docs).select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("doc_id", "text").alias("key"), "text")


def contexts_of(docs: DataFrame, measure: Measure) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, ends in base.byte_chunks(batch):
                units, off = measure.units(data, ends)
                row, place, s0, s1 = anchors(units, off, measure)
                if not len(row):
                    continue
                name = base.mix(base.Rolling(units, 9).of(place, place + measure.anchor), 10)
                c1, c2 = (base.mix(base.Rolling(units, s).of(s0, s1 + measure.minimum) ^ (s1 - s0).astype(np.uint64), s) for s in (11, 12))
                at = pa.array(row + lo)
                ints = [pa.array(x.astype(np.int32)) for x in (place - s0, s0 - off[row], s1 - off[row])]
                yield pa.RecordBatch.from_arrays([batch.column("did").take(at), batch.column("key").take(at), base.to_long(name), *ints, base.to_long(c1), base.to_long(c2)], ["did", "key", "anchor", "back", "first", "last", "c1", "c2"])

    return docs.select("did", "key", "text").mapInArrow(base.frugal(run), _CONTEXT)


def _slices(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """The units of contexts: ``wanted`` has did, key, anchor, back, first, last, settled, hot."""
    lists = wanted.groupBy("did", "key").agg(F.collect_list(F.struct("anchor", "back", "first", "last", "settled", "hot")).alias("cuts"))  # at most a text's own contexts
    joined = docs.select("did", "key", "text").join(lists, ["did", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "key", "anchor", "back", "first", "last", "settled", "hot", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
        for whole in batches:
            for batch in base.row_chunks(whole, most=1 << 20):
                out: list[tuple] = []
                at = 0
                columns = [batch.column(c).to_pylist() for c in ("did", "key", "cuts")]
                for _, _, data, ends in base.byte_chunks(batch):
                    units, off = measure.units(data, ends)
                    for i in range(len(off) - 1):
                        did, key, cuts = (c[at] for c in columns)
                        at += 1
                        raw = units[off[i] : off[i + 1]]
                        out += [(did, key, c["anchor"], c["back"], c["first"], c["last"], c["settled"], c["hot"], raw[c["first"] : c["last"] + measure.minimum].tobytes()) for c in cuts]
                for i in range(0, len(out), 2000):
                    cols = zip(*out[i : i + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return joined.mapInArrow(base.frugal(run), "did long, key long, anchor long, back int, first int, last int, settled boolean, hot boolean, data binary")


_MARKS = "did long, key long, lo int, hi int"


def _marks_of_blocks(slices: DataFrame, measure: Measure) -> DataFrame:
    """Marks (first and last start of repeated strings) of contexts that meet by anchor in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[tuple] = []
            data = [np.frombuffer(x["data"], measure.dtype) for x in held]
            cuts = alike(data, np.array([x["anchor"] for x in held]), np.array([x["back"] for x in held]), measure)
            parts = [data[i][a : b + measure.minimum] for i, a, b in zip(*cuts, strict=True)]
            for i, a, starts in zip(*cuts[:2], repeated_starts(parts, measure.minimum) if parts else [], strict=True):
                r = held[i]
                if not r["settled"]:
                    out += [(r["did"], r["key"], r["first"] + int(a + x), r["first"] + int(a + y)) for x, y in zip(*spans(starts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["did", "key", "lo", "hi"])

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                for r in batch.slice(i, 500).to_pylist():
                    if size > BLOCK_UNITS * measure.dtype.itemsize and r["anchor"] != held[-1]["anchor"]:
                        yield flush()
                        held, size = [], 0
                    held.append(r)
                    size += len(r["data"]) + measure.dtype.itemsize
        if held:
            yield flush()

    cols = slices.select("did", "key", "anchor", "back", "first", "settled", "data")
    return cols.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(base.frugal(run), _MARKS)


def _classes(level: DataFrame, width: int, measure: Measure) -> DataFrame:
    """Cut each stretch of starts (lo to hi, counted from the anchor) into classes of ``width``; hash what they share and hold."""
    minimum, size = measure.minimum, measure.dtype.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "lo", "hi", "weight", "kind", "core1", "core2", "all1", "all2"]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                data = part.column("data").cast(pa.large_binary())
                off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                units = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]].copy().view(measure.dtype)
                base_at = (off[:-1] - off[0]) // size
                lo, hi, back = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "back"))
                kinds = hi // width - lo // width + 1
                row = np.repeat(np.arange(len(lo)), kinds)
                kind = np.arange(int(kinds.sum())) - np.repeat(np.concatenate([[0], np.cumsum(kinds)[:-1]]), kinds) + (lo // width)[row]
                a, b = kind * width, kind * width + width - 1
                low, high = np.maximum(a, lo[row]), np.minimum(b, hi[row])
                zero = base_at[row] + back[row]  # where the anchor lies
                cols = []
                for seed in (13, 14):
                    roll = base.Rolling(units, seed)
                    cols.append(base.mix(roll.of(zero + b, zero + a + minimum), seed))
                for seed in (15, 16):
                    cols.append(base.mix(base.Rolling(units, seed).of(zero + low, zero + high + minimum), seed))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("sid").take(at), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), part.column("weight").take(at), pa.array(kind.astype(np.int32)), *map(base.to_long, cols)], names)

    return level.select("sid", "back", "lo", "hi", "weight", "data").mapInArrow(base.frugal(run), "sid long, lo int, hi int, weight int, kind int, core1 long, core2 long, all1 long, all2 long")


def _marks_of_hot(slices: DataFrame, measure: Measure, scratch: base.Scratch) -> DataFrame | None:
    """Marks of contexts of hot anchors, by ever narrower classes that are only counted."""
    hot = scratch.stored(slices.withColumn("sid", F.monotonically_increasing_id()), "hot")
    if hot.isEmpty():
        return None
    level = hot.select("sid", "back", (-F.col("back")).alias("lo"), (F.col("last") - F.col("first") - F.col("back")).alias("hi"), F.when(F.col("settled"), 2).otherwise(1).alias("weight"), "data")
    marks = None
    for width in (x for x in REFINE if x == 1 or 4 * x <= measure.minimum):
        rows = scratch.stored(_classes(level, width, measure), "classes")
        same = ["kind", "core1", "core2", "all1", "all2", "lo", "hi"]
        held = scratch.stored(rows.groupBy(*same).agg(F.sum("weight").alias("n"), F.first("sid").alias("sid")), "held")
        twice = base.split_join(rows.where("weight = 1"), held.where("n > 1").select(*same), same, held.where(F.col("n") > base.HEAVY), ["sid"]).select("sid", "lo", "hi")
        marks = twice if marks is None else marks.union(twice)
        if width == 1:
            break
        mixed = held.groupBy("kind", "core1", "core2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        left = base.split_join(held, mixed, ["kind", "core1", "core2"], mixed.where(F.col("m") > base.HEAVY), ["sid", "all1"]).select("sid", "lo", "hi", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
        level = left.join(hot.select("sid", "back", "data"), "sid")
    return marks.join(hot.select("sid", "did", "key", "first", "back"), "sid").select("did", "key", (F.col("first") + F.col("back") + F.col("lo")).alias("lo"), (F.col("first") + F.col("back") + F.col("hi")).alias("hi"))


def repeated(docs: DataFrame, measure: Measure = BYTES) -> DataFrame:
    """Marks of documents (from :func:`_keyed`) that have any: did, key and an array of (lo, hi) of starts of repeated strings."""
    scratch = base.Scratch(docs.sparkSession)
    table = scratch.stored(contexts_of(docs, measure), "contexts")
    own = ["anchor", "c1", "c2", "back"]
    held = scratch.stored(table.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("did", "key", "first", "last"))), "held")
    twice = base.split_join(table, held.where("n > 1").select(*own), own, held.where(F.col("n") > base.HEAVY), ["did", "key", "first"])
    whole = twice.select("did", "key", F.col("first").alias("lo"), F.col("last").alias("hi"))
    kinds = held.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = base.split_join(held, kinds, ["anchor"], kinds.where(F.col("m") > base.HEAVY), ["did", "key", "first"])
    wanted = wanted.select("did", "key", "anchor", "back", "first", "last", (F.col("n") > 1).alias("settled"), (F.col("m") > HOT).alias("hot"))
    slices = scratch.stored(_slices(docs, wanted, measure), "slices")
    marks = whole.union(_marks_of_blocks(slices.where("not hot"), measure))
    hot = _marks_of_hot(slices.where("hot"), measure, scratch)
    if hot is not None:
        marks = marks.union(hot)
    lists = marks.groupBy("did", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))  # at most a text's own contexts
    out = base.stored(lists, "marks")
    scratch.clear()
    return out


_WORD = re.compile(rb"[^ \t-\r]+")


def covered(raw: bytes, marks, measure: Measure) -> list[tuple[int, int]]:
    """Maximal removed runs of the bytes of a text."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((m["lo"], m["hi"] + measure.minimum) for m in ([] if marks is None else marks)):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    if out and measure.unit == "words":
        words = [m.span() for m in _WORD.finditer(raw)]
        return [(words[a][0], words[b - 1][1]) for a, b in out]
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def removed(docs: DataFrame, measure: Measure = BYTES, passages: Measure | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every document.

    With ``passages`` also ``n_passages`` and ``passage_bytes``: the maximal runs, and their bytes, that this second measure
    finds in the input.
    """
    keyed = _keyed(docs)
    found = keyed.join(repeated(keyed, measure), ["did", "key"], "left")
    others = repeated(keyed, passages).withColumnRenamed("marks", "others") if passages else None
    found = found.withColumn("others", F.lit(None).cast("boolean")) if others is None else found.join(others, ["did", "key"], "left")
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 * bool(passages)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passages", "passage_bytes"] if passages else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.row_chunks(whole, most=1 << 20):
                rows: list[tuple] = []
                for text, marks, more in zip(base.texts_of(batch), batch.column("marks").to_pylist(), batch.column("others").to_pylist(), strict=True):
                    raw = text.encode("utf-8")
                    runs = covered(raw, marks, measure)
                    row = (len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest())
                    if passages:
                        runs = covered(raw, more, passages)
                        row = (*row, len(runs), sum(b - a for a, b in runs))
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} {'string' if n == 'kept_sha256' else 'long'}" for n in names)
    return found.select("doc_id", "text", "marks", "others").mapInArrow(base.frugal(run), schema)


def without_repeats(docs: DataFrame, measure: Measure = BYTES) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; a character of which a cut took some bytes goes as a whole.

    A null text stays null. Other columns stay as they are.
    """
    keyed = docs.select(base.whole_row(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    marks = repeated(_keyed(docs), measure)

    @F.pandas_udf("string")
    def cut(text, found):
        import pandas as pd

        out = []
        for t, m in zip(text, found, strict=True):
            if t is None or m is None or not len(m):
                out.append(t)
            else:
                raw = t.encode("utf-8")
                out.append(_kept(raw, covered(raw, m, measure)).decode("utf-8", "ignore"))
        base.give_back()
        return pd.Series(out)

    joined = keyed.join(marks, ["did", "key"], "left").withColumn("cut", cut(F.col("row.text"), "marks"))
    return joined.select(F.col("row").withField("text", F.col("cut")).alias("row")).select("row.*")
