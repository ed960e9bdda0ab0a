"""Operator 1 - near-duplicate classes by ProbMinHash, banding and exact verification.

A text's elements are its distinct shingles of ``WORDS`` words, each of weight 1, so that a passage repeated many times counts
as once, as it does in verification. Each element is a Poisson process with its weight as rate: its arrivals fall on random
registers, and it stops as soon as its next arrival is later than every register (early termination). Two texts agree in a
register with the probability Jaccard similarity of their weights, which for weights of 1 is about that of their sets.
Registers are banded; texts that share a band are candidates, and candidates are verified by the exact Jaccard similarity
of their shingle sets. Verified links make classes: the connected components.

Equal word sequences are one node. In a band's bucket only links to the bucket's first node are tried at first; nodes of a
bucket that are then still in different classes are joined among each other by exact prefix filtering on their shingles, so
no link between classes is lost, while a bucket of n near copies of one text costs about n pairs. Every step is a join or an aggregation of Spark; nothing of all documents
comes to the driver, and each step's table is written to the shared folder.

Words are runs of ASCII letters and digits and of characters beyond ASCII; ASCII case is folded. Defined results: a text of
1 to 4 words has one shingle, all of them; texts without a word (null and empty ones too) are linked only if they are equal.
Long texts are taken whole. Rows with equal ``doc_id`` are one document, linked by any of its texts; a null ``doc_id`` has a null
class. A class is named by its least id, so there are no ties; an empty table gives no rows; only ``doc_id`` and ``text`` are
read, and further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

WORDS, SIMILARITY = 5, 0.8
#: 128 registers, 25 bands of 5: a pair of similarity 0.8 is missed with probability 5e-5.
REGISTERS, BANDS, ROWS = 128, 25, 5


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of a chunk."""
    folded = base.FOLD[data]
    start, end, row = base.runs(folded > 0, off)
    return base.mix(base.Rolling(folded, 3).of(start, end) ^ (end - start).astype(np.uint64), 4), row


def shingle_hashes(word: np.ndarray, row: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle; a row of fewer words has one."""
    n = len(word)
    if not n:
        return word, row
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    last = np.append(np.flatnonzero(first)[1:], n)  # end of each row's words
    size = last - np.flatnonzero(first)
    left = np.repeat(last, size) - np.arange(n)  # words from here to the row's end
    begins = (left >= words) | (first & (left < words))
    at = np.flatnonzero(begins)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            there = left[at] > i
            h[there] += base.mix(word[at[there] + i], 20 + i)
    return base.mix(h, 5), row[at]


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in ascending order, and their counts."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """ProbMinHash signatures: for each row and register the element that arrives first (0 where a row has no element)."""
    time = np.full(rows * REGISTERS, np.inf)
    winner = np.zeros(rows * REGISTERS, np.uint64)
    live, at = np.arange(len(h)), np.zeros(len(h))
    step = 0
    while len(live):
        draw = base.mix(h[live], 1000 + step)
        at[live] -= np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[live]
        key = row[live] * REGISTERS + (draw & np.uint64(REGISTERS - 1)).astype(np.int64)
        x = at[live]
        np.minimum.at(time, key, x)
        won = x == time[key]
        winner[key[won]] = h[live[won]]
        latest = time.reshape(rows, REGISTERS).max(axis=1)
        live = live[x < latest[row[live]]]
        step += 1
    return winner.reshape(rows, REGISTERS)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One hash for each row and band; bands differ by construction."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            for r in range(ROWS):
                out[:, b] += base.mix(signature[:, b * ROWS + r], 50 + r)
            out[:, b] = base.mix(out[:, b], 200 + b)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, two hashes of the word sequence and the band hashes (null where a text has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in base.byte_chunks(batch):
                rows = hi - lo
                word, row = word_hashes(data, off)
                n = np.bincount(row, minlength=rows)
                begin = np.concatenate([[0], np.cumsum(n)])
                place = (np.arange(len(word)) - begin[row]).astype(np.uint64)
                keys = []
                with np.errstate(over="ignore"):
                    for seed in (31, 32):
                        sums = np.zeros(len(word) + 1, np.uint64)
                        np.cumsum(base.mix(word + base.mix(place, seed), seed), out=sums[1:])
                        own = sums[begin[1:]] - sums[begin[:-1]]
                        for i in np.flatnonzero(n == 0):  # no word: the text itself
                            own[i] = int.from_bytes(hashlib.blake2b(data[off[i] : off[i + 1]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
                        keys.append(own)
                h, of, _ = weighted(*shingle_hashes(word, row))
                bands = band_hashes(signatures(h, of, np.ones(len(h)), rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), base.to_long(bands.ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, rows), base.to_long(keys[0]), base.to_long(keys[1]), lists], ["doc_id", "k1", "k2", "bands"])

    return base.id_text(docs).mapInArrow(base.frugal(run), "doc_id long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the sorted distinct shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in base.byte_chunks(batch):
                h, row, _ = weighted(*shingle_hashes(*word_hashes(data, off)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), base.to_long(h))], ["doc_id", "shingles"])

    return base.id_text(docs).mapInArrow(base.frugal(run), "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets have at least that Jaccard similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    def heavy(c: str) -> DataFrame:
        return pairs.groupBy(c).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > base.HEAVY)

    both = F.size(F.array_intersect("x", "y"))
    # Sizes alone rule out pairs before the sets are intersected.
    near = (F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))) & (both >= similarity * (F.size("x") + F.size("y") - both))
    return base.split_join(base.split_join(pairs, right, ["b"], heavy("b"), ["a"]), left, ["a"], heavy("a"), ["b"]).where(near).select("a", "b")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float, scratch: base.Scratch | None = None) -> DataFrame:
    """All pairs (a, b) of ``nodes`` (node, of) of different ``of`` that can have the similarity, by prefix filtering.

    Sets of n shingles that are similar enough share one of their n - ceil(similarity * n) + 1 rarest shingles, whatever
    fixed order of rarity is taken; and what both have from the first shared shingle on must still be enough (positional
    filter). For the smaller set of a pair that means one of its n - ceil(2 * similarity / (1 + similarity) * n) + 1 rarest, so
    only these are looked up, by the shingles of sets that are as large or larger. A text's own edits are its rarest shingles:
    texts that share a template and are too far for a link have more of them than the smaller set's share, so
    the template's shingles are not looked up at all, however many texts have it; nearer ones are in one class by now.
    """
    head, heavy = prefix_heads(nodes, sets, similarity, scratch)
    other = looked_up(head, similarity).select("shingle", F.col("node").alias("other"), F.col("of").alias("other_of"), F.col("n").alias("other_n"), F.col("place").alias("other_place"))
    fits = (F.col("of") != F.col("other_of")) & ((F.col("other_n") < F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other") < F.col("node")))) & (F.col("other_n") >= similarity * F.col("n"))
    fits = fits & (1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) >= similarity / (1 + similarity) * (F.col("n") + F.col("other_n")) - 1e-9)
    return base.split_join(head, other, ["shingle"], heavy, ["node"]).where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def looked_up(head: DataFrame, similarity: float) -> DataFrame:
    """Of the heads those in which a smaller set, or one of equal size, can share its first shingle with a similar one."""
    return head.where(F.col("place") <= F.col("n") - F.ceil(2 * similarity / (1 + similarity) * F.col("n") - 1e-9) + 1)


def prefix_heads(nodes: DataFrame, sets: DataFrame, similarity: float, scratch: base.Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """shingle, node, of, n, place: the rarest shingles of each node that nodes of other classes have too; and the heavy shingles."""
    whole = nodes.join(sets.withColumnRenamed("doc_id", "node"), "node").select("node", "of", F.xxhash64("shingles").alias("part"), F.size("shingles").alias("n"), "shingles")
    rows = whole.select("node", "of", "part", "n", F.explode("shingles").alias("shingle"))  # the hash is taken once a text
    store = scratch or base
    rows = store.stored(rows, "prefix")
    often = store.stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")), "often")
    place = F.row_number().over(Window.partitionBy("node", "part").orderBy("m", "shingle"))  # a text's own shingles
    heavy = often.where(F.col("m") > base.HEAVY)
    head = base.split_join(rows, often, ["shingle"], heavy, ["node"]).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    head = store.stored(head.where("m > 1").select("shingle", "node", "of", "n", "place"), "heads")
    mixed = head.groupBy("shingle").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("shingle")
    head = store.stored(base.split_join(head, mixed, ["shingle"], heavy, ["node"]), "heads")
    return head, heavy


def components(edges: DataFrame, scratch: base.Scratch | None = None) -> DataFrame:
    """``id`` and ``class_id`` (the least id of its connected component) of every node of the edges (a, b).

    Large-star and small-star steps by turns; each step's edges are written, so a lost executor costs one step, and
    deleted after the next one; the last ones are deleted with ``scratch``.
    """
    held = base.Scratch(edges.sparkSession)
    now = held.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = base.split_join(both, least.drop("n"), ["a"], least.where(F.col("n") > base.HEAVY), ["b"])
        large = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # a node's rows are its neighbours' least nodes: a few components so far
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step = base.Scratch(edges.sparkSession)
        now = step.stored(small, "edges")
        held.clear()
        held = step
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    if scratch is not None:
        scratch.paths += held.paths
    return now.select(F.col("a").alias("id"), F.col("b").alias("class_id")).union(now.select(F.col("b").alias("id"), F.col("b").alias("class_id")).distinct())


def repeated_ids(rows: DataFrame) -> DataFrame:
    """``doc_id`` of more than one row."""
    return base.stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "ids")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: ``doc_id``, ``copy_of`` (least id of its word sequence) and ``class_id`` (least id of its class)."""
    scratch = base.Scratch(docs.sparkSession)
    table = base.stored(sketches(docs), "sketches")
    nodes = table.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = base.stored(nodes, "nodes")
    rows = nodes.where("bands is not null").select("node", F.explode("bands").alias("band"))
    heads = scratch.stored(rows.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    buckets = scratch.stored(base.split_join(rows, heads.select("band", "head"), ["band"], heads.where(F.col("n") > base.HEAVY), ["node"]), "buckets")
    stars = scratch.stored(buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    used = buckets.select(F.col("node").alias("doc_id")).union(stars.select("a")).distinct()
    of_used = docs.select("doc_id", "text").join(used, "doc_id", "left_semi")
    links, ids = None, repeated_ids(table)
    if not ids.isEmpty():
        # Equal rows count once. A repeated id with several texts is one document: its texts' classes are one.
        of_used = of_used.join(ids, "doc_id", "left_anti").union(of_used.join(ids, "doc_id", "left_semi").distinct())
        own = table.join(ids, "doc_id", "left_semi").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node").distinct()
        links = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    sets = scratch.stored(shingle_sets(of_used), "shingles")
    near = verified(stars, sets, similarity)
    links = scratch.stored(near.union(links) if links is not None else near, "links")
    classes = components(links, scratch)
    # Nodes of a bucket whose classes still differ.
    member = buckets.join(classes.withColumnRenamed("id", "node"), "node", "left").select("band", "node", F.coalesce("class_id", "node").alias("of"))
    mixed = member.groupBy("band").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("band")
    open_nodes = scratch.stored(base.split_join(member, mixed, ["band"], heads.where(F.col("n") > base.HEAVY), ["node"]).select("node", "of").distinct(), "open")
    cross = prefix_pairs(open_nodes, sets, similarity, scratch)
    cross = scratch.stored(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    more = scratch.stored(verified(cross, sets, similarity), "links")
    classes = base.stored(components(links.union(more), scratch), "classes") if not more.isEmpty() else base.stored(classes, "classes")
    scratch.clear()
    of = nodes.select("k1", "k2", "node").join(classes.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "node", F.coalesce("class_id", "node").alias("class_id"))
    copied = nodes.where(F.col("copies") > base.HEAVY).select("k1", "k2")
    found = base.split_join(table.select("doc_id", "k1", "k2"), of, ["k1", "k2"], copied, ["doc_id"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("copy_of"), F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
    return found


