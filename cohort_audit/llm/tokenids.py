"""Operator 6 - token-id output: fixed-width bit packing in blocks.

File format: Parquet rows, one a block: ``part`` and ``block`` (ascending with ``doc_id``), ``width`` (bits an id, the
fewest that hold the vocabulary), ``n_ids``, ``doc_ids`` and ``doc_ends`` (ends of the documents, counted in ids from the
block's start) and ``bits`` (the ids, least significant bit first). Ids of a document are reached by its block and a
shift of ``width`` bits an id; a block unpacks by numpy at once. A block holds whole documents, up to ``BLOCK_IDS`` ids
unless one document has more.

Widths of whole bytes (16 bits for a vocabulary of 49,408) are the same layout, so numpy writes and reads them as integers.
:func:`read_document` fetches one document: the block's row is found by its least and greatest id, and only the document's
bits are unpacked.

Defined results: null text is the empty text and still gets its end id; rows with the same ``doc_id`` stand in the order
of their texts; a null ``doc_id`` stands first; long texts are taken whole, in a block of their own if need be; an empty table
gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, tokens

BLOCK_IDS = 1 << 16
SCHEMA = "part int, block int, width int, n_ids long, first_id long, last_id long, doc_ids array<long>, doc_ends array<long>, bits binary"


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of packed data; only their bytes are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", end - start, start * width // 8).astype(np.uint32)
    first = start * width // 8
    raw = np.frombuffer(data, np.uint8, (end * width + 7) // 8 - first, first)
    skip = start * width - first * 8
    bits = np.unpackbits(raw, bitorder="little")[skip : skip + (end - start) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


@lru_cache(4)
def _encoder(path: str) -> tokens.Encoder:
    return tokens.Encoder(path)


def write(docs: DataFrame, path: str, out: str, end_id: int | None = None) -> None:
    """Encode all documents in ascending ``doc_id`` order and write the block files to ``out``."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block = _encoder(path), TaskContext.get().partitionId(), 0
        width = width_of(encoder.vocab_size)
        tail = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), encoder.dtype)
            ends = np.cumsum([len(x) // encoder.dtype.itemsize for x in ids])
            known = [d for d in names if d is not None]
            values = [part, block, width, len(flat), min(known, default=None), max(known, default=None), names, ends, pack(flat, width)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "width", "n_ids", "first_id", "last_id", "doc_ids", "doc_ends", "bits"])

        for whole in batches:
            for batch in base.row_chunks(whole, most=tokens.CHUNK_BYTES):
                for doc, x in zip(batch.column("doc_id").to_pylist(), encoder.encode(base.texts_of(batch)), strict=True):
                    n = (len(x) + len(tail)) // encoder.dtype.itemsize
                    if ids and size + n > BLOCK_IDS:
                        yield flush()
                        ids, names, size, block = [], [], 0, block + 1
                    ids.append(x + tail)
                    names.append(doc)
                    size += n
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base.id_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(out)


def open_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written table with ``start``, the number of ids in all blocks before."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = blocks.select("part", "block", "n_ids").withColumn("within", within).join(before, "part")
    return blocks.join(starts.select("part", "block", (F.col("part_start") + F.col("within")).alias("start")), ["part", "block"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time, so that a task never holds a whole batch of them as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id, in order (one but for repeated rows), from the blocks that can hold it.

    Blocks lie in the order of their ids, so the files' statistics on ``first_id`` and ``last_id`` leave a block or two to read.
    """
    here = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    out = []
    for row in spark.read.schema(SCHEMA).parquet(path).where(here).orderBy("part", "block").toLocalIterator():
        for i in (k for k, d in enumerate(row["doc_ids"]) if d == doc_id):
            out.append(unpack(bytes(row["bits"]), row["width"], row["doc_ends"][i - 1] if i else 0, row["doc_ends"][i]))
    return out


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """A table of where blocks start: ``start``, ``stop`` (positions of ids in all files), ``part``, ``block``; in order of start."""
    starts = open_blocks(spark, path).select("start", (F.col("start") + F.col("n_ids")).alias("stop"), "part", "block")
    starts.repartitionByRange("start").sortWithinPartitions("start").write.parquet(index)


def read_span(spark: SparkSession, path: str, index: str, start: int, length: int) -> np.ndarray:
    """``length`` ids from position ``start`` on, across documents and blocks, from the blocks that hold them."""
    here = (F.col("start") < start + length) & (F.col("stop") > start)
    blocks = spark.read.parquet(index).where(here).orderBy("start").collect()  # the blocks of the span
    if not blocks:
        return np.zeros(0, np.uint32)
    wanted = F.lit(False)
    for r in blocks:
        wanted = wanted | ((F.col("part") == r["part"]) & (F.col("block") == r["block"]))
    held = {(r["part"], r["block"]): r for r in spark.read.schema(SCHEMA).parquet(path).where(wanted).select("part", "block", "width", "bits").toLocalIterator()}
    out = []
    for r in blocks:
        row = held[r["part"], r["block"]]
        out.append(unpack(bytes(row["bits"]), row["width"], max(start, r["start"]) - r["start"], min(start + length, r["stop"]) - r["start"]))
    return np.concatenate(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = unpack(row["bits"], row["width"], 0, row["n_ids"])
            ends = np.array(row["doc_ends"])
            starts = np.concatenate([[0], ends[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(ends - starts), lists], ["doc_id", "start", "n_tokens", "ids"])

    return open_blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read`, with the checksum of each document's unpacked ids in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw = memoryview(unpack(row["bits"], row["width"], 0, row["n_ids"]).astype("<u4").tobytes())
            ends = np.array(row["doc_ends"])
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return open_blocks(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and return the digests read back from it."""
    spark = docs.sparkSession
    out = base.shared_path(spark, "token-ids")
    write(docs, path, out, end_id)
    return read_digests(spark, out)
