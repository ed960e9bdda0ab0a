"""Operator 8 - BPE encoding and decoding by a pair occurrence index.

In each batch of an executor the distinct pre-tokens are laid out as one symbol sequence. An index maps the rank of each
adjacent pair to all its positions; ranks are taken from a heap in ascending order, a rank is applied to all its
positions, and the lists of the neighbouring pairs are brought up to date. A merge can create a pair of a lower rank in
its word; then that word's further positions wait until the lower rank is done, so every word sees the order of the
tokenizers library (lowest rank, then leftmost).

Defined results: null text is the empty text; an empty text has no ids and decodes to the empty text. The string of an added
token is that token, as in the library. The texts are taken whole, whatever their length; repeated rows give repeated rows; of
equal ranks the leftmost goes first; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import base, tokens


class PairIndex:
    """Merges batches of pre-tokens by the rules of a BPE file."""

    def __init__(self, path: str):
        model = tokens.spec(path)["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = self.vocab[a], self.vocab[b]
            self.ranks[pair] = rank
            self.pairs.append((*pair, self.vocab[a + b]))

    def __call__(self, words: list[str]) -> list[list[int]]:
        vocab, suffix, ranks = self.vocab, self.suffix, self.ranks
        symbols: list[int] = []  # -1 between words
        for w in words:
            if suffix and w:
                symbols += [vocab[c] for c in w[:-1]]
                symbols.append(vocab[w[-1] + suffix])
            else:
                symbols += [vocab[c] for c in w]
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            rank = ranks.get(pair)
            if rank is not None:
                index.setdefault(rank, []).append(i)
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            a, b, made = self.pairs[rank]
            wait_until, waiting = -1, []
            for i in places:
                j = after[i] if symbols[i] == a else n
                if j >= n or symbols[j] != b:
                    continue
                if i < wait_until:
                    waiting.append(i)
                    continue
                symbols[i] = made
                symbols[j] = -2
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    if (new := ranks.get((made, symbols[k]))) is not None:
                        if (at := index.get(new)) is None:
                            index[new] = [i]
                            heappush(heap, new)
                        else:
                            at.append(i)
                        if new < rank:
                            wait_until = _word_end(symbols, i)
                h = before[i]
                if h >= 0 and (new := ranks.get((symbols[h], made))) is not None:
                    if (at := index.get(new)) is None:
                        index[new] = [h]
                        heappush(heap, new)
                    else:
                        at.append(h)
                    if new < rank:
                        wait_until = _word_end(symbols, i)
            if waiting:
                index[rank] = waiting
                heappush(heap, rank)
        out: list[list[int]] = []
        word: list[int] = []
        for s in symbols:
            if s >= 0:
                word.append(s)
            elif s == -1:
                out.append(word)
                word = []
        return out


def _word_end(symbols: list[int], i: int) -> int:
    return symbols.index(-1, i)


class Decoder:
    """``decode`` of the tokenizers library for files without a decoder (tokens joined by a space) or with byte-level BPE."""

    def __init__(self, path: str):
        x = tokens.spec(path)
        by_id = {i: t for t, i in x["model"]["vocab"].items()} | {a["id"]: a["content"] for a in x["added_tokens"]}
        self.names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.bytes_level = (x["decoder"] or {}).get("type") == "ByteLevel"
        if x["decoder"] is not None and not self.bytes_level:
            raise ValueError(f"no rule for the decoder {x['decoder']['type']!r}")
        self.to_byte = {c: b for b, c in tokens.byte_alphabet().items()}

    def __call__(self, ids) -> str:
        names = self.names
        if not self.bytes_level:
            return " ".join([names[i] for i in ids])
        text = "".join([names[i] for i in ids])
        if all(c in self.to_byte for c in text):
            return bytes([self.to_byte[c] for c in text]).decode("utf-8", "replace")
        return b"".join(bytes([self.to_byte[c]]) if c in self.to_byte else c.encode() for c in text).decode("utf-8", "replace")


@lru_cache(4)
def _worker(path: str) -> tuple[tokens.Encoder, Decoder]:
    return tokens.Encoder(path, PairIndex(path)), Decoder(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row a document: ``doc_id``, ``ids`` (array of int) and ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(path)
        for whole in batches:
            for batch in base.row_chunks(whole):
                ids = [np.frombuffer(x, encoder.dtype) for x in encoder.encode(base.texts_of(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([decoder(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return base.id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The counts and digests of :func:`encode_decode`, taken inside the tasks so that neither ids nor texts leave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(path)
        for whole in batches:
            for batch in base.row_chunks(whole):
                n, ids_sha, text_sha = [], [], []
                for x in encoder.encode(base.texts_of(batch)):
                    ids = np.frombuffer(x, encoder.dtype)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(decoder(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
