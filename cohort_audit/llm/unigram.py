"""Operator 4 - token counts by a count-only Viterbi search over a unigram vocabulary.

The tokenizer is the unigram model of the tokenizers library over the pieces and scores of a SentencePiece file, with the
word mark put before each space-separated part (Metaspace, always prepended, split) and bytes for what no piece covers. A
part's best path is found without building it: an Aho-Corasick automaton gives every piece that ends at each place, and
the dynamic program carries the best score and its number of tokens. Ties are the library's: starts are tried in ascending
order and only a strictly better score replaces one; the path with the longest last piece wins.

Parts are also cut before a line feed where bytes stand for unknown characters (else neighbours of these are one token): no piece
holds one, so scores and counts add up over the cut. Parts are cut and told apart as
whole columns; the program of those not met lately takes a step for all of them at once.

Defined results: null text is the empty text, with 0 tokens and score 0. Long texts are taken whole; repeated rows give repeated
rows; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base, tokens

#: What a character without a piece costs below the least score, as the library has it.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Distinct parts that a worker remembers, parts of a run of the program, and characters from which a part goes alone.
MEMO, AT_ONCE, LONG = 400_000, 20_000, 40


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Automaton:
    """Aho-Corasick over pieces as a table, so that many parts are read at once: state and kind of character give the next state.

    Pieces of one character are looked up by themselves; characters that only they hold are all of kind 0, which leads to the root.
    """

    def __init__(self, pieces: list[str]):
        self.alone, self.kind = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.int32)
        long = {p: i for i, p in enumerate(pieces) if len(p) > 1}
        for i, p in enumerate(pieces):
            if len(p) == 1:
                self.alone[ord(p)] = i
        for k, c in enumerate(sorted(set(chain.from_iterable(long)))):
            self.kind[ord(c)] = k + 1
        names = sorted({p[:k] for p in long for k in range(len(p) + 1)} | {""}, key=len)
        state = {x: i for i, x in enumerate(names)}
        self.next = np.zeros((len(names), int(self.kind.max()) + 1), np.int32)
        fail = np.zeros(len(names), np.int32)
        self.longest, self.shorter = np.full(len(names), -1, np.int32), np.full(len(pieces), -1, np.int32)
        for _, level in groupby(range(1, len(names)), key=lambda i: len(names[i])):
            these = list(level)
            for i in these:
                x = names[i]
                above, c = state[x[:-1]], self.kind[ord(x[-1])]
                fail[i] = self.next[fail[above], c] if above else 0
                self.next[above, c] = i
                self.longest[i] = long.get(x, self.longest[fail[i]])
                if x in long:
                    self.shorter[long[x]] = self.longest[fail[i]]
            self.next[these] = self.next[fail[these]]  # shorter ones, whose rows are whole by now

    def hits(self, code: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last characters and pieces of all places of pieces in parts of ``code`` that start at ``first``."""
        kind, states = self.kind[code], np.zeros(len(code), np.int32)
        order = np.argsort(-sizes, kind="stable")
        first, still = first[order], np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
        now = np.zeros(len(first), np.int32)
        for d, m in enumerate(still.tolist()):  # the m parts of more than d characters
            now = self.next[now[:m], kind[first[:m] + d]]
            states[first[:m] + d] = now
        end = np.flatnonzero(self.alone[code] >= 0)
        found = [(end, self.alone[code[end]])]
        piece = self.longest[states]
        end = np.flatnonzero(piece >= 0)
        piece = piece[end]
        while len(end):
            found.append((end, piece))
            piece = self.shorter[piece]
            end, piece = end[piece >= 0], piece[piece >= 0]
        return np.concatenate([e for e, _ in found]), np.concatenate([p for _, p in found])


class Counter:
    """``count(texts)``: (tokens, best score) of each text."""

    def __init__(self, vocab: list[tuple[str, float]], memo: int = MEMO):
        self.automaton = Automaton([p for p, _ in vocab])
        self.size = np.array([len(p) for p, _ in vocab])
        self.score = np.array([s for _, s in vocab], np.float64)
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        names = {p for p, _ in vocab}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        if any("\n" in p for p in names):
            raise ValueError("a piece holds a line feed")
        self.memo = tokens.Memo(memo, np.dtype(np.float64))  # two values a part

    def best(self, part: str) -> tuple[int, float]:
        """Tokens and score of the best path over a part."""
        n = len(part)
        score, count, lone = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        states, state = [], 0
        for k in self.automaton.kind[code].tolist():
            state = self.automaton.next.item(state, k)
            states.append(state)
        piece, end = self.automaton.longest[states], np.arange(n)
        hits = [(end, self.automaton.alone[code])]
        while len(end):
            hits.append((end, piece))
            end, piece = end[piece >= 0], self.automaton.shorter[piece[piece >= 0]]
        for ends, pieces in hits:
            for e, i in zip(ends.tolist(), pieces.tolist(), strict=True):
                if i >= 0:
                    found[e].append((int(self.size[i]), float(self.score[i])))
        for end in range(1, n + 1):
            best, tokens, unk, single = None, 0, 0, False
            for size, s in sorted(found[end - 1], reverse=True):  # the longest starts first
                single |= size == 1
                x = score[end - size] + s
                if best is None or x > best:
                    best, tokens, unk = x, count[end - size] + 1, 0
            if not single:
                x = score[end - 1] + self.unknown
                if best is None or x > best:
                    if self.bytes:
                        best, tokens = x, count[end - 1] + len(part[end - 1].encode("utf-8", "surrogatepass"))
                    else:  # neighbouring unknown characters are one token
                        best, tokens, unk = x, count[end - 1] + (not lone[end - 1]), 1
            score[end], count[end], lone[end] = best, tokens, unk
        return count[n], score[n]

    def best_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of the best paths over many parts, as :meth:`best` finds them one by one.

        Each part has a cell for each of its prefixes; all pieces of one size that end after so many characters go at once.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text = "\n".join([*parts, ""])
        n, first = len(text), np.cumsum(sizes + 1) - sizes - 1
        last = first + sizes
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        end, piece = self.automaton.hits(code, first, sizes)
        cell, size, worth = end + 1, self.size[piece], self.score[piece]
        known = np.zeros(n, bool)
        known[first] = known[cell[size == 1]] = True
        lone = np.flatnonzero(~known)  # after characters without a piece
        spread = np.ones(len(cell), np.int64)
        if self.bytes and len(lone):
            code = code[lone - 1]
            cell, size, worth = np.append(cell, lone), np.append(size, np.ones(len(lone), np.int64)), np.append(worth, np.full(len(lone), self.unknown))
            spread = np.append(spread, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        widest = int(self.size.max())
        step = (cell - np.repeat(first, sizes + 1)[cell]) * (widest + 1) + widest - size  # the longest starts first
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        step, cell, worth, spread = step[order], cell[order], worth[order], spread[order]
        start = cell - size[order]
        score, count = np.full(n, -np.inf), np.zeros(n, np.int64)
        score[first] = 0.0
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]):
            x, to = score[start[a:b]] + worth[a:b], cell[a:b]
            better = x > score[to]
            to = to[better]
            score[to], count[to] = x[better], count[start[a:b][better]] + spread[a:b][better]
        count, score = count[last], score[last]
        if not self.bytes and len(lone):
            for i in np.unique(np.searchsorted(first, lone, "right") - 1).tolist():
                count[i], score[i] = self.best(parts[i])
        return count, score

    def values(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of each part (its mark a space) by turns, and how many values each has."""
        whole = "\0".join(parts)
        parts = whole.replace(" ", MARK).split("\0") if whole.count("\0") < len(parts) else [p.replace(" ", MARK) for p in parts]
        got = [self.best_of(parts[i : i + AT_ONCE]) for i in range(0, len(parts), AT_ONCE)]
        return np.concatenate([np.column_stack(x).ravel() for x in got]), np.full(len(parts), 2)

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        """Texts become one column of parts, in which a space stands for the mark."""
        texts = [t.replace(MARK, " ") for t in texts]
        _, at, data = pa.array([t if t[:1] in ("", " ") else " " + t for t in texts], pa.large_string()).buffers()
        off = np.frombuffer(at, np.int64, len(texts) + 1)
        out = np.zeros((len(texts), 2))
        if off[-1]:
            raw = np.frombuffer(data, np.uint8, off[-1])
            start = np.flatnonzero((raw == 32) | self.bytes & (raw == 10))
            column = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw))), pa.py_buffer(raw)).dictionary_encode()
            parts, which = column.dictionary, column.indices.to_numpy()
            value = np.zeros((len(parts), 2))
            short = pc.less(pc.utf8_length(parts), LONG)
            brief = short.to_numpy(zero_copy_only=False)
            at = self.memo.find(parts.filter(short), self.values)
            value[brief] = self.memo.ids.reshape(-1, 2)[at]
            for i in np.flatnonzero(~brief).tolist():
                value[i] = self.best(parts[i].as_py().replace(" ", MARK))
            some = np.flatnonzero(np.diff(off))
            out[some] = np.add.reduceat(value[which], np.searchsorted(start, off[some]))
        return list(zip(out[:, 0].astype(np.int64).tolist(), out[:, 1].tolist(), strict=True))


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``score`` (the best path's) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for whole in batches:
            for batch in base.row_chunks(whole, most=tokens.CHUNK_BYTES):
                n, score = zip(*counter.count(base.texts_of(batch)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return base.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, score double")
