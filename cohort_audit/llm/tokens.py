"""Exact tokenizer ids through a memo of white-space chunks.

A text is cut at the strings of added tokens and where the tokenizer's own pre-tokenizer always cuts, each distinct part is
encoded once by the tokenizers library's model (or by a given one), and the parts' ids are joined. Texts of plain characters
are cut, and their parts told apart, as whole columns by numpy and Arrow. Files of another normalizer, pre-tokenizer or kind
of added token than those known here are refused.
"""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the tokenizers' patterns (the Unicode property), written out since Python's own class differs.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct parts a worker remembers of each kind; about 30 bytes each.
MEMO = 500_000
#: Bytes of text that a worker cuts at a time: each time the memo is looked through once.
CHUNK_BYTES = 4 << 20
#: Words of a call of the library, whose answer takes about a hundred bytes a token.
AT_ONCE = 5000


@lru_cache(8)
def load(path: str):
    """The tokenizer of a file, once a worker, with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def spec(path: str) -> dict:
    """The JSON of a file. It is read anew each time: parsed it takes some 30 MB, which a worker would hold for good."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: Characters whose normal form, case and class are the same in every Unicode version: printable ASCII and Latin-1 letters.
PLAIN = re.compile("[ \\n!-~À-ÖØ-öø-ÿ]*")
#: Kinds of the bytes of plain texts. A letter of Latin-1 is two bytes, and no other plain character has a byte from 128 on.
LETTER, DIGIT, MARK, WHITE = range(4)
KIND = np.full(256, MARK, np.uint8)
KIND[48:58], KIND[65:91], KIND[97:123], KIND[128:], KIND[[10, 32]] = DIGIT, LETTER, LETTER, LETTER, WHITE
#: Bytes of plain texts in lower case: À to Þ have 128 to 158 as their second byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[128:159] += 32


#: The pre-tokenizer's pattern and the normalizer of the files with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def kind_of(x: dict) -> str:
    """``bytes`` or ``words``: what a file's pre-tokenizer does; ValueError for what :class:`Encoder` has no rules for."""
    pre, norm = x["pre_tokenizer"] or {}, x["normalizer"] or {}
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in x["added_tokens"])
    if plain and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
        return "bytes"
    parts = pre.get("pretokenizers") or [{}]
    split = parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    level = [(p.get("type"), p.get("use_regex"), p.get("add_prefix_space")) for p in parts[1:]] == [("ByteLevel", False, False)]
    if plain and split and level and norm.get("normalizers") == WORD_NORMALIZERS:
        return "words"
    raise ValueError("a tokenizer file whose normalizer, pre-tokenizer or added tokens are not known here")


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo:
    """The ids of parts met lately, in columns: at most ``most`` of them besides those of the texts at hand.

    When they are full, half are forgotten: those that have not been met for longest, so frequent ones stay.
    """

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.clock = most, 0
        self.words, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.ids, self.size = np.zeros(0, dtype), np.zeros(0, np.int64)

    def find(self, words: pa.LargeStringArray, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Places of distinct parts in ``size``, whose sums are their places in ``ids``; ``make`` gives ids and sizes of those not remembered."""
        self.clock += 1
        place = self.look_up(words)
        self.met[place[place >= 0]] = self.clock
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.met) + len(new) > self.most:
                self.forget()
                place = self.look_up(words)
            place[new] = len(self.met) + np.arange(len(new))
            new = words.take(pa.array(new))
            ids, size = make(new.to_pylist())
            self.words = pa.concat_arrays([self.words, new])
            self.met = np.append(self.met, np.full(len(new), self.clock))
            self.ids, self.size = np.append(self.ids, ids.astype(self.ids.dtype)), np.append(self.size, size)
        return place

    def look_up(self, words: pa.LargeStringArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def forget(self) -> None:
        half = self.most // 2
        keep = self.met == self.clock
        if 0 < half < len(self.met):
            keep |= self.met > np.partition(self.met, -half)[-half]
        self.words, self.met = self.words.filter(pa.array(keep)), self.met[keep]
        self.ids, self.size = self.ids[np.repeat(keep, self.size)], self.size[keep]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The members of lists one after the other, and the lists' sizes."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def separate(library, model: dict):
    """A tokenizer of a file's model alone, for words with spaces between, and the characters that each of its tokens stands for."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(library.model)
    alone.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    suffix = model["end_of_word_suffix"] or ""
    length = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    for token, i in model["vocab"].items():
        length[i] = len(token.removesuffix(suffix))
    return alone, length


class Encoder:
    """``encode(texts)``: the ids of each text as little-endian bytes, two an id while the vocabulary allows.

    Texts of plain characters are cut into pre-tokens by the file's pattern; another is cut at white space, and its
    chunks go through the library's own normalizer and pre-tokenizer. ``merge`` turns a list of distinct pre-tokens
    into lists of their ids; the default is the library's model.
    """

    def __init__(self, path: str, merge: Callable[[list[str]], list[list[int]]] | None = None, memo: int = MEMO):
        self.path, self.library = path, load(path)
        x = spec(path)
        self.keep_spaces = kind_of(x) == "bytes"
        self.vocab_size = max([*x["model"]["vocab"].values(), *(a["id"] for a in x["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.added = {a["content"]: a["id"] for a in x["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")" if self.added else r"(?!)")
        self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+" if self.keep_spaces else "[^ \\n\\r\\t]+")
        shown = byte_alphabet()
        self.shown = "".join(shown[b] for b in range(256))
        self.memos = Memo(memo, self.dtype), Memo(memo, self.dtype)
        self.apart = " " + self.shown[1:]  # byte 0, which no plain text has, parts pre-tokens
        self.merge = (lambda todo: flattened(merge(todo))) if merge else self.by_library
        self.model, self.length = separate(self.library, x["model"])

    def by_library(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes by one call of the library for many; the tokens' lengths tell where each pre-token ends."""
        if len(pretokens) > AT_ONCE:
            ids, size = zip(*(self.by_library(pretokens[i : i + AT_ONCE]) for i in range(0, len(pretokens), AT_ONCE)), strict=True)
            return np.concatenate(ids), np.concatenate(size)
        ids = np.array(self.model.encode_batch_fast([" ".join(pretokens)], add_special_tokens=False)[0].ids, self.dtype)
        ends, wanted = np.cumsum(self.length[ids]), np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))
        last = np.searchsorted(ends, wanted)
        if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(ends[last], wanted):
            return ids, np.diff(last, prepend=-1)
        tokenize = self.library.model.tokenize  # a pre-token isn't the sum of its tokens
        return flattened([[t.id for t in tokenize(p)] for p in pretokens])

    def of_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct pre-tokens of plain texts."""
        return self.merge(charmap_decode("\0".join(words).encode(), "strict", self.apart)[0].split(" "))

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct chunks of any characters."""
        spans = [self.pretokens(c) for c in chunks]
        todo = list(dict.fromkeys(chain.from_iterable(spans)))
        ids, size = self.merge(todo) if todo else flattened([])
        known = dict(zip(todo, np.split(ids, np.cumsum(size)[:-1]), strict=True)) if todo else {}
        return flattened([[i for p in ps for i in known[p].tolist()] for ps in spans])

    def pretokens(self, chunk: str) -> list[str]:
        """A chunk of any characters as the library's normalizer and pre-tokenizer give it."""
        if self.library.normalizer is not None:
            chunk = self.library.normalizer.normalize_str(chunk)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def plain_parts(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
        """Of plain texts: the distinct pre-tokens, which of them each pre-token is, and where in that order each text starts and ends."""
        _, at, data = pa.array(texts, pa.large_string()).buffers()
        off = np.frombuffer(at, np.int64, len(texts) + 1)
        n = int(off[-1])
        if not n:
            return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        raw = np.frombuffer(data, np.uint8, n)
        if not self.keep_spaces:
            raw = LOWER[raw]
        kind, edge = KIND[raw], np.zeros(n + 1, bool)
        edge[off] = True
        white, begins = kind == WHITE, edge.copy()
        change = kind[1:] != kind[:-1]
        if self.keep_spaces:  # white space gives its last character away, and a word takes that if it is a space
            begins[1:n] |= change & (white[1:] | (raw[:-1] != 32))
            begins[: n - 1] |= white[:-1] & ~white[1:] & ~edge[1:n]
        else:
            begins[1:n] |= change | (kind[1:] == DIGIT)
        self.shorten(raw, kind, edge, begins)
        if self.keep_spaces:
            start = np.flatnonzero(begins)
            bounds = start
        else:
            start = np.flatnonzero(begins[:n] & ~white)
            bounds = np.append((np.cumsum(~white) - 1)[start], n - np.count_nonzero(white))
            raw = raw[~white]
        words = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), np.searchsorted(start, off)

    def shorten(self, raw: np.ndarray, kind: np.ndarray, edge: np.ndarray, begins: np.ndarray) -> None:
        """Make 's 't 're 've 'm 'll 'd pre-tokens wherever one can begin with the apostrophe."""
        p = np.flatnonzero(raw == 39)
        free = kind[p - 1] != MARK
        if self.keep_spaces:
            free &= raw[p - 1] != 32
        p = p[(edge[p] | free) & ~edge[p + 1]]
        a = raw[p + 1]
        two = ~edge[p + 2]
        b = raw[np.where(two, p + 2, p)]
        three = two & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        size = np.where(three, 3, np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 2, 0))
        p, size = p[size > 0], size[size > 0]
        begins[p + 1] = False
        begins[p + size] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the stretches between the strings of added tokens are encoded each by itself."""
        if not any(self.special.search(t) for t in texts):
            return self.between(texts)
        cut = [self.special.split(t) for t in texts]  # stretches and added tokens by turns
        ids = iter(self.between([s for c in cut for s in c[::2]]))
        mark = {c: np.array([i], self.dtype).tobytes() for c, i in self.added.items()}
        return [b"".join([next(ids) if k % 2 == 0 else mark[s] for k, s in enumerate(c)]) for c in cut]

    def between(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without an added token's string."""
        odd = {i: self.cut.findall(t) for i, t in enumerate(texts) if not PLAIN.fullmatch(t)}
        words, which, ends = self.plain_parts([t if i not in odd else "" for i, t in enumerate(texts)])
        out = self.joined(0, words, which, ends, self.of_plain)
        if odd:
            chunks = pa.array(list(chain.from_iterable(odd.values())), pa.large_string()).dictionary_encode()
            ends = np.cumsum([0, *map(len, odd.values())])
            for i, x in zip(odd, self.joined(1, chunks.dictionary, chunks.indices.to_numpy(), ends, self.of_chunks), strict=True):
                out[i] = x
        return out

    def joined(self, kind: int, parts: pa.LargeStringArray, which: np.ndarray, ends: np.ndarray, make: Callable) -> list[bytes]:
        """The ids of texts, the parts of each of which are ``parts[which]`` between two of ``ends``."""
        memo = self.memos[kind]
        at = memo.find(parts, make)
        size, first = memo.size[at], (np.cumsum(memo.size) - memo.size)[at]  # of each distinct part
        sizes = size[which]
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        place = np.repeat(first[which] - upto[:-1], sizes)
        place += np.arange(len(place))
        raw = memo.ids[place].tobytes()
        return [raw[a:b] for a, b in pairwise((upto[ends] * self.dtype.itemsize).tolist())]
