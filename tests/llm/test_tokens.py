"""Operators 4, 6, 7 and 8 against the tokenizers library."""

import gc
import hashlib
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from cohort_audit.llm import base, bpe, packing, tokenids, tokens, unigram

WORD, BYTE, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def ids_of(path, texts):
    t = Tokenizer.from_file(path)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_and_pair_index_give_the_librarys_ids(path, texts):
    want = list(ids_of(path, texts).values())
    for merge in (None, bpe.PairIndex(path)):
        e = tokens.Encoder(path, merge, memo=10)
        for _ in range(2):
            assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([t or "" for t in texts.values()])] == want


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_and_other_files(path, tmp_path):
    import json

    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a <|endoftext|>b's <|startoftext|> c", "<|ENDOFTEXT|> <|endoftext", "x\u0301<|endoftext|>\u0301y  <|endoftext|><|endoftext|> z", ""]
    e = tokens.Encoder(path, bpe.PairIndex(path))
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    spec = json.loads(open(path).read())
    spec["normalizer"] = {"type": "NFKC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        tokens.Encoder(str(other))


def test_frequent_words_stay_in_a_bounded_memo():
    """Words met again and again are merged once, however many others come between; of these few are remembered."""
    e = tokens.Encoder(BYTE, memo=1000)
    merged, merge = [], e.merge
    e.merge = lambda todo: merged.extend(todo) or merge(todo)
    often = [f" word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    letters = "abcdefghij"
    for k in range(60):
        rare = [" x" + "".join(letters[int(c)] for c in f"{k * 100 + i:05d}") for i in range(100)]
        text = "".join(often + rare)
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.library.encode(text, add_special_tokens=False).ids
        assert sum(len(g) for g in vars(e.memos[0]).values() if isinstance(g, dict)) <= 1000 + 200
    assert len(merged) == len(set(merged))


def test_the_memo_of_columns_stays_bounded():
    e = tokens.Encoder(BYTE, memo=1000)
    for k in range(30):
        e.encode([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k % 26)}" for i in range(200)), "\u4e2d" * k + " x"])
        for memo in e.memos:
            assert len(memo.met) == len(memo.words) == len(memo.size) <= 1000 + 200 and memo.size.sum() == len(memo.ids)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_columns_are_cut_as_the_librarys_pattern_cuts(path):
    """Texts of a few plain characters, so that apostrophes, spaces, line feeds and ends of texts meet in every way."""
    rng, t = np.random.default_rng(3), Tokenizer.from_file(path)
    letters = np.array(list("  \n\n''" "'strevlmdSRE57!-éÀßÿÞ"))
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 30, 4000)]
    texts += [x + y + z for x in ("", "a", "5", "!", " ", "\n", "'", "é") for y in ("'s", "'re", "'rx", "'S", "'l", "'ll", "'", "''s") for z in ("", "'s", "t", "5", "!", " ", "\n", "  a", " \n")]
    e = tokens.Encoder(path, memo=500)
    for k in range(0, len(texts), 900):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts[k : k + 900])] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 900]]


def test_distinct_words_cost_no_calls_each():
    """20,000 words never met before are cut, encoded and remembered as columns: fewer Python calls than words, few bytes a word."""
    import cProfile
    import pstats

    import pyarrow as pa

    rng = np.random.default_rng(4)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(20_000))
    e = tokens.Encoder(BYTE)
    e.encode(["warm"])
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    e.encode([text])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 60 * 20_000
    profile = cProfile.Profile()
    profile.runcall(e.encode, [text.replace("a", "z")])
    assert pstats.Stats(profile).total_calls < 5000


def test_a_worker_holds_no_parsed_file():
    tokens.load(BYTE)
    gc.collect()
    tracemalloc.start()
    e = tokens.Encoder(BYTE)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 4 << 20 and tokens.spec(BYTE) is not tokens.spec(BYTE) and e.vocab_size > 50_000


def test_pair_index_lets_lower_ranks_go_first(tmp_path):
    # abc arises by two merges; (abc, x) ranks between them, so it must go before the second place of the later one.
    import json

    vocab = {s: i for i, s in enumerate(["a", "b", "c", "x", "ab", "bc", "abc", "xa", "abcx"])}
    model = {"type": "BPE", "vocab": vocab, "merges": [["a", "b"], ["ab", "c"], ["abc", "x"], ["x", "a"], ["b", "c"]], "end_of_word_suffix": None}
    spec = json.loads(open(BYTE).read())
    spec["model"], spec["added_tokens"] = spec["model"] | model, []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    t = Tokenizer.from_file(str(path))
    words = ["abc", "abcxabc", "xabcx", "aab", "abab", "bcbc", "abcabcxx", "xxabcxa"]
    assert bpe.PairIndex(str(path))(words) == [[x.id for x in t.model.tokenize(w)] for w in words]


def test_op8(docs, no_docs, texts):
    t = Tokenizer.from_file(WORD)
    want = ids_of(WORD, texts)
    got = {r["doc_id"]: r for r in bpe.digests(docs, WORD).collect()}
    for i, ids in want.items():
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs, BYTE).collect()}
    b = Tokenizer.from_file(BYTE)
    assert all(full[i]["ids"] == b.encode(x or "", add_special_tokens=False).ids and full[i]["decoded"] == b.decode(full[i]["ids"], skip_special_tokens=False) for i, x in texts.items())
    assert bpe.digests(no_docs, WORD).count() == 0


def test_op6(spark, docs, no_docs, texts):
    want, start = {}, 0
    for i, ids in sorted(ids_of(WORD, texts).items()):
        want[i] = (i, start, len(ids) + 1, crc([*ids, 1]))
        start += len(ids) + 1
    assert {r["doc_id"]: tuple(r) for r in tokenids.token_ids(docs, WORD, 1).collect()} == want
    assert tokenids.token_ids(no_docs, WORD, 1).count() == 0
    path = base.shared_path(spark, "t")
    tokenids.write(docs, WORD, path)
    assert all(r["ids"] == Tokenizer.from_file(WORD).encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids for r in tokenids.read(spark, path).collect())


def test_op6_in_a_width_of_no_whole_bytes(spark, texts, tmp_path):
    """A file of 300 words has ids of 9 bits: all documents, and single ones by their offsets, come back."""
    import json

    spec = json.loads(open(WORD).read())
    shown = [c for c, i in sorted(spec["model"]["vocab"].items(), key=lambda x: x[1])][:512]
    spec["model"] |= {"vocab": {c: i for i, c in enumerate(shown)}, "merges": []}
    spec["added_tokens"] = []
    path, out = tmp_path / "small.json", base.shared_path(spark, "small")
    path.write_text(json.dumps(spec))
    rows = [(i, t) for i, t in texts.items() if i not in (80, 82)] + [(3, "twice")]
    tokenids.write(spark.createDataFrame(rows, "doc_id long, text string"), str(path), out, 1)
    assert {r["width"] for r in spark.read.parquet(out).collect()} == {9}
    t = Tokenizer.from_file(str(path))
    want = sorted((i, x or "") for i, x in rows)
    got = [(r["doc_id"], r["ids"]) for r in tokenids.read(spark, out).orderBy("start").collect()]
    assert got == [(i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in want]
    for i in (3, 5, 72, 999):
        assert [x.tolist() for x in tokenids.read_document(spark, out, i)] == [ids for k, ids in got if k == i]


def test_random_access_reads_few_blocks(spark, texts, monkeypatch):
    """Documents by id and spans by position, over blocks of a few ids; the filter on ids reaches the files' statistics."""
    monkeypatch.setattr(tokenids, "BLOCK_IDS", 40)
    path, out, index = P.path("word_bpe_49k.json"), base.shared_path(spark, "few"), base.shared_path(spark, "index")
    rows = [(i, t) for i, t in texts.items() if i != 82] + [(None, "no id"), (None, None), (3, "twice")]
    tokenids.write(spark.createDataFrame(rows, "doc_id long, text string"), path, out, 1)
    tokenids.write_index(spark, out, index)
    docs = tokenids.read(spark, out).orderBy("start").collect()
    whole = np.concatenate([r["ids"] for r in docs])
    assert spark.read.parquet(index).count() > 20
    for i in (3, 0, 86, 999):
        assert [x.tolist() for x in tokenids.read_document(spark, out, i)] == [r["ids"] for r in docs if r["doc_id"] == i]
    for start, length in ((0, 5), (37, 9), (100, 700), (len(whole) - 3, 10), (len(whole), 4), (50, 0)):
        assert tokenids.read_span(spark, out, index, start, length).tolist() == whole[start : start + length].tolist()
    read = spark.read.schema(tokenids.SCHEMA).parquet(out).where("first_id <= 3 and last_id >= 3")
    plan = spark._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(first_id,3)" in plan and "GreaterThanOrEqual(last_id,3)" in plan


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 32])
def test_packed_ids_come_back_from_any_place(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 777)
    data = tokenids.pack(ids, width)
    assert len(data) == -(-777 * width // 8)
    for a, b in ((0, 777), (5, 6), (100, 700), (776, 777), (9, 9)):
        assert tokenids.unpack(data, width, a, b).tolist() == ids[a:b].tolist()


def check_packing(rows, want, capacity):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        ps = sorted(by[i], key=lambda p: p["piece"])
        assert [p["piece"] for p in ps] == list(range(-(-len(ids) // capacity)))
        assert all(p["length"] == capacity for p in ps[1:])
        at = 0
        for p in ps:
            assert p["start"] == at and p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_op7(docs, no_docs, texts):
    want = {i: [*ids, 2] for i, ids in ids_of(BYTE, texts).items()}
    n = check_packing(packing.pack(docs, BYTE, 2, 256).collect(), want, 256)
    assert n <= -(-sum(map(len, want.values())) // 256) + 3
    assert packing.pack(no_docs, BYTE, 2).count() == 0


def test_plans_hold_every_piece_and_are_near_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(5):
        hist = {int(n): int(k) for n, k in zip(rng.choice(np.arange(1, 257), 90, replace=False), rng.integers(1, 500, 90), strict=True)}
        plan = packing.configurations(hist, 256, 60)
        held: dict[int, int] = defaultdict(int)
        for config, times in plan:
            assert sum(n * c for n, c in config.items()) <= 256
            for n, c in config.items():
                held[n] += c * times
        assert dict(held) == hist
        used = sum(t for _, t in plan)
        assert used >= max(sum(n * k for n, k in hist.items()) / 256, sum(k for n, k in hist.items() if n > 128))
        assert used <= 1.01 * sum(t for _, t in packing.best_fit(dict(hist), 256))


@pytest.mark.parametrize("hist", [{100: 900, 40: 700, 30: 500}, {86: 3000, 85: 10, 84: 3000}, {129: 500, 64: 900, 63: 100}, {51: 1000, 27: 1000, 13: 600}])
def test_program_bounds_and_covers(hist):
    """The fractional solution covers every length once scaled, the dual bound holds, and both are near each other."""
    lengths = np.array(sorted(hist))
    demand = np.array([hist[n] for n in lengths])
    taken, covered, bound = packing.program(lengths, demand, 256, rounds=400)
    total = np.zeros(len(lengths))
    for column, times in taken.items():
        assert sum(lengths[i] for i in column) <= 256 and times >= 0
        np.add.at(total, np.array(column), times)
    assert np.allclose(total / demand, covered)
    value = sum(taken.values()) / covered.min()
    assert bound <= value * (1 + 1e-9) and value <= 1.05 * bound
    used = sum(t for _, t in packing.configurations(dict(hist), 256, 400))
    assert bound <= used + 1e-6 and used <= 1.035 * bound + 3


def test_even_lengths_fill_sequences():
    hist = {n: 300 + n % 7 for n in range(1, 257)}
    used = sum(t for _, t in packing.configurations(hist, 256))
    assert used <= 1.002 * sum(n * k for n, k in hist.items()) / 256 + 2


def test_op4(docs, no_docs, texts):
    vocab = unigram.vocabulary(PIECES)
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs, PIECES).collect()}
    assert got == {i: len(t.encode(x or "").ids) for i, x in texts.items()}
    assert unigram.token_counts(no_docs, PIECES).count() == 0


def test_unigram_ties_and_unknowns():
    vocab = [("<unk>", 0.0), ("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0)]
    t = Tokenizer(models.Unigram(vocab, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    c = unigram.Counter(vocab)
    for x in ("abab", "ababa", "bab a", "azzb", "zz", "a z", "abaaba", ""):
        assert c.count([x])[0][0] == len(t.encode(x).ids), x


def test_token_counts_of_random_texts():
    """Marks, spaces, line feeds, unknown characters and long parts meet in every way; parts at once as one by one."""
    rng, vocab = np.random.default_rng(5), unigram.vocabulary(PIECES)
    small = [("<unk>", 0.0), ("▁", -3.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("bab▁", -1.0), ("cab", -2.5), ("▁▁", -1.5)]
    for v, letters, by_bytes in ((vocab, "   \n▁ab'then.%é中😀\0\r", True), (small, "   ▁aabbbc中z", False)):
        t = Tokenizer(models.Unigram(v, 0, by_bytes))
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        texts = ["".join(rng.choice(list(letters), n)) for n in rng.integers(0, 60, 1500)]
        texts += ["", "\n", "\n\n a", "▁", "▁a", "a" * 100, "x " + "ab中" * 50 + " z", "the\n" + "then" * 30]
        c = unigram.Counter(v, memo=50)
        for k in range(0, len(texts), 400):
            assert [n for n, _ in c.count(texts[k : k + 400])] == [len(t.encode(x).ids) for x in texts[k : k + 400]]
        parts = ["".join(rng.choice(list(letters.replace(" ", "")), n)).replace("\n", "") for n in rng.integers(1, 39, 500)]
        assert list(zip(*(x.tolist() for x in c.best_of(parts)), strict=True)) == [c.best(p) for p in parts]


def test_distinct_parts_take_no_calls_each():
    """The program runs once for 20,000 parts never met before: fewer Python calls than parts."""
    import cProfile
    import pstats

    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(20_000))
    c = unigram.Counter(unigram.vocabulary(PIECES))
    profile = cProfile.Profile()
    profile.runcall(c.count, [text])
    assert pstats.Stats(profile).total_calls < 5000
