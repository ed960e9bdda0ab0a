"""Operators 1 and 3 against brute force."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_audit.llm import base, minhash, suffixes


def words(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())


def classes(texts, similarity=0.8):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {("text", t or "")}
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_op1(docs, no_docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == classes(texts)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_op1_repeated_rows_and_null_ids(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + " "), (3, "other words are here now")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["class_id"]) for r in minhash.near_duplicates(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", None)]


def test_op1_texts_of_one_id_are_one_class(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    df = spark.createDataFrame([(1, x), (2, y), (5, x), (5, y), (6, z), (6, z), (7, z + " end")], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 6), (7, 6)}


def test_op1_finds_copies_with_a_repeated_passage(spark):
    """Pairs of equal shingle sets, of which one repeats a tenth of its shingles 60 times."""
    texts = {}
    for i in range(8):
        body, foot = " ".join(f"b{i}x{k}" for k in range(270)), " ".join(f"f{i}x{k}" for k in range(30))
        texts[2 * i] = f"{body} {foot} {foot}"
        texts[2 * i + 1] = " ".join([body] + [foot] * 60)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == classes(texts) == {i: i - i % 2 for i in texts}


def test_chain_and_hot_group(spark, rng):
    """Near copies of one text at all distances: links beyond the first node of a bucket are found."""
    start = [f"w{i}" for i in range(120)]
    texts = {0: " ".join(start)}
    for i in range(1, 80):
        w = list(start)
        for k in rng.sample(range(120), rng.randint(0, 7)):
            w[k] = f"x{rng.randint(0, 30)}"
        texts[i] = " ".join(w)
    w = list(start)
    for i in range(100, 120):  # a chain that drifts away
        w[(i - 100) * 6] = f"c{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == classes(texts)


@pytest.mark.parametrize("own", [42, 30, 26])
def test_texts_of_one_template_are_not_compared(spark, own):
    """Texts just too far for a link that share most words: no text is looked up by the template's shingles."""
    template = [f"t{k}" for k in range(215)]
    compared = {}
    for n in (40, 80):
        texts = {i: " ".join([*template, *(f"own{i}x{k}" for k in range(own))]) for i in range(n)}
        texts |= {1000 + i: " ".join([*template[: 200 + i], f"more{i}"]) for i in range(0, 12, 3)}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, of long")
        head, _ = minhash.prefix_heads(nodes, minhash.shingle_sets(df), 0.8)
        index = minhash.looked_up(head, 0.8)
        compared[n] = head.groupBy("shingle").count().join(index.groupBy("shingle").agg(F.count("node").alias("m")), "shingle").agg(F.coalesce(F.sum(F.col("count") * F.col("m")), F.lit(0))).first()[0]
        found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
        assert found == classes(texts)
    far = own / (215 + own) > 0.12
    assert compared[80] <= 2 * compared[40] if far else compared[80] > 0


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        b = a.copy()
        cut = int(400 * (1 - share) / (1 + share))
        b[:cut] = rng.integers(0, 2**63, cut)
        hits = []
        for seed in range(20):
            h, row, w = minhash.weighted(np.concatenate([base.mix(a, seed), base.mix(b, seed)]), np.repeat([0, 1], 400))
            s = minhash.signatures(h, row, w, 2)
            hits.append((s[0] == s[1]).mean())
        assert np.mean(hits) == pytest.approx((400 - cut) / (400 + cut), abs=0.04)


def test_weights_are_rates():
    """Probability Jaccard of {1: 3, 2: 1} and {1: 1, 2: 1}: 1 / (1 + 3/1 ... ) by the definition."""
    x, y = {1: 3.0, 2: 1.0}, {1: 1.0, 2: 1.0}
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in x if d in y)
    hits = []
    for seed in range(60):
        h = base.mix(np.array([1, 2, 1, 2], np.uint64), seed)
        s = minhash.signatures(h, np.array([0, 0, 1, 1]), np.array([3.0, 1, 1, 1]), 2)
        hits.append((s[0] == s[1]).mean())
    assert np.mean(hits) == pytest.approx(want, abs=0.05)


def brute_passages(texts, size):
    """Byte runs of each text covered by strings of ``size`` words that start at another place too."""
    found = [list(re.finditer(rb"[^ \t-\r]+", (t or "").encode())) for t in texts]
    lists = [[m.group() for m in f] for f in found]
    c = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for f, w in zip(found, lists, strict=True):
        runs = []
        for i in range(len(w) - size + 1):
            if c[tuple(w[i : i + size])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + size
                else:
                    runs.append([i, i + size])
        out.append([(f[a].start(), f[b - 1].end()) for a, b in runs])
    return out


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if c[b[i : i + size]] > 1:
                m[i : i + size] = True
        m = m[:-1]
        runs = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
        out.append((len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_op3(docs, no_docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.removed(docs, passages=suffixes.PASSAGES).collect()}
    runs = brute_passages(texts.values(), 49)
    assert sum(map(len, runs)) > 20
    want = [(*x, len(y), sum(b - a for a, b in y)) for x, y in zip(brute(texts.values(), 400), runs, strict=True)]
    assert got == dict(zip(texts, want, strict=True))
    assert suffixes.removed(no_docs).count() == 0


def test_op3_on_a_whole_table(spark):
    """All columns on the smallest documents, which hold copies, near copies, repeated lines and shared passages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.removed(docs, passages=suffixes.PASSAGES).collect()}
    assert got == {i: (*x, len(y), sum(b - a for a, b in y)) for i, x, y in zip(texts, brute(texts.values(), 400), brute_passages(texts.values(), 49), strict=True)}


def test_passages_of_over_50_words_go(spark, rng):
    """Passages of 51 words, shorter than 400 bytes, between words they run into; passages of 40 words stay."""
    own = lambda k, n: " ".join(f"{k}{x}" for x in rng.sample(range(1000), n))
    long, short = " ".join(f"p{k}" for k in range(51)), " ".join(f"q{k}" for k in range(40))
    rows = [(i, f"{own(f"a{i}x", 30)}.{long};{own(f"b{i}x", 30)} {short} {own(f"c{i}x", 5)}", 7) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for r in corpus_pipeline.without_repeats(spark, docs, "").collect():
        assert not re.search(r"\bp\d+ p", r["text"]) and short in r["text"] and r["n_chars"] == len(r["text"])
        assert len(r["text"].split()) == 30 + 30 + 40 + 5


def test_op3_repeated_rows_and_ids(spark):
    rows = [(1, "q" * 900), (1, "q" * 900), (2, "ab" * 300), (2, "cd" * 300 + "z" * 401), (None, "cd" * 300), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in suffixes.removed(df).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 400), strict=True))


def test_cut_texts_keep_the_other_columns(docs, texts):
    out = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert out[72]["text"] is None and out[3]["text"] == ("" if len(texts[3]) >= 400 else texts[3]) and out[3]["score"] == "z"


@pytest.mark.parametrize("size", [5, 12, 30])
def test_interval_expansion(size):
    rng = np.random.default_rng(size)
    shared = [bytes(rng.integers(97, 100, rng.integers(size, 3 * size)).astype(np.uint8)) for _ in range(3)]
    parts = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) + shared[rng.integers(3)] + bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(15)]
    parts += [parts[0], b"a" * 50, b""]
    c = Counter(b[i : i + size] for b in parts for i in range(len(b) - size + 1))
    for b, got in zip(parts, suffixes.repeated_starts([np.frombuffer(b, np.uint8) for b in parts], size), strict=True):
        assert got.tolist() == [i for i in range(len(b) - size + 1) if c[b[i : i + size]] > 1]


def test_equal_strings_pick_equal_anchors():
    rng = np.random.default_rng(4)
    same = rng.integers(97, 123, 700).astype(np.uint8)
    rows = [np.concatenate([rng.integers(97, 123, k).astype(np.uint8), same, rng.integers(97, 123, 50).astype(np.uint8)]) for k in (0, 13, 400)]
    seen = defaultdict(set)
    for k, r in zip((0, 13, 400), rows, strict=True):
        row, place, s0, s1 = suffixes.anchors(r, np.array([0, len(r)]))
        of = {s: p for p, a, b in zip(place, s0, s1, strict=True) for s in range(a, b + 1)}
        for s in range(301):
            seen[s].add(of[k + s] - k)
    assert all(len(v) == 1 for v in seen.values())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_a_join(spark, how, monkeypatch):
    monkeypatch.setattr(base, "BUCKETS", 3)
    many = spark.createDataFrame([(i % 5 if i else None, i) for i in range(200)] + [(7, k) for k in range(300)], "k long, v long")
    few = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (7, "d"), (9, "e"), (None, "f")], "k long, w string")
    heavy = many.groupBy("k").count().where("count > 100")
    got = base.split_join(many, few, ["k"], heavy, ["v"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, many.join(few, "k", how).collect()))


def test_near_duplicates_leave_only_what_they_read(spark, docs, monkeypatch):
    """Tables of the steps are gone before the classes are read; those left are the sketches, ids, nodes and classes."""
    made, plain = [], base.shared_path
    monkeypatch.setattr(base, "shared_path", lambda *a: made.append(plain(*a)) or made[-1])
    found = minhash.near_duplicates(docs)
    left = [Path(p).name.rsplit("-", 1)[0] for p in made if Path(p).exists()]
    assert len(made) > 10 and sorted(left) == ["classes", "ids", "nodes", "sketches"]
    assert found.count() == docs.count()
