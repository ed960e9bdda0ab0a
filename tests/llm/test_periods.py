"""Operator 13: runs against a brute force over all periods, on number sequences, odd texts and whole tables."""

import hashlib
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from cohort_audit.llm import periods

SF = "/root/testdata/sf0.01"


def runs(w):
    """(start, length, period) of all runs, by start, then period."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            part = w[s : s + size]
            if size >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    top = (None,) * 4
    if found:
        s, size, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        top = (s, size, q, 1000 * size // q)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize(("grid", "top"), [(1, 2), (50, 3), (1 << 20, 12)])
def test_runs_of_number_sequences(rng, monkeypatch, grid, top):
    monkeypatch.setattr(periods, "GRID", grid)
    monkeypatch.setattr(periods, "TOP", top)
    for _ in range(80):
        texts = []
        for _ in range(rng.randint(1, 8)):
            w = [rng.randint(0, rng.choice([1, 2, 10])) for _ in range(rng.randint(0, 160))]
            for _ in range(rng.randint(0, 3) if w else 0):
                s, p = rng.randrange(len(w)), rng.randint(1, 12)
                for k in range(s + p, min(len(w), s + p + rng.randint(10, 90))):
                    w[k] = w[k - p]
            texts.append(w)
        off = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        got = periods.runs_of(np.array([x for w in texts for x in w], np.int64), off).tolist()
        assert got == [[off[t] + s, off[t] + s + size, q] for t, w in enumerate(texts) for s, size, q in runs(w)]


def test_long_sequences():
    """One run over all of a long text, none in a long random one, a run of a long period."""
    for w, expected in ((np.zeros(50_000, int), [[0, 50_000, 1]]), (np.arange(60_000) % 19_999, [[0, 60_000, 19_999]]), (np.random.default_rng(1).integers(0, 50, 200_000), [])):
        assert periods.runs_of(w.astype(np.int64), np.array([0, len(w)])).tolist() == expected


def check(spark, rows, plant):
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_runs string, key int")
    got = sorted((tuple(r) for r in periods.periodic_runs(df, plant).collect()), key=str)
    assert got == sorted((brute(r[0], r[1], plant) for r in rows), key=str)


@pytest.mark.parametrize("plant", [False, True])
def test_odd_texts(spark, texts, plant):
    rows = [(i, t, "x", "y", 1) for i, t in texts.items() if t is None or len(t) < 20_000]
    rows += [(None, "a b " * 30, "x", "y", 1), (None, None, "x", "y", 1), (100, "a b\x1cc " * 30, "x", "y", 1), (100, "a b\x1cc " * 30, "x", "y", 1), (100, "other", "x", "y", 1)]
    rows += [(200, "a b c " * 8 + "x " + "d e f " * 8, "x", "y", 1), (201, "a " * 23, "x", "y", 1), (202, "a " * 24, "x", "y", 1), (203, "\n".join("abcdefgh" * 3), "x", "y", 1)]
    check(spark, rows, plant)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = periods.periodic_runs(df)
    assert out.count() == 0 and out.columns == [c.split(" ")[0] for c in periods.SCHEMA.split(", ")]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_op13_whole_table(spark):
    from cohort_audit.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periods(spark, SF).collect()}
    assert len(got) == len(docs)
    brief = [r for r in docs if len((r["text"] or "").split()) < 2000]
    assert [got[r["doc_id"]] for r in brief] == [brute(r["doc_id"], r["text"]) for r in brief]
    assert sum(r[1] > 0 for r in got.values()) > 50
