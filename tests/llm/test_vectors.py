"""Operator 12: links, components and kept rows against all pairs, on random vectors, groups of copies and odd rows."""

import numpy as np
import pyarrow.dataset as pads
import pytest

from cohort_audit.llm import base, vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, cosine=0.95):
    """Rows of the result by all pairs; also the pairs' cosines."""
    n = len(rows)
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = np.zeros((n, n), bool)
    for length in {len(v) for (_, v), s in zip(rows, sound, strict=True) if s}:
        at = [i for i in range(n) if sound[i] and len(rows[i][1]) == length]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    of = np.arange(n)
    while True:
        new = np.minimum(of, np.where(link, of[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == of).all():
            break
        of = new
    low = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            low[of[i]] = min(low.get(of[i], vec_id), vec_id)
    return sorted(((r[0], int(link[i].sum()), low.get(of[i]), r[0] is not None and r[0] == low.get(of[i])) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def turned(rng, x, cosine):
    """A vector at exactly about that cosine from x."""
    z = rng.standard_normal(len(x))
    z -= z @ x * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def clustered(seed, length=32, n=300):
    """Random vectors, pairs about the limit, tight and wide groups, chains."""
    rng = np.random.default_rng(seed)
    out = [x / np.linalg.norm(x) for x in rng.standard_normal((n, length))]
    out += [turned(rng, out[i], c) for i in range(60) for c in (0.97, 0.951, 0.949, 0.9)]
    for spread in (1.0, 0.9999, 0.99, 0.98, 0.97):
        centre = out[rng.integers(n)]
        out += [turned(rng, centre, spread) for _ in range(40)]
    x = out[0]
    for _ in range(30):
        x = turned(rng, x, 0.96)
        out.append(x)
    ids = rng.permutation(len(out))
    return [(int(i) * 10, (x * rng.uniform(0.1, 9)).tolist()) for i, x in zip(ids, out, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clustered_vectors(spark, seed):
    rows = clustered(seed)
    expected = brute(rows)
    assert sum(r[1] > 0 for r in expected) > 300
    assert got(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA))) == expected


@pytest.mark.parametrize("heavy", [5])
def test_groups_over_split_keys(spark, monkeypatch, heavy):
    monkeypatch.setattr(base, "HEAVY", heavy)
    rows = clustered(3)
    rows += [(10_000 + i, rows[0][1]) for i in range(50)]
    assert got(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_low_dimensions(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((150, length)))]
    assert got(vectors.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1e300, 0.0]), (9, [1e-300, 1e-310]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0])]
    rows += [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0]), (None, [0.0, -2.0]), (None, None), (20, [5e-324, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0, 3) for r in rows], SCHEMA + ", node long, cell string, cosine double, n_links long")
    assert got(vectors.near_vectors(df)) == brute(rows)


def test_at_the_limit(spark):
    """A cosine of exactly the limit is a link: 3-4-5 triangles have exact cosines."""
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [-0.6, 0.8])]
    out = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), cosine=0.8).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_empty_table(spark):
    out = vectors.near_vectors(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_simulated_recall():
    """Pairs at the limit share enough filters, at a table size and length of their own."""
    rng = np.random.default_rng(9)
    made = vectors.codes(64, 50_000, 0.95)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([turned(rng, v, 0.95) for v in x])
    shared = sum((c.decode(x)[:, :, None] == c.decode(y)[:, None, :]).any(2).sum(1) for c in made)
    assert (shared >= vectors.COMMON).mean() > 0.999
    far = sum((c.decode(x)[:, :, None] == c.decode(np.roll(x, 1, 0))[:, None, :]).any(2).sum(1) for c in made)
    assert (far >= vectors.COMMON).mean() < 0.001


@pytest.mark.parametrize("folder", ["sf0.1", "check_h"])
def test_op12_whole_table(spark, folder):
    from pathlib import Path

    from cohort_audit.llm import queries

    path = Path(f"/root/testdata/{folder}/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    table = pads.dataset(path).to_table(columns=["vec_id", "embedding"]).to_pylist()
    assert got(queries.op12_vectors(spark, str(path.parent))) == brute([(r["vec_id"], r["embedding"]) for r in table])
