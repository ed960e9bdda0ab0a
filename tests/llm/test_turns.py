"""Operator 11: the query against a brute force over all edits, on whole tables and on conversations that cross tasks and blocks."""

import functools
import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_audit.llm import turns

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def brute(conv, rows):
    """Numbers, audit and hash of one conversation's rows in order, by trying all edits."""
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    roles = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    @functools.cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def then(cost, letter, row, j, to, k=0):
            c, s, r = best(j, to, k)
            if c is not None:
                ways.append((cost + c, letter + s, (row, *r) if row is not None else r))

        if inserts < 3:
            for role in ("user", "assistant"):
                if step(state, role[0]):
                    then(5, "I", f"{role}:", i, step(state, role[0]), inserts + 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            then(2, "D", None, i + 1, state)
            if faults[i] in ("", "truncated"):
                extra = 5 * (faults[i] == "truncated")
                if step(state, role[:1]):
                    then(extra, "K", f"{role}:{text}", i + 1, step(state, role[:1]))
                for to in ("user", "assistant"):
                    if step(state, to[0]):
                        then(1 + extra, "R", f"{to}:{text}", i + 1, step(state, to[0]))
        return min(ways, default=(None, None, None))

    for i in range(len(rows), -1, -1):  # no deep recursion
        for state in ("", "s", "u", "a"):
            for k in (3, 2, 1, 0):
                best(i, state, k)
    cost, audit, lines = best(0, "", 0)
    return conv, gaps, *(faults.count(f) for f in turns.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows, damaged=True, key=None):
    ids = {r[0] for r in rows}
    of = defaultdict(list)
    for r in damage(rows) if damaged else [(c, t, r or (" " if r is None else ""), x or (" " if x is None else "")) for c, t, r, x in rows]:
        of[r[0]].append(r)
    order = key or (lambda r: (r[1] is not None, r[1] or 0))
    return sorted((brute(c, sorted(of[c], key=order)) for c in ids), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def generated(rng, conversations, longest):
    texts = ["Yes.", "No!", "what", "", " \n", "Well then.", "a b\tc? ", "é", "…"]
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
                out.append((c, t, role, rng.choice(texts) if rng.random() < 0.5 else f"row {t}."))
    return out


def test_small_conversations(spark, rng):
    rows = generated(rng, 300, 9) + [(None, 0, "user", "Hi."), (None, None, None, None), (900, None, "user", None), (900, 3, None, "x."), (901, 5, "system", "only."), (902, -(2**40), "user", "x." * 5000), (902, 2**40, "assistant", "y.")]
    assert got(turns.repair(turns.damaged(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)


def test_every_initial_and_fault_of_short_conversations(spark):
    """All conversations of up to three rows over roles and texts."""
    kinds = [(r, t) for r in ("user", "assistant", "system", "tool") for t in ("Yes.", "no", "")]
    rows, c = [], 0
    for n in (1, 2, 3):
        for at in np.ndindex(*[len(kinds)] * n):
            rows += [(c, i, *kinds[k]) for i, k in enumerate(at)]
            c += 1
    assert got(turns.repair(turns.undamaged(spark.createDataFrame(rows, SCHEMA)))) == expected(rows, damaged=False)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_compose(spark, rng, monkeypatch, block):
    """Conversations that cross blocks and tasks: the same results as in one piece."""
    rows = generated(rng, 12, 60)
    monkeypatch.setattr(turns, "BLOCK", block)
    df = turns.damaged(spark.createDataFrame(rows, SCHEMA))
    parts = turns.solved_or_blocks(turns.sorted_rows(df)).where("place is not null").count()
    assert parts > 12
    assert got(turns.repair(df)) == expected(rows)


def test_one_conversation_holds_most_rows(spark):
    """A conversation of many rows, a third of them equal, spreads over tasks and is composed again."""
    rows = [(7, t // 2, "user" if t % 3 else "assistant", f"row {t}." if t % 5 else "again.") for t in range(4000)]
    rows = [r for r in rows if r[3] != "again."] + [(7, 3, "user", "same.")] * 2000 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = turns.undamaged(spark.createDataFrame(rows, SCHEMA))
        spread = turns.solved_or_blocks(turns.sorted_rows(df)).where("place is not null and conv_id = 7").select((F.col("place") / F.lit(1 << 32)).cast("long").alias("task")).distinct().count()
        result = got(turns.repair(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 1
    # rows of one turn go by hash: the order that the operator used
    order = {(r["role"], r["text"]): r["h"] for r in df.select("role", "text", F.xxhash64("role", "text").alias("h")).distinct().collect()}
    assert result == expected(rows, damaged=False, key=lambda r: (r[1] is not None, r[1] or 0, order[(r[2], r[3])], r[2], r[3]))


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (2, 0, "system", "S."), (2, 1, "user", "Q?")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA + ", place long, h long, copies long, audit string")
    assert got(turns.repair(turns.undamaged(df))) == expected(rows, damaged=False)


def test_empty_table(spark):
    out = turns.repair(turns.damaged(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and [f"{n} {t}" for n, t in out.dtypes] == [x.replace(" long", " bigint") for x in turns.RESULT.split(", ")]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_op11_whole_table(spark):
    from cohort_audit.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_turns(spark, SF)) == expected(rows)
