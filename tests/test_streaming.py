"""Ordered statistics of an out-of-order stream of files against the same statistics of the whole table."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_audit.streaming import ordered

START = datetime(2024, 3, 1)
SCORES, OUTCOMES = "id long, scored timestamp, y_prob double, g string", "id long, known timestamp, y_true int"


def rows(n=1200):
    """Scores over six hours and their outcomes up to an hour later; a few outcomes are missing."""
    rng = np.random.default_rng(7)
    scores, outcomes = [], []
    for i in range(n):
        t = START + timedelta(seconds=int(rng.integers(0, 6 * 3600)))
        p = float(np.round(np.clip(rng.beta(1, 2) + 0.05 * (t - START).seconds / 21600, 0, 1), 3))
        scores.append((i, t, p, None if i % 50 == 0 else str(rng.choice(["x", "y"]))))
        if i % 20:
            outcomes.append((i, t + timedelta(seconds=int(rng.integers(0, 3600))), int(rng.random() < p)))
    return scores, outcomes


def by_time(table, place, files, disorder):
    """The rows in files by time, each moved by up to ``disorder`` files."""
    rng = random.Random(3)
    ordered_ = sorted(table, key=lambda r: r[place])
    out = [[] for _ in range(files)]
    for i, r in enumerate(ordered_):
        out[min(files - 1, max(0, i * files // len(ordered_) + rng.randint(-disorder, disorder)))].append(r)
    return out


def write(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"f{i:03d}"))


def result(df):
    return {(r["attribute"], r["group"], r["window_start"]): r for r in df.collect()}


@pytest.mark.parametrize("disorder", [0, 1])
def test_out_of_order_stream_equals_the_table(spark, tmp_path, disorder):
    scores, outcomes = rows()
    late = 9_000_000  # rows far ahead close the windows of the test
    ends = [(late, START + timedelta(days=3), 0.5, "x")], [(late, START + timedelta(days=3), 1)]
    for name, table, place, schema, end in (("s", scores, 1, SCORES, ends[0]), ("o", outcomes, 1, OUTCOMES, ends[1])):
        write(spark, tmp_path / name, [*by_time(table, place, 12, disorder), end, [(r[0] + 1, r[1] + timedelta(hours=9), *r[2:]) for r in end]], schema)

    def joined(s, o):
        return ordered.buckets(ordered.with_outcomes(s, o, "id", "scored", "known", within="2 hours", late="3 hours"), "scored", ["g"])

    read = spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    stream = ordered.of_stream(joined(read.schema(SCORES).parquet(str(tmp_path / "s")), read.schema(OUTCOMES).parquet(str(tmp_path / "o"))))
    name = f"closed{disorder}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {k: r for k, r in result(spark.table(name)).items() if k[2] < START + timedelta(days=1)}
    want = result(ordered.of_table(joined(spark.createDataFrame(scores, SCORES), spark.createDataFrame(outcomes, OUTCOMES))))
    assert len(want) == 18 and got.keys() == want.keys()
    for k, w in want.items():
        for c in ("n", "n_positive"):
            assert got[k][c] == w[c]
        for c in ("auroc", "ace", "drift"):
            assert got[k][c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-12))


def test_table_against_a_count_by_hand(spark):
    scores, outcomes = rows(400)
    known = {i: (t, y) for i, t, y in outcomes}
    df = ordered.of_table(ordered.buckets(ordered.with_outcomes(spark.createDataFrame(scores, SCORES), spark.createDataFrame(outcomes, OUTCOMES), "id", "scored", "known", within="30 minutes"), "scored", ["g"]))
    got = result(df)
    for (attribute, group, start), r in got.items():
        own = [(p, known[i][1]) for i, t, p, g in scores if i in known and known[i][0] - t <= timedelta(minutes=30) and start <= t < start + timedelta(hours=1) and (attribute == "_overall" or g == group)]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        assert (r["n"], r["n_positive"]) == (len(own), len(pos))
        pairs = [(int(a * 1000), int(b * 1000)) for a in pos for b in neg]
        want = np.mean([(a > b) + (a == b) / 2 for a, b in pairs]) if pairs else None
        assert r["auroc"] == (None if want is None else pytest.approx(want, abs=0.01))
    first = min(k[2] for k in got)
    assert all((r["drift"] is None) == (k[2] == first) or k[1] != "_overall" for k, r in got.items())
    assert df.where(F.col("drift") < 0).count() == 0
