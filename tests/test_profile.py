"""The one-pass profile against pandas, on odd columns and on many columns."""

import numpy as np
from pyspark.sql import functions as F

from cohort_audit.sources import profile


def test_against_pandas(spark):
    n = 5000
    df = spark.range(n).select(
        F.col("id"),
        (F.col("id") % 7).cast("int").alias("patient_race"),
        F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 20).cast("string")).alias("zip code"),
        (F.col("id") % 20).cast("string").alias("twenty"),
        (F.col("id") % 21).alias("a.b"),
        F.rand(1).alias("Income"),
        F.concat(F.lit("note "), F.col("id")).alias("text"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("id") < 3, float("nan")).otherwise(F.col("id") % 30 / 2).alias("half"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    got = {r["column"]: r for r in profile.detect_demographics(df.repartition(5)).collect()}
    pdf = df.toPandas()
    assert "id" not in got and set(got) == set(df.columns) - {"id"}
    for c, r in got.items():
        want = pdf[c].nunique() + int(pdf[c].isna().any())
        assert r["null_count"] == (0 if c == "half" else int(pdf[c].isna().sum()))
        assert r["n_unique"] == want if r["exact"] else abs(r["n_unique"] / want - 1) < 0.15
    assert {c: r["kind"] for c, r in got.items()} == {"patient_race": "categorical", "zip code": "categorical", "twenty": "categorical", "a.b": "numeric", "Income": "numeric", "text": "text", "nothing": "categorical", "half": "numeric", "flag": "categorical"}
    assert got["patient_race"]["sample_values"] == ["0", "1", "2", "3", "4"] and got["a.b"]["sample_values"] == ["min: 0.0", "max: 20.0"]
    assert got["nothing"]["n_unique"] == 1 and got["text"]["sample_values"] == ["note 0", "note 1", "note 10"]
    assert {c for c, r in got.items() if r["hinted"]} == {"patient_race", "zip code", "Income"}


def test_many_columns_make_no_expand(spark):
    df = spark.range(50).select(*((F.col("id") % (i + 1)).alias(f"c{i}") for i in range(200)))
    out = profile.profile(df)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: r["n_unique"] for r in out.collect()} == {f"c{i}": min(50, i + 1) for i in range(200)}


def test_merged_sets_equal_one(spark):
    c, parts = profile.Capped(), [profile.Capped() for _ in range(3)]
    values = np.random.default_rng(1).integers(0, 4000, 6000).astype(str)
    c._keep(profile.pd.util.hash_array(values.astype(object)), list(values))
    for i, p in enumerate(parts):
        p._keep(profile.pd.util.hash_array(values[i::3].astype(object)), list(values[i::3]))
    whole = profile.Capped()
    for p in parts:
        whole._keep(p.hashes, p.values)
    assert (whole.hashes == c.hashes).all() and whole.values == c.values
    assert abs(c.distinct() / len(set(values)) - 1) < 0.12


def test_empty(spark):
    df = spark.createDataFrame([], "y_true int, g string")
    r = profile.detect_demographics(df).first()
    assert r is None or (r["n_unique"], r["null_count"]) == (0, 0)
    assert profile.detect_demographics(df.select("y_true")).count() == 0
