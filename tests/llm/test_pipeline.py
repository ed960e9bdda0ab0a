"""The stages of the corpus pipeline against brute force, the operators' own verdicts and held-out labels."""

from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_passages, classes
from test_tokens import check_packing, ids_of

import corpus_pipeline as P
from cohort_audit.llm import base, langid, suffixes, toxicity

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES[:-1]:
        out.append(base.stored(stage(spark, out[-1], SF), name))
        assert out[-1].columns == docs.columns
    return out


def test_toxic_rows_go(spark, kept):
    docs, left = kept[:2]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = langid.held_out(folds=3, fold=1)
    found = toxicity.score(docs, toxicity.fit(docs, labels.where(~held)))
    assert rows_of(left) == rows_of(docs.join(found.where("predicted = 0").select("doc_id"), "doc_id").select(*docs.columns))
    rest = left.select("doc_id").withColumn("left", F.lit(1))
    judged = {r["toxic"]: r["share"] for r in docs.join(labels.where(held), "doc_id").join(rest, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("left", F.lit(0))).alias("share")).collect()}
    assert judged[0] > 0.97 and judged[1] < 0.4


def test_rejected_rows_go(kept):
    docs, left = kept[1:3]
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out())))
    assert rows_of(left) == rows_of(docs.join(found.where("not rejected").select("doc_id"), "doc_id").select(*docs.columns))
    assert left.count() > 0.98 * docs.count()


def test_least_of_each_class_stays(spark, docs, texts):
    left = {r["doc_id"] for r in P.one_of_near_duplicates(spark, docs, "").collect()}
    assert left == set(classes(texts).values())


def test_classes_of_the_whole_table(spark, kept):
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    assert {r["doc_id"] for r in kept[3].collect()} == set(classes(texts).values())


def test_passages_are_cut(spark, docs, texts, kept):
    for table in (docs, kept[3]):
        own = {r["doc_id"]: r["text"] for r in table.collect()}
        got = {r["doc_id"]: r for r in P.without_repeats(spark, table, "").collect()}
        assert got.keys() == own.keys()
        for (i, t), runs in zip(own.items(), brute_passages(own.values(), suffixes.PASSAGES.minimum), strict=True):
            raw, at, parts = (t or "").encode(), 0, []
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            want = None if t is None else b"".join([*parts, raw[at:]]).decode()
            assert got[i]["text"] == want and got[i]["n_chars"] == (None if want is None else len(want))


def test_all_that_is_kept_is_packed(spark, kept):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {i: [*ids, 2] for i, ids in ids_of(path, {r["doc_id"]: r["text"] for r in kept[4].collect()}).items()}
    n = check_packing(P.packed(spark, kept[4], SF).collect(), want, 1024)
    assert n <= 1.01 * sum(map(len, want.values())) / 1024 + 2


def test_repeated_rows_ids_and_nulls(spark):
    """One row a class stays whatever the ids; unlike texts of one id both stay, also where the other one goes."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcde")
    rows = [(1, a), (1, a), (None, b), (None, b), (None, b + " more"), (2, a), (2, e), (3, c), (None, c), (4, d), (4, d + " longer"), (9, "short"), (None, None), (None, None), (10, "")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars int, __hot string")
    one = base.stored(P.one_of_near_duplicates(spark, df, ""), "one")
    assert one.columns == df.columns
    got = defaultdict(list)
    for r in P.without_repeats(spark, one, "").collect():
        got[r["doc_id"]].append(r["text"])
    assert got[1] == [a] and got[2] == [e] and got[3] == [c] and got[9] == ["short"] and got[10] == [""]
    assert len(got[4]) == 1 and got[4][0] in (d, d + " longer")
    null = [t for t in got[None] if t is not None]
    assert len(null) == 1 and null[0] in (b, b + " more")


def test_flagged_rows_alone_go(spark):
    """A row of a repeated id goes by its own text, not by the other row's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("lang = 'en' and length(text) > 500").orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(1, "12 34 !!", "en", "s", 8), (1, good, "en", "s", len(good)), (None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema)
    left = [r for r in langid.known(docs.union(odd), langid.fit(docs)).collect() if r["source"] == "s"]
    assert [r["text"] for r in left] == [good]
    assert toxicity.clean(odd, None).count() == 4


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert P.packed(spark, docs, SF).count() == 0


def test_clashing_columns(spark, docs):
    """Further columns of any name keep their values through every stage and do no harm."""
    names = ["__key", "__often", "__marks", "__did", "key", "row", "cut", "a.b", "a`b", "id", "did", "marks", "often", "class_id", "toxic", "quality", "label", "score"]
    wide = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat_ws("-", F.lit(str(i)), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (P.not_toxic, P.known_language, P.one_of_near_duplicates, P.without_repeats):
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        got = out.collect()
        assert sorted((r[0], r[1], r[4]) for r in got if r[1] is not None) == sorted((r[0], r[1], r[4]) for r in stage(spark, plain, SF).collect() if r[1] is not None)
        assert all(r[5 + i] == f"{i}-{r[0]}" for r in got for i in range(len(names)))
    assert P.packed(spark, wide, SF).count() == P.packed(spark, plain, SF).count()
