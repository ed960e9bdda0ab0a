"""Null and repeated ids, odd texts and clashing columns: every operator's results follow the text, row by row."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohort_audit.llm import bpe, langid, media, packing, periods, quality, tokenids, toxicity, unigram

WORD, BYTE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def learned(texts):
    """Labelled rows to learn from: ids beyond those of the odd table."""
    some = [t for i, t in texts.items() if t and len(t) > 200 and i < 62]
    return [(5000 + i, some[i % len(some)] + (" awful trash" if i % 3 == 0 else ""), "en" if i % 2 else "fr", i % 3 and 1, int(i % 3 == 0)) for i in range(120)]


@pytest.fixture(scope="module")
def models(spark, texts):
    rows = learned(texts)
    train = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality int, toxic int")
    return train, labels, langid.fit(train), toxicity.fit(train, labels)


def run(name, docs, models):
    """Rows (doc_id, result of the text) of an operator."""
    train, labels, languages, index = models
    if name == "op2":
        return langid.identify(docs, languages).select("doc_id", "lang_pred", "score")
    if name == "op4":
        return unigram.token_counts(docs, PIECES)
    if name == "op5":
        return media.document_media(docs)
    if name == "op6":
        return tokenids.token_ids(docs, WORD, 1).select("doc_id", "n_tokens", "ids_crc32")
    if name == "op7":
        rows = packing.pack(docs, BYTE, 2, 1024)
        return rows.select("doc_id", "piece", "start", "length", "ids_crc32")
    if name == "op8":
        return bpe.digests(docs, WORD)
    if name == "op9":
        return quality.quality(docs.select("doc_id", "text").union(train.select("doc_id", "text")), labels).where("doc_id is null or doc_id < 5000")
    if name == "op10":
        return toxicity.score(docs, index).select("doc_id", "score", "predicted")
    return periods.periodic_runs(docs)


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op13"])
def test_rows_of_any_id(spark, texts, models, name):
    """Ids that are null or occur with several texts change nothing but the id; equal rows give equal rows; other columns do no harm."""
    few = {i: t for i, t in texts.items() if i in (0, 3, 41, 55, 70, 72, 73, 74, 75, 77, 79, 81, 83, 86)}
    clean = spark.createDataFrame(list(few.items()), "doc_id long, text string")
    odd = [(None if i % 2 else 7, t) for i, t in few.items()] + [(9, few[3]), (9, few[3]), (9, few[0])]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in ("lang", "label", "score", "quality", "toxic", "key", "n_tokens", "`a.b`", "piece", "start", "h"))
    wide = spark.createDataFrame([(*r, *"abcdefghijk") for r in odd], schema)
    of = {}
    for r in run(name, clean, models).collect():
        of.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    by_text = {i: sorted(map(repr, v)) for i, v in of.items()}
    assert by_text.keys() == few.keys()
    want = sorted((str(None if i % 2 else 7), x) for i in few for x in by_text[i]) + [("9", x) for i in (3, 3, 0) for x in by_text[i]]
    got = sorted((str(r["doc_id"]), repr(tuple(r)[1:])) for r in run(name, wide, models).collect())
    if name == "op7":  # a cut document's pieces are counted from its own start
        assert sorted(g[1] for g in got) == sorted(w[1] for w in want)
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op13"])
def test_no_rows(spark, models, name):
    docs = spark.createDataFrame([], "doc_id long, text string, x int")
    assert run(name, docs, models).where(F.lit(True)).count() == 0
