"""Operators 2, 5, 9 and 10 and the pipeline."""

import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_audit.llm import base, langid, media, quality, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


# ---- language --------------------------------------------------------------------------------------------------------


def test_kneser_ney_by_hand():
    """Interpolated probabilities of a small text against the textbook recursion; and they sum to one."""
    text = "abab abba baab"
    code, _, _ = langid.sequences([text])
    counts = np.unique(code, return_counts=True)
    m = langid.kneser_ney({"x": counts})
    levels = [dict(zip(counts[0].tolist(), counts[1].tolist(), strict=True))]
    for order in (3, 2, 1):
        low = Counter()
        for g in levels[0]:
            low[g & ((1 << 16 * order) - 1)] += 1
        levels.insert(0, dict(low))

    def p(gram, order):
        if order == 0:
            return 1 / (len(levels[0]) + 1)
        c = levels[order - 1]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        rest = p(gram & ((1 << 16 * (order - 1)) - 1), order - 1)
        same = {g: v for g, v in c.items() if g >> 16 == gram >> 16}
        if not same:
            return rest
        total = sum(same.values())
        return max(c.get(gram, 0) - d, 0) / total + d * len(same) / total * rest

    grams = [g for g in levels[3]] + [(levels and 97) | 120 << 16, 98 | 98 << 16 | 98 << 32 | 98 << 48]
    got = m.score(np.array(grams, np.uint64))[:, 0]
    assert np.allclose(got, [math.log2(p(g, 4)) for g in grams], atol=1e-4)


@tables
def test_op2_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs.where(~langid.held_out()))).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    assert np.mean([r["rejected"] for r in found]) < 0.02 and all(0 <= r["score"] <= 1 for r in found)


def test_op2_edges(spark, docs, no_docs):
    models = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, models).collect()}
    for i in (72, 73, 74, 83):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1]["lang_pred"] == "en"
    assert langid.identify(no_docs, models).count() == 0
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


# ---- media -----------------------------------------------------------------------------------------------------------


def test_op2_texts_stay_in_the_tasks(spark):
    """What fitting takes of the driver's Python doesn't grow with the texts' lengths; the calibration is that of the texts themselves."""
    words = {"aa": "abc abd acb bca cab dab", "bb": "xyz xzy zyx yxz wyx zwx"}
    rows = [(i, " ".join(random.Random(i).choices(words[lang].split(), k=30_000)), lang) for i in range(120) for lang in [("aa", "bb")[i % 2]]]
    docs = base.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "long")
    held = docs.where(base.id_share() < 0.1).select("text", "lang").collect()
    assert len(held) > 5
    tracemalloc.start()
    models = langid.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    got = models.calibration
    langid.calibrate(models, *models.entropies([r["text"] for r in held]), [r["lang"] for r in held])
    for k, x in got.items():
        assert np.allclose(x, models.calibration[k], rtol=1e-9)


def test_pages_give_ordered_items():
    page = '<p>One &amp; two</p><figure><img src="sha256:aa" alt="A"><img src="bb"><figcaption>Both</figcaption></figure>tail<img srcset="cc 1x, dd 2x" alt="C"><img><script>var x="<p>no</p>"</script>'
    items = media.parse(page)
    assert [(x["position"], x["kind"], x["text"] or x["digest"] or "at " + x["src"], x["caption"]) for x in items] == [(0, "text", "One & two", None), (1, "media", "aa", "Both"), (2, "media", "at bb", "Both"), (3, "text", "tail", None), (4, "media", "at cc", "C")]
    assert media.parse(None) == [] and media.parse("<p> </p>") == []


def test_references_resolve_by_digest(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:d1">'), (2, '<img src="sha256:d1"><img src="sha256:no">'), (3, None)], "page_id long, html string")
    table = spark.createDataFrame([("d1", 5)], "digest string, size long")
    rows = media.resolve(media.sequences(pages), table).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["digest"], r["size"]) for r in rows] == [(1, 1, "d1", 5), (2, 0, "d1", 5), (2, 1, "no", None)]


@tables
def test_whole_pages_are_parsed(spark):
    """Every page gives its title and paragraphs in order; the given pages hold no media."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["items"] for r in media.sequences(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.limit(50).collect():
        items = got[r["page_id"]]
        assert [x["position"] for x in items] == list(range(len(items))) and {x["kind"] for x in items} == {"text"}
        assert items[0]["text"] == html.unescape(re.search("<title>(.*?)</title>", r["html"], re.S).group(1)).strip()


def test_many_references_to_one_digest(spark, monkeypatch):
    monkeypatch.setattr(base, "HEAVY", 3)
    pages = spark.createDataFrame([(i, '<img src="sha256:d1">' * (i % 3) + '<img src="u">') for i in range(40)], "page_id long, html string")
    table = spark.createDataFrame([("d1", 5), ("d2", 6)], "digest string, size long")
    rows = media.resolve(media.sequences(pages), table).collect()
    assert len(rows) == 40 + sum(i % 3 for i in range(40)) and all(r["size"] == (5 if r["digest"] else None) and (r["src"] == "u") == (r["digest"] is None) for r in rows)


def test_op5(docs, no_docs, texts):
    got = {r["doc_id"]: r for r in media.document_media(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r, png = got[i], media.to_png(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest()) and media.from_png(png) == payload
    assert got[3]["feature"] == got[70]["feature"] and got[72]["media_sha256"] == got[73]["media_sha256"]
    assert media.document_media(no_docs).count() == 0


# ---- quality ---------------------------------------------------------------------------------------------------------


def test_op9_statistics(docs, no_docs, texts):
    got = {r["doc_id"]: r for r in quality.rule_statistics(docs).collect()}
    for i, t in texts.items():
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                again += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_distinct"]) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), again, len(inside), len(set(w)))
    assert quality.rule_statistics(no_docs).count() == 0


def test_forest_tells_outliers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    f = quality.grow(x)
    assert f.score(np.full((5, 4), 9.0)).min() > np.quantile(f.score(x), 0.99)


def test_op9_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, none).collect()}
    assert got[72]["base_failed"] and not got[72]["kept"]
    assert all(r["kept"] != r["base_failed"] for r in got.values())


@tables
def test_op9_keeps_good_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels.where("quality = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows]) > 0.98


def test_op9_margin_weighs_both_labels():
    good, bad = np.linspace(0, 1, 1000), np.concatenate([np.linspace(2, 3, 80), np.linspace(0, 1, 20)])
    none = np.zeros(1000, bool)
    cut = quality.best_margin(good, none, bad)
    assert (good > cut).mean() <= 0.01 and (bad > cut).mean() >= 0.8
    cut = quality.best_margin(good, none, np.full(100, 0.993))
    assert (np.full(100, 0.993) > cut).all() and 0 < (good > cut).mean() <= 0.01
    assert (good > quality.best_margin(good, none, np.full(100, 0.5))).mean() <= 0.01


def test_op9_learns_from_all_labelled_rows(spark):
    """9000 good rows, more than a sample once held: trees draw from all of them, and the outlier limit is that of all."""
    rng = np.random.default_rng(4)
    n = 9000
    x = {c: rng.integers(200, 400, n) for c in quality.BASE_COLUMNS + quality.MORE_COLUMNS} | {"n_repeat_words": np.zeros(n, int)}
    rows = [(i, *(int(x[c][i]) for c in quality.BASE_COLUMNS + quality.MORE_COLUMNS)) for i in range(n)]
    table = spark.createDataFrame(rows, quality.STATISTICS)
    forest = quality.fit(table, spark.range(n).selectExpr("id as doc_id", "1 as quality"))
    assert len(forest.feature) == quality.TREES and forest.bad is None
    judged = quality.judge(table, forest).collect()
    assert len(judged) == n and 0 <= np.mean([not r["kept"] for r in judged]) < quality.FALSE_SHARE
    known = table.selectExpr("1 as quality", "cast(doc_id % 3 as int) as fold", "xxhash64(doc_id) as hash", *x)
    sizes = {(1, f): n // 3 for f in range(3)}
    forests = quality.forests_of(known, sizes)
    seen = quality.calibration(known, forests)
    assert sorted(forests) == [(1, -1), (1, 0), (1, 1), (1, 2)] and seen.count() == n  # the limits' scores: every row, not 8000


def test_op9_limits_from_counts():
    rng = np.random.default_rng(5)
    good, bad = rng.integers(0, 50, 3000) / 64, rng.integers(30, 70, 200) / 64
    lost = good > 48 / 64
    values, times = np.unique(good, return_counts=True)
    for q in (0.0, 0.3, 0.998, 1.0):
        assert quality.quantile_of(values, times, q) == pytest.approx(np.quantile(good, q))
    b, nb = np.unique(bad, return_counts=True)
    assert quality.best_margin(values, values > 48 / 64, b, times=(times, nb)) == quality.best_margin(good, lost, bad)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables here")
def test_op9_rejects_held_out_bad_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    table = base.stored(quality.rule_statistics(docs), "rules")
    rows = quality.judge(table, quality.fit(table, labels.where(~langid.held_out()))).join(labels, "doc_id").where(langid.held_out() & ~F.col("base_failed")).collect()
    kept = {q: [r["kept"] for r in rows if r["quality"] == q] for q in (0, 1)}
    print({q: (len(k), sum(k)) for q, k in kept.items()})
    assert len(kept[0]) > 50 and np.mean(kept[0]) < 0.1 and np.mean(kept[1]) > 0.98


# ---- toxicity --------------------------------------------------------------------------------------------------------


def test_pruned_neighbours_are_the_exact_ones():
    rng = np.random.default_rng(8)
    terms = [f"t{i}" for i in range(40)]
    rows = [(i, int(rng.integers(2)), {terms[k]: int(rng.integers(1, 4)) for k in rng.choice(40, rng.integers(1, 6), replace=False)}) for i in range(700)]
    df = {t: 1 + sum(t in c for _, _, c in rows) for t in terms}
    index = toxicity.build(rows, 700, df, terms, 0.1)
    full = np.zeros((700, 40))
    for i, (_, _, c) in enumerate(rows):
        at, w = index.vector(c)
        full[i, at] = w
    for _ in range(50):
        at, w = index.vector({terms[k]: int(rng.integers(1, 4)) for k in rng.choice(40, 4, replace=False)})
        cos = full[:, at] @ w
        want = np.lexsort((np.arange(700), -cos))[: toxicity.NEIGHBOURS]
        want = want[cos[want] > 0]
        near, c = index.nearest(at, w)
        assert np.allclose(c, cos[want]) and len(near) == len(want)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random(300)
    xs, ys = toxicity.isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) > 0).all() and 0 <= ys.min() and ys.max() <= 1


@pytest.fixture(scope="module")
def rude(spark, rng):
    from conftest_words import prose

    rows = []
    for i in range(400):
        t = prose(rng, rng.randint(20, 80))
        if i % 8 == 0:
            w = t.split(" ")
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobian", "rotter", "blackguard"]))
            t = " ".join(w)
        rows.append((i, t, int(i % 8 == 0)))
    rows += [(400, None, 0), (401, "", 0)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_op10(spark, rude):
    docs, labels = rude
    held = langid.held_out(folds=3, fold=1)
    index = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs, index).join(labels, "doc_id").where(held).collect()
    assert all(r["predicted"] == r["toxic"] for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), index).count() == 0


def test_payloads_come_back_in_their_places(spark, monkeypatch):
    """Texts, captions and bytes of interleaved pages stay aligned; unknown and wrong digests give null; a digest may be hot."""
    monkeypatch.setattr(base, "HEAVY", 3)
    bytes_of = {hashlib.sha256(b).hexdigest(): b for b in (b"one", b"two", b"", bytes(range(256)))}
    a, b, empty, c = bytes_of
    page = f'<p>First &amp; best.</p><figure><img src="sha256:{a}"><img src="sha256:{b}"><figcaption>Two of them</figcaption></figure>tail<img src="http://x/y.png" alt="far"><audio src="sha256:{"0" * 64}"></audio><p>end</p>'
    pages = [(i, f'<p>{i}</p><img src="sha256:{a}" alt="hot">') for i in range(20)] + [(100, page), (101, None), (102, "no media"), (None, page), (100, f'<img src="sha256:{c}"><img src="sha256:{empty}">')]
    store = [(d, bytearray(x)) for d, x in bytes_of.items()] + [(a, bytearray(b"one")), ("f" * 64, bytearray(b"wrong"))]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = media.with_payloads(media.sequences(df), spark.createDataFrame(store, "digest string, payload binary")).collect()
    assert len(got) == len(pages)
    for r in got:
        for x in r["items"]:
            want = bytes_of.get(x["digest"])
            assert (None if x["payload"] is None else bytes(x["payload"])) == want
    first = [[(x["position"], x["kind"], x["text"], x["caption"], x["src"], x["payload"] and bytes(x["payload"])) for x in r["items"]] for r in got if r["page_id"] == 100 and len(r["items"]) > 2]
    assert first == [[(0, "text", "First & best.", None, None, None), (1, "media", None, "Two of them", None, b"one"), (2, "media", None, "Two of them", None, b"two"), (3, "text", "tail", None, None, None), (4, "media", None, "far", "http://x/y.png", None), (5, "media", None, None, None, None), (6, "text", "end", None, None, None)]]
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(i) for i, _ in pages)
