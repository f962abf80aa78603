"""Language, toxicity and quality models: held-out accuracy, and the edge cases of each."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import language_id, quality_model, queries, toxicity

WIDE = "doc_id long, text string, score double, held_out int, label int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "12 34 !!"), (5, "word " * 60000), (6, "the same"), (6, "the same"), (None, "no id")]
    return spark.createDataFrame([(i, t, 0.5, 1, None, None) for i, t in rows], WIDE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], WIDE)


def docs_and_labels(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_words(spark):
    texts = ["the cat and the dog with this that"] * 30 + ["der hund und die katze mit dem nicht"] * 30
    m = language_id.train(texts, ["en"] * 30 + ["de"] * 30)
    post, first = language_id.label_words(m, [b"the dog and this und die katze nicht", b"katze"])
    names = [m.languages[k] for k in post.argmax(1)]
    assert names[:4] == ["en"] * 4 and names[5:8] == ["de"] * 3 and names[8] == "de" and first.tolist() == [0, 8, 9]


def test_chain_is_exact():
    """The blocked forward-backward against a plain one."""
    rng = np.random.default_rng(3)
    n, k = 700, 3
    u, a, b = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    r = np.zeros(n, bool)
    r[[0, 5, 6, 300, 511]] = True
    got, joint = language_id.posteriors(u, a, b, r, pairs=True)
    e, t, s = np.exp(u), np.exp(a), np.exp(b)
    want, pairs = np.zeros((n, k)), np.zeros((k, k))
    cuts = [*np.flatnonzero(r), n]
    for lo, hi in zip(cuts, cuts[1:]):
        f, g = [s * e[lo]], [np.ones(k)]
        for i in range(lo + 1, hi):
            f.append(f[-1] / f[-1].sum() @ t * e[i])
            g.append(t @ (e[hi - i + lo] * g[-1] / g[-1].sum()))
        g = g[::-1]
        for i in range(lo, hi):
            p = f[i - lo] * g[i - lo]
            want[i] = p / p.sum()
            if i + 1 < hi:
                q = f[i - lo][:, None] * t * (e[i + 1] * g[i + 1 - lo])
                pairs += q / q.sum()
    assert np.allclose(got, want, atol=1e-5) and np.allclose(joint, pairs, atol=1e-3)


def test_language_cases(spark, odd, empty):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the and of", "en")] * 5 + [("der und die", "de")] * 5 + [(None, "fr")] + [("x", None)])], "doc_id long, text string, lang string")
    m = language_id.fit(docs)
    assert m.languages == ["de", "en"]
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, m).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= got and len(got) == 7
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, m).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = docs_and_labels(spark, sf)
    got = queries.op5_toxicity(spark, sf).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    hit = held[held.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.8 and (held[held.toxic == 1].predicted == 1).mean() > 0.5
    assert (got.offending[got.score > 0.99] != "").mean() > 0.9


def test_toxicity_locates_sentences(spark):
    docs = spark.createDataFrame([(i, f"nice day number {i}. more words here." + (" you vile creature!" if i % 3 == 0 else "")) for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    m = toxicity.fit(docs, labels)
    text = "Ünïcode first. You VILE creature! Fine."
    score, spans = toxicity.score_texts(m, [text.encode(), b"nice day."])
    assert score[0] > 0.9 > 0.2 > score[1]
    assert [text[s["start"] : s["end"]].strip() for s in spans[0]] == ["You VILE creature"] and spans[1] == []


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_model, "quality")])
def test_scores_of_odd_texts(spark, odd, empty, module, label):
    labels = spark.createDataFrame([(1, 1), (1, 1), (6, 0), (77, 1), (None, 1), (5, None)], f"doc_id long, {label} int")
    for m in (module.fit(odd, labels, label), module.fit(empty, labels, label), module.fit(odd, labels.limit(0), label)):
        rows = module.score(odd, m).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 6}) == 1
        assert module.score(empty, m).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_tables_use_pairs():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_model.train(x, y)
    assert {frozenset(p[:2]) for p in m.pairs} >= {frozenset((0, 1))}
    assert ((quality_model.predict(m, x) > 0.5) == y).mean() > 0.9


def test_filter_keeps_columns(spark, odd):
    m = quality_model.Model(2.0, [np.zeros(0)] * len(quality_model.FEATURES), [np.zeros(1)] * len(quality_model.FEATURES))
    assert sorted(map(str, quality_model.filter_documents(odd, m).collect())) == sorted(map(str, odd.collect()))
    assert quality_model.filter_documents(odd, m, 0.99).count() == 0
