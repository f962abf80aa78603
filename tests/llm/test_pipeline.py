"""The corpus pipeline over whole tables, stage by stage, against plain versions of each decision."""

import itertools

import corpus_pipeline
from scriptorium.llm import decontamination, piece_codec, quality_model, queries, simhash
from scriptorium.llm.runtime import fold

from .brute import line_groups
from .test_near_copies import groups_of, plain_fingerprint


def without(rows, stays):
    out = {}
    for i, t in rows:
        lines = t.split("\n")
        left = [x for n, x in enumerate(lines) if stays.get((i, n), True)]
        if len(left) == len(lines) or any(x.strip(" \t\x0b\f\r") for x in left):
            out[i] = "\n".join(left)
    return out


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        steps.append((name, docs, after))
        assert k == 4 or after.columns == columns
        docs = after
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = steps
    model = quality_model.fit(a, spark.read.parquet(f"{sf}/labels.parquet"), keep=fold("doc_id", 4) != 2)
    rows = a.collect()
    good = quality_model.predict(model, quality_model.features_of([r.text.encode() for r in rows])) >= 0.7
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r, g in zip(rows, good) if g}
    rows = [(r.doc_id, r.text) for r in b.collect()]
    want = without(rows, line_groups(rows)[0])
    texts = {r.doc_id: r.text for r in c.collect()}
    assert texts == want and all(r.n_chars == len(r.text) for r in c.collect())
    prints = {i: plain_fingerprint(t, 5) for i, t in want.items()}
    sets = {i: set(simhash.shingle_hashes(t.encode()).tolist()) for i, t in want.items()}
    links = [(x, y) for x, y in itertools.combinations(sorted(want), 2) if (prints[x] ^ prints[y]).bit_count() <= 2 or sets[x] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    group = groups_of(links, want)
    assert {r.doc_id for r in d.collect()} == {i for i in want if group[i] == i}
    items = [decontamination.shingles_of(decontamination.words_of(r.text.encode()), 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {r.doc_id: decontamination.shingles_of(decontamination.words_of(r.text.encode()), 5) for r in d.collect()}
    assert {r.doc_id for r in e.collect()} == {i for i, s in own.items() if all(len(x & s) < 0.8 * len(x) for x in items)}
    assert f.where("not lossless").isEmpty()
    back = {r.doc_id: r.text for r in piece_codec.decode(f, piece_codec.default_model()).collect()}
    assert back == {r.doc_id: r.text for r in e.collect()}


def test_line_query_on_whole_texts(spark, sf):
    """op10 against edit similarity of all pairs of lines; every removal is right, and at most 1 in 100 is missed."""
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    stays, links = line_groups(rows)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if stays.get((i, n), True)) for i, t in rows}
    got = {r.doc_id: r.text_sha256 for r in queries.op10_line_dedup(spark, sf).collect()}
    wrong = [i for i, t in want.items() if got[i] != hashlib.sha256(t.encode()).hexdigest()]
    assert links and len(wrong) <= len(want) // 100


def test_stages_take_odd_rows(spark, sf):
    """Nulls, empty and very long texts, repeats, clashing names and empty tables go through every stage."""
    long = " ".join(f"word{i * 7919 % 10007} of" for i in range(6000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, "text without an id"), (5, "x" * 40000), (6, "a\n\nb\t c"), (6, "another text of the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf)
            kept = out.collect()
            assert (name.startswith("Sentence") or out.columns == given.columns) and (kept or given is not docs)
    near = corpus_pipeline.near_copies(spark, docs, sf).collect()
    assert sorted(str((r.doc_id, (r.text or "")[:9])) for r in near) == sorted(map(str, [(1, ""), (3, long[:9]), (None, "text with"), (5, "x" * 9), (6, "a\n\nb\t c"), (6, "another t")]))


def test_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()
