"""Rows are told apart by doc_id and text; internal names never clash."""

import random

from scriptorium.llm import line_dedup, queries, simhash


def test_shared_ids_lose_no_text(spark):
    rng = random.Random(1)
    a, b = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(2))
    rows = [(3, a, 1), (8, a, 1), (8, b, 2), (9, b, 2), (9, b, 2), (None, a, 3), (4, None, 4), (5, "", 5), (6, b, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone long")
    for similarity in (None, 0.8):
        got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, similarity=similarity).collect()), key=str)
        assert got == sorted([(3, a), (6, b), (None, a), (4, None)], key=str)
    rows = [(8, b, 1), (8, b, 2), (9, a, 1), (8, a, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rk long")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs, similarity=0.8).collect()) == sorted([(8, a), (8, b)])
    assert simhash.keep_one(docs.limit(0), similarity=0.8).count() == 0


def test_clashing_names_in_line_dedup(spark):
    names = ["_d", "_rk", "_gone", "_lines", "_spot", "_slot", "_bits", "_d2", "key"]
    line = "this very line stands in more than one document here"
    rows = [(1, line, *range(9)), (2, line + "\nand some other text of the second one", *range(9)), (3, None, *range(9)), (4, "", *range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for sketch in (True, False):
        out = line_dedup.dedup(docs, drop_emptied=False, sketch=sketch)
        assert out.columns == docs.columns
        assert {r.doc_id: r.text for r in out.collect()} == {1: line, 2: "and some other text of the second one", 3: None, 4: ""}


def test_emptied_texts_have_no_lines(spark, tmp_path):
    line = "this very line stands in more than one document here"
    docs = spark.createDataFrame([(1, line + "\nmore"), (2, line), (3, None), (4, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_lines for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: 2, 2: 0, 3: None, 4: 0}
