"""Term statistics without postings."""

import re

from pyspark.sql import functions as F

from scriptorium.operators import search


def test_term_counts_shuffle_terms_only(spark):
    rows = [(f"c{i}", "p", "code", "go", "go b Go", "", "f.go", "x X y x" if i % 2 else "", "the b b" if i % 3 else None) for i in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, kind string, language string, title string, names string, filename string, code string, prose string")
    got = search.term_counts(chunks)
    want = search.term_statistics(search.postings(chunks))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("field", "term", "df", "cf").collect()))
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())
    assert shuffles and all("field" in x and "term" in x and "chunk_id" not in x for x in shuffles)
    assert {tuple(r) for r in got.where(F.col("field") == "code").collect()} == {("code", "x", 6, 18), ("code", "y", 6, 6)}
