"""Skill metadata reads each text once."""

from pyspark.sql import functions as F

from scriptorium.operators import skills


def test_front_matter_reads_its_content_once(spark):
    texts = ["---\nname: 'a-b'  \ndescription: x # y\n--- \t\nbody", "﻿---\r\nname: a # own\r\n---\r\n", "x---\n", "---\nname: a\n", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = [r.m for r in rows.withColumn("m", skills.front_matter(F.col("content"))).orderBy("i").collect()]
    assert [tuple(m) for m in got] == [(True, True, "a-b", "x"), (True, True, "a", None), (False, False, None, None), (True, False, None, None), (False, False, None, None), (False, False, None, None)]
    assert skills.front_matter(F.col("content"))._jc.toString().count("content") == 1
