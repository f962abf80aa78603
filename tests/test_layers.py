"""Folds over dependency graphs read their inputs once."""

from pyspark.sql import functions as F

from scriptorium.operators import layers


def test_fold_makes_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(x):
        seen.add(1)
        return x

    nodes = spark.createDataFrame([("g", str(i)) for i in range(6)], "graph string, id string")
    edges = spark.createDataFrame([("g", str(i), str(i - 1)) for i in range(1, 6)], "graph string, id string, dep string").withColumn("dep", F.udf(tell)("dep"))
    got = layers.fold(nodes, edges, {"deep": F.max("r_deep")}, {"deep": F.coalesce(F.col("deep").cast("int") + 1, F.lit(0))})
    assert {(r.id, r.layer, r.deep) for r in got.collect()} == {(str(i), i, i) for i in range(6)}
    assert seen.value == 5


def test_include_lines_and_fences(spark):
    text = "@a\n \t```go\n@b\n```\n@c d\n@e \t\n~~~\n@f\n~~~\n x\n@g"
    row = spark.createDataFrame([(text,), ("plain",), (None,)], "content string").select(layers.include_lines("content").alias("found")).collect()
    assert [r.found for r in row] == [["@a", "@e \t", "@g"], None, None]


def _chain(spark):
    nodes = spark.createDataFrame([("g", str(i)) for i in range(8)], "graph string, id string")
    edges = spark.createDataFrame([("g", str(i), str(i - 1)) for i in range(1, 8)], "graph string, id string, dep string")
    return layers.fold(nodes, edges, {"deep": F.max("r_deep")}, {"deep": F.coalesce(F.col("deep").cast("int") + 1, F.lit(0))})


def test_rounds_do_not_square_sizes(spark):
    """The size that Spark takes a result to have is its own, not a product of those of all rounds before."""
    assert _chain(spark)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_tables_of_past_rounds_go(spark):
    before = set(layers._written)
    got = _chain(spark)
    assert len(set(layers._written) - before) == 1
    assert {(r.id, r.layer, r.deep) for r in got.collect()} == {(str(i), i, i) for i in range(8)}
