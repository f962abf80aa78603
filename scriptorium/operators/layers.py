"""Dependency graphs, many at once, folded layer by layer.

A graph's nodes are (graph, id, ...), its edges (graph, id, dep, pos, ...): id
needs dep. `fold` gives every node a result from the results of what it needs:
in each round those nodes are done whose needs are all done, so the rounds are
as many as the longest chain has nodes, whatever the number of graphs. Each
round joins the open edges with the nodes done in the round before, sums up
per node, and is written to the checkpoint folder as tables, whose size Spark
knows; those that no later round reads are deleted. Nodes that are left open
when a round finds nothing new lie on a cycle or need one that does.

A node that very many others need is one row on the small side of that join,
whose large side Spark splits.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def settle(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder as a table and read again, its lineage cut. Only a local session may leave that folder unset.

    A checkpoint of Spark's would keep the size that was estimated for the
    plan. A join multiplies the sizes of its sides, so every round squares
    them, and after some twenty rounds the number alone fills the driver.
    Tables go by `_drop`, or when this process ends.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-layers-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/scriptorium-layers-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptorium_layers = path
    return out


def _drop(*tables: DataFrame) -> None:
    """Delete these settled tables. Nothing that is still to be computed may read them."""
    for df in tables:
        path = df._scriptorium_layers
        spark = _written.pop(path, None)
        if spark is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):  # the session may have been stopped
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(nodes: DataFrame, edges: DataFrame, needed: dict[str, Column], result: dict[str, Column], limit: int | None = None) -> DataFrame:
    """(graph, id, layer, results...): layer 0 needs nothing.

    `needed` are aggregates over a node's edges and the results of their deps,
    named `r_...` as in `result` with that prefix; `result` are columns over the
    node's own columns and those aggregates, which are null for a node that
    needs nothing. Nodes on or above a cycle, or above a dep that is no node,
    get no row; with `limit`, nor do layers beyond it.
    """
    own = [c for c in nodes.columns if c not in ("graph", "id")]
    # Every round reads the open edges, so they are made once and shrink with the open nodes.
    tried = settle(edges)
    left = tried
    wants = left.groupBy("graph", "id").agg(F.count("*").alias("_wants"))
    waiting = settle(nodes.join(wants, ["graph", "id"], "left").withColumn("_wants", F.coalesce("_wants", F.lit(0))))
    blank = [F.lit(None).alias(n) for n in needed]
    start = waiting.where("_wants = 0").select("graph", "id", *own, *blank)
    # The first layer's aggregates are null; their types come from the columns that use them.
    latest = settle(start.select("graph", "id", F.lit(0).alias("layer"), *[c.alias(n) for n, c in result.items()]))
    done = [latest]
    open_, rows, partial = waiting.where("_wants > 0"), None, None
    layer = 0
    while (limit is None or layer < limit) and not latest.isEmpty() and not open_.isEmpty():
        layer += 1
        known = latest.select("graph", F.col("id").alias("dep"), *[F.col(n).alias(f"r_{n}") for n in result], F.lit(True).alias("_hit"))
        # Edges whose dep was done in this round go beside the node, where those of earlier rounds are kept; the others stay open.
        before, tried = tried, settle(left.join(known, ["graph", "dep"], "left"))
        _drop(before)
        hit = tried.where("_hit").drop("_hit")
        before, rows = rows, settle(hit if partial is None else partial.unionByName(hit))
        if before is not None:
            _drop(before)
        full = rows.groupBy("graph", "id").agg(F.count("*").alias("_has"), *[c.alias(n) for n, c in needed.items()]).join(open_, ["graph", "id"]).where("_has = _wants")
        latest = settle(full.select("graph", "id", F.lit(layer).alias("layer"), *[c.alias(n) for n, c in result.items()]))
        done.append(latest)
        ready = latest.select("graph", "id")
        before, waiting = waiting, settle(open_.join(ready, ["graph", "id"], "left_anti"))
        _drop(before)
        open_ = waiting
        partial = rows.join(ready, ["graph", "id"], "left_anti")
        left = tried.where("_hit is null").select(*edges.columns)
    _drop(tried, waiting, *([] if rows is None else [rows]))
    if len(done) == 1:
        return latest
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = settle(out)
    _drop(*done)
    return out


def clean_path(path: Column) -> Column:
    """A relative path without empty and `.` parts, `..` taken back; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))
    up = lambda s: F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["inside"] & (F.size(s["at"]) > 0)).alias("inside"))
    down = lambda s, p: F.struct(F.concat(s["at"], F.array(p)).alias("at"), s["inside"].alias("inside"))
    end = F.aggregate(parts, start, lambda s, p: F.when(p == "..", up(s)).otherwise(down(s, p)))
    return F.when(end["inside"], F.array_join(end["at"], "/"))


#: How an instruction file includes another, alone on its line.
INCLUDE = r"^@(\S+)[ \t]*$"
DEPTH = 32


def include_lines(content: str) -> Column:
    """array<string>: the include lines of a text outside fences, in order."""
    bare = lambda x: F.ltrim(x, F.lit(" \t\n\x0b\f\r"))
    fence = lambda x: F.startswith(bare(x), F.lit("```")) | F.startswith(bare(x), F.lit("~~~"))
    # Only few lines can be a fence or an include; no pattern is matched against the others.
    lines = F.filter(F.split(content, "\n"), lambda x: F.startswith(x, F.lit("@")) | fence(x))
    # The state of the fence after each line, one step a line.
    step = lambda s, x: F.struct((s["open"] != fence(x)).alias("open"), F.when(~s["open"] & ~fence(x) & x.rlike(INCLUDE), F.concat(s["found"], F.array(x))).otherwise(s["found"]).alias("found"))
    found = F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("found")), step)["found"]
    return F.when(F.contains(content, F.lit("@")), found)


def targets(files: DataFrame) -> DataFrame:
    """`includes` of files (graph, id, found) whose include lines are known."""
    each = files.select("graph", "id", F.posexplode("found").alias("pos", "line"))
    target = F.regexp_extract("line", INCLUDE, 1)
    folder = F.regexp_extract("id", r"^(.*/)?[^/]*$", 1)
    return each.select("graph", "id", F.when(~target.rlike("^[/~]"), clean_path(F.concat(folder, target))).alias("dep"), "pos", F.octet_length("line").cast("bigint").alias("marker"))


def includes(files: DataFrame) -> DataFrame:
    """(graph, id, dep, pos, marker): the include lines of files (graph, id, content) outside fences; dep is null where the target is absolute, a home path or outside the root; marker is the length of the include."""
    return targets(files.select("graph", "id", include_lines("content").alias("found")))


def measured(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, id, own, whole, problem): each file's bytes by itself and with all that it includes, see `instruction_sizes`; one fold for both."""
    bytes_ = F.col("bytes").cast("bigint")
    whole = files.select("graph", "id", bytes_.alias("bytes"), F.lit(None).cast("int").alias("fault"))
    links = settle(edges.withColumn("dep", F.coalesce("dep", F.lit("\0"))))
    # Targets that are no files become nodes with a fault, so that faults rise like sizes. Ids of files hold no NUL.
    missing = links.select("graph", F.col("dep").alias("id")).distinct().join(files, ["graph", "id"], "left_anti")
    broken = missing.select("graph", "id", F.lit(0).cast("bigint").alias("bytes"), F.when(F.col("id") == "\0", 2).otherwise(1).alias("fault"))
    needed = {"more": F.sum(F.col("r_bytes") - F.col("marker")), "worst": F.max("r_fault"), "deep": F.max("r_height")}
    height = F.coalesce(F.col("deep").cast("int") + 1, F.lit(0))
    result = {"bytes": F.col("bytes") + F.coalesce(F.col("more").cast("bigint"), F.lit(0)), "fault": F.greatest(F.col("fault"), F.col("worst").cast("int"), F.when(height >= DEPTH, 0)), "height": height}
    got = fold(whole.unionByName(broken), links, needed, result)
    both = files.select("graph", "id", bytes_.alias("own")).join(got.withColumnRenamed("bytes", "whole"), ["graph", "id"], "left")
    problem = F.when(F.col("layer").isNull(), "cycle").when(F.col("fault") == 2, "outside").when(F.col("fault") == 1, "missing").when(F.col("fault") == 0, "depth")
    return both.select("graph", "id", "own", F.when(problem.isNull(), F.col("whole")).alias("whole"), problem.alias("problem"))


def sizes_of(got: DataFrame, mode: str = "sum") -> DataFrame:
    """(graph, id, bytes, problem) of `measured` rows by mode, see `instruction_sizes`."""
    if mode == "none":
        return got.select("graph", "id", F.col("own").alias("bytes"), F.lit(None).cast("string").alias("problem"))
    return got.select("graph", "id", F.col("whole").alias("bytes") if mode == "sum" else F.when(F.col("problem").isNull(), F.col("own")).alias("bytes"), "problem")


def instruction_sizes(files: DataFrame, edges: DataFrame, mode: str = "sum") -> DataFrame:
    """A10: (graph, id, bytes, problem) of files (graph, id, bytes) with includes (graph, id, dep, pos, marker).

    sum: a file's bytes with each include line replaced by what it includes;
    each: every file by itself, its includes still followed; none: no includes.
    An include counts as often as it stands there, but a file is measured once.
    problem: `cycle` for a file on a cycle or above one, `outside`, `missing` or
    `depth` (more than 32 levels) for a file that includes such a one at any
    depth, in this order; bytes are null then.
    """
    if mode == "none":
        return files.select("graph", "id", F.col("bytes").cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("problem"))
    return sizes_of(measured(files, edges), mode)


def instruction_limits(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """(engine, graph, id, bytes, limit, exceeds) of every measured file for every (engine, limit)."""
    table = F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(n).cast("bigint").alias("limit")) for e, n in limits])
    each = sizes.where("problem is null").select(F.explode(table).alias("l"), "graph", "id", "bytes")
    return each.select("l.engine", "graph", "id", "bytes", "l.limit", (F.col("bytes") > F.col("l.limit")).alias("exceeds"))


def resolve_values(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(graph, id, value, problem) of files (graph, id, value) with imports (graph, id, dep, pos).

    A file's own value wins; else it has that of its imports, which must agree
    where they have one. problem: `cycle`, or `conflict` or `missing` in the file
    or in anything that it imports, even if it has a value of its own; `missing`
    comes first.
    """
    base = files.select("graph", "id", "value", F.lit(None).cast("int").alias("fault"))
    absent = imports.select("graph", F.col("dep").alias("id")).distinct().join(files, ["graph", "id"], "left_anti")
    base = base.unionByName(absent.select("graph", "id", F.lit(None).cast("string").alias("value"), F.lit(2).alias("fault")))
    # Two different values show as a least and a greatest that differ, however many imports there are.
    needed = {"low": F.min("r_value"), "high": F.max("r_value"), "worst": F.max("r_fault")}
    conflict = F.when(F.col("low").cast("string") != F.col("high").cast("string"), 1)
    result = {"value": F.coalesce("value", F.col("low").cast("string")), "fault": F.greatest(F.col("fault"), F.col("worst").cast("int"), conflict)}
    got = files.select("graph", "id").join(fold(base, imports.select("graph", "id", "dep", "pos"), needed, result), ["graph", "id"], "left")
    problem = F.when(F.col("layer").isNull(), "cycle").when(F.col("fault") == 2, "missing").when(F.col("fault") == 1, "conflict")
    return got.select("graph", "id", F.when(problem.isNull(), F.col("value")).alias("value"), problem.alias("problem"))


def ordered_checks(checks: DataFrame, needs: DataFrame) -> DataFrame:
    """(graph, id, position, status, message, problem) of checks (graph, id, place, outcome) with needs (graph, id, dep, pos).

    A graph is refused as a whole, with one row that names the problem, if an
    id is there twice, a check needs an unknown one, or needs form a cycle.
    Otherwise a check stands after all that it needs, else as registered by
    `place`: where a depth-first walk from each check in that order leaves it.
    A check that needs a failed or skipped one is skipped and names the first
    such need; others have their outcome, which is pass, warn or fail.
    """
    twice = checks.groupBy("graph", "id").count().where("count > 1").groupBy("graph").agg(F.concat(F.lit("duplicate check "), F.min("id")).alias("problem"))
    unknown = needs.join(checks, [needs["graph"] == checks["graph"], needs["dep"] == checks["id"]], "left_anti").groupBy("graph").agg(F.concat(F.lit("unknown check dependency "), F.min("dep")).alias("problem"))
    odd = checks.where(~F.coalesce(F.col("outcome").isin("pass", "warn", "fail"), F.lit(False))).groupBy("graph").agg(F.concat(F.lit("invalid status of "), F.min("id")).alias("problem"))
    rank = lambda df, n: df.select("graph", F.struct(F.lit(n).alias("rank"), "problem").alias("p"))
    bad = settle(rank(twice, 0).unionByName(rank(unknown, 1)).unionByName(rank(odd, 3)).groupBy("graph").agg(F.min("p")["problem"].alias("problem")))
    good, edges = checks.join(bad, "graph", "left_anti"), needs.join(bad, "graph", "left_anti")
    # Upwards: whether anything that a check needs failed.
    needed = {"failed": F.max((F.col("r_status") != "pass") & (F.col("r_status") != "warn")), "first": F.min(F.when(F.col("r_status").isin("fail", "skipped"), F.struct("pos", "dep")))["dep"]}
    status = F.when(F.coalesce(F.col("failed").cast("boolean"), F.lit(False)), "skipped").otherwise(F.col("outcome"))
    up = fold(good.select("graph", "id", "outcome"), edges, needed, {"status": status, "first": F.col("first").cast("string")})
    looped = good.join(up, ["graph", "id"], "left_anti").select("graph").distinct()
    # Downwards: the least walk that reaches a check, as the places and positions on its way; what it needs is left before it.
    walk = fold(good.select("graph", "id", "place"), edges.select("graph", F.col("dep").alias("id"), F.col("id").alias("dep"), "pos"), {"via": F.min(F.concat(F.col("r_walk"), F.array(F.col("pos").cast("bigint"))))}, {"walk": F.least(F.array(F.col("place").cast("bigint")), F.col("via").cast("array<bigint>"))})
    rows = up.join(walk.select("graph", "id", "walk"), ["graph", "id"]).join(looped, "graph", "left_anti")
    order = F.concat("walk", F.array(F.lit((1 << 63) - 1)))
    ordered = rows.withColumn("position", F.row_number().over(Window.partitionBy("graph").orderBy(order)).cast("int"))
    fine = ordered.select("graph", "id", "position", "status", F.when(F.col("status") == "skipped", F.concat(F.lit("Dependency unavailable: "), "first")).alias("message"), F.lit(None).cast("string").alias("problem"))
    refused = bad.unionByName(looped.withColumn("problem", F.lit("check dependency cycle")))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("id", "string"), ("position", "int"), ("status", "string"), ("message", "string"))]
    return fine.unionByName(refused.select("graph", *none, "problem"))
