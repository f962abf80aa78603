"""Incremental builds and freshness: outer joins of file lists by content hash.

File lists have (path, hash) and may have (chunks, size, kind, language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, state) with state unchanged, indexed or deleted."""
    c, p = current.select("path", F.col("hash").alias("now")), previous.select("path", F.col("hash").alias("before"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("indexed")
    return c.join(p, "path", "full_outer").select("path", state.alias("state"))


def build_report(diff: DataFrame, current: DataFrame) -> DataFrame:
    """A1: one row of counts."""
    files = current.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks"))
    return diff.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("indexed", "unchanged", "deleted")]).crossJoin(F.broadcast(files))


def index_stats(manifest: DataFrame) -> DataFrame:
    """A2."""
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("chunks"))


def freshness(selected: DataFrame, manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, state) of every path that is not fresh.

    selected: live files that the rules select; on_disk: every live path. A
    manifest path that is selected no more is `excluded` while it is on disk,
    and `deleted` once it is gone.
    """
    s, m = selected.select("path", F.col("hash").alias("now")), manifest.select("path", F.col("hash").alias("before"))
    both = s.join(m, "path", "full_outer").join(on_disk.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    state = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("now").isNotNull() & (F.col("now") != F.col("before")), "changed")
        .when(F.col("now").isNull() & F.col("there").isNull(), "deleted")
        .when(F.col("now").isNull(), "excluded")
    )
    return both.select("path", state.alias("state")).where("state is not null")


def freshness_summary(changes: DataFrame, most: int = 100, most_bytes: int = 16 * 1024) -> DataFrame:
    """A5: exact count and a bounded path sample for each state: the first `most` paths whose bytes together stay in most_bytes."""
    order = Window.partitionBy("state").orderBy("path")
    ranked = changes.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sample = ranked.withColumn("bytes", F.sum(F.octet_length("path")).over(upto)).where(F.col("bytes") <= most_bytes)
    paths = sample.groupBy("state").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return changes.groupBy("state").agg(F.count("*").alias("count")).join(paths, "state", "left")


def freshness_status(changes: DataFrame) -> str:
    """Fresh or stale."""
    return "fresh" if changes.isEmpty() else "stale"


def mark_stale(hits: DataFrame, manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Hits with `stale`: the live size, else the live hash, differs from the manifest, or the file cannot be read."""
    seen = manifest.select("path", F.col("hash").alias("_h"), F.col("size").alias("_s")).join(live.select("path", F.col("hash").alias("_lh"), F.col("size").alias("_ls")), "path", "left")
    stale = F.coalesce((F.col("_ls") != F.col("_s")) | (F.col("_lh") != F.col("_h")), F.lit(True))
    return hits.join(seen.select("path", stale.alias("stale")), "path", "left").withColumn("stale", F.coalesce("stale", F.lit(True)))


def duplicate_content(files: DataFrame) -> DataFrame:
    """(hash, copies, first_path) of contents that stand in several files."""
    return files.groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
