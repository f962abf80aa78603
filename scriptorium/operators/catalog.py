"""The document graph: metadata rules, links, related documents, impact and replacement chains.

documents: (path, id, title, status, date, related, superseded_by,
sidebar_position, collection); links: (path, target, link_path, fragment,
kind, line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text

REASONS = ("changed_document", "direct_link", "related_document")


def metadata_problems(documents: DataFrame) -> DataFrame:
    """(path, code, message), a row for each broken rule."""
    c, s = F.col("collection"), F.col("status")
    # The messages of the rules.
    rules = [
        ((F.trim("id") == "") | (F.octet_length("id") > 128), "id is required and must be at most 128 bytes"),
        ((F.trim("title") == "") | (F.octet_length("title") > 1024), "title is required and must be at most 1024 bytes"),
        (F.size("related") > 128, "related exceeds 128 IDs"),
        ((c == "requirements") & ~s.isin("draft", "accepted", "retired"), "Requirement status must be draft, accepted, or retired"),
        ((c == "decisions") & ~s.isin("proposed", "accepted", "rejected", "superseded"), "Decision status must be proposed, accepted, rejected, or superseded"),
        ((c == "decisions") & (~F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date("date", "yyyy-MM-dd").isNull()), "Decision date must be YYYY-MM-DD"),
        ((c == "decisions") & (s == "superseded") & (F.col("superseded_by") == ""), "Superseded decision requires superseded_by"),
        ((c == "handbook") & (F.col("sidebar_position") < 1), "Handbook sidebar_position must be positive"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    return documents.select("path", F.lit("invalid_metadata").alias("code"), F.explode(found).alias("message"))


def duplicate_ids(documents: DataFrame) -> DataFrame:
    """A3: (path, id, copies)."""
    counts = documents.where("id <> ''").withColumn("copies", F.count("*").over(Window.partitionBy("id")))
    return counts.where("copies > 1").select("path", "id", "copies")


def duplicate_positions(documents: DataFrame) -> DataFrame:
    """A4: (path, sidebar_position, previous_path): handbook pages that repeat a position, with its holder before them in path order."""
    order = Window.partitionBy("sidebar_position").orderBy("path")
    pages = documents.where("collection = 'handbook' and sidebar_position >= 1").withColumn("previous_path", F.lag("path").over(order))
    return pages.where("previous_path is not null").select("path", "sidebar_position", "previous_path")


def resolve_related(documents: DataFrame) -> DataFrame:
    """(path, related_id, outcome, related_path): resolved, missing, ambiguous or template."""
    ids = documents.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("related_path"), F.max(F.col("collection") == "templates").alias("template"))
    asked = documents.select("path", F.explode("related").alias("related_id"))
    joined = asked.join(ids, asked["related_id"] == ids["id"], "left")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("template"), "template").otherwise("resolved")
    return joined.select("path", "related_id", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("related_path")).alias("related_path"))


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links to paths that are no file."""
    return links.join(files.select(F.col("path").alias("link_path")).distinct(), "link_path", "left_anti")


def edges(documents: DataFrame) -> DataFrame:
    """(src, dst) paths: related and superseded_by as an undirected edge set, unique targets only."""
    unique = documents.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("dst")).where("n = 1 and id <> ''")
    targets = F.concat(F.coalesce("related", F.array().cast("array<string>")), F.when(F.coalesce(F.col("superseded_by"), F.lit("")) != "", F.array("superseded_by")).otherwise(F.array().cast("array<string>")))
    one = documents.select(F.col("path").alias("src"), F.explode(targets).alias("id")).join(unique, "id").select("src", "dst").where("src <> dst")
    return one.union(one.select("dst", "src")).distinct()


def overlapping(left: DataFrame, left_path: str, right: DataFrame, right_path: str) -> DataFrame:
    """Pairs whose paths overlap (F14), by equality: the ancestors of a hold b, or those of b hold a; `.` is joined apart.

    right is the short list of asked paths. Columns of both sides are kept and must differ in name.
    """
    a, b = left.withColumn("_up", text.ancestors(left_path)), right.withColumn("_up2", text.ancestors(right_path))
    down = a.withColumn("_key", F.explode("_up")).join(right, F.col("_key") == F.col(right_path)).drop("_up", "_key")
    up = left.join(b.withColumn("_key", F.explode("_up2")), F.col(left_path) == F.col("_key")).drop("_up2", "_key")
    out = down.unionByName(up)
    dot = right.where(F.col(right_path) == ".").limit(1)
    every = left.join(F.broadcast(dot), F.lit(True))
    whole = left.where(F.col(left_path) == ".").join(right, F.lit(True))
    return out.unionByName(every).unionByName(whole).distinct()


def direct_impact(documents: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, reason, changed, line): documents that are changed, or link to a changed path."""
    asked = changed.select(F.col("path").alias("changed"))
    own = overlapping(documents.select("path").distinct(), "path", asked, "changed").select("path", F.lit(REASONS[0]).alias("reason"), "changed", F.lit(None).cast("int").alias("line"))
    via = overlapping(links.select("path", "link_path", "line"), "link_path", asked, "changed").select("path", F.lit(REASONS[1]).alias("reason"), "changed", F.col("line").cast("int").alias("line"))
    return own.unionByName(via)


def spread(start: DataFrame, links: DataFrame, depth: int = 2) -> DataFrame:
    """G1: (path, hops, trail) of every node within `depth` undirected edges of the start paths.

    First visit wins; among equally short trails the smallest is kept. Each
    level is one join of the frontier; depth is a small constant.
    """
    seen = start.select("path").distinct().withColumn("hops", F.lit(0)).withColumn("trail", F.array("path"))
    frontier = seen
    for hop in range(1, depth + 1):
        nexts = frontier.join(links, F.col("path") == F.col("src")).select(F.col("dst").alias("path"), F.lit(hop).alias("hops"), F.concat("trail", F.array("dst")).alias("trail"))
        frontier = nexts.join(seen.select("path"), "path", "left_anti").groupBy("path", "hops").agg(F.min("trail").alias("trail"))
        seen = seen.unionByName(frontier)
    return seen


def impact(documents: DataFrame, links: DataFrame, changed: DataFrame, limit: int = 100, evidence: int = 10) -> DataFrame:
    """(path, reason, changed, lines, trail), by reason then path, at most `limit`."""
    direct = direct_impact(documents, links, changed)
    rank = F.when(F.col("reason") == REASONS[0], 0).otherwise(1)
    lines = F.slice(F.sort_array(F.collect_set(F.when(F.col("line").isNotNull(), F.struct("line", "changed")))), 1, evidence)
    hits = direct.groupBy("path").agg(F.min(rank).alias("rank"), F.sort_array(F.collect_set("changed")).alias("changed"), lines.alias("lines"))
    reached = spread(hits, edges(documents))
    both = reached.join(hits, "path", "left").select("path", F.coalesce("rank", F.lit(2)).alias("rank"), "changed", "lines", "trail")
    return both.orderBy("rank", "path").limit(limit).select("path", F.element_at(F.array(*map(F.lit, REASONS)), F.col("rank") + 1).alias("reason"), "changed", "lines", "trail")


def unmapped(changed: DataFrame, direct: DataFrame) -> DataFrame:
    """Asked paths that no document covers."""
    return changed.join(direct.select(F.col("changed").alias("path")).distinct(), "path", "left_anti")


def replacements(documents: DataFrame, most: int = 32) -> DataFrame:
    """(path, hop, replacement): each superseded decision's chain of accepted or superseded successors, up to a cycle or `most` hops.

    All chains advance together: one join a hop, until none moves.
    """
    ids = documents.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("path", "collection", "status", "superseded_by")).alias("d")).where("n = 1")
    ids = ids.select("id", "d.*").where("collection = 'decisions' and status in ('accepted', 'superseded')")
    at = documents.where("collection = 'decisions' and superseded_by <> ''").select("path", F.col("id").alias("origin"), F.array("id").alias("seen"), F.col("superseded_by").alias("to"))
    out = None
    for hop in range(1, most + 1):
        step = at.join(ids.select(F.col("id").alias("to"), F.col("superseded_by").alias("after")), "to").where(~F.array_contains("seen", F.col("to")))
        rows = step.select("path", F.lit(hop).alias("hop"), F.col("to").alias("replacement"))
        out = rows if out is None else out.unionByName(rows)
        at = step.select("path", "origin", F.concat("seen", F.array("to")).alias("seen"), F.col("after").alias("to")).where("to <> ''")
        if hop % 4 == 0 and at.isEmpty():
            break
    return out


def first_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """One row of each (code, path)."""
    return diagnostics.dropDuplicates(["code", "path"])
