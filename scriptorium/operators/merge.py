"""Three-way decisions, overlays, managed blocks and settings merges."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge3(base: DataFrame, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(path, action): take_incoming, keep_current, remove, absent, conflict, or merge (both sides changed the text).

    Inputs are (path, hash); a path missing from a table does not exist there.
    """
    sides = [d.select("path", F.col("hash").alias(n)) for n, d in (("b", base), ("c", current), ("i", incoming))]
    all_ = reduce(lambda x, y: x.join(y, "path", "full_outer"), sides)
    b, c, i = F.col("b"), F.col("c"), F.col("i")
    action = (
        F.when(i.isNull(), F.when(c.isNull(), "absent").when(c.eqNullSafe(b), "remove").otherwise("conflict"))
        .when(c.isNull(), F.when(b.isNull(), "take_incoming").when(b == i, "absent").otherwise("conflict"))
        .when(c.eqNullSafe(b) | (c == i), "take_incoming")
        .when(b.eqNullSafe(i), "keep_current")
        .otherwise("merge")
    )
    return all_.select("path", action.alias("action"))


def merge_lock(manifest_ids: DataFrame, project: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, state): bundled dependencies take the incoming state, others keep the project's; bundled ids are those of manifest_ids."""
    own = manifest_ids.select("id").distinct().withColumn("bundled", F.lit(True))
    both = project.select("id", F.col("state").alias("p")).join(incoming.select("id", F.col("state").alias("n")), "id", "full_outer").join(own, "id", "left")
    return both.select("id", F.when(F.col("bundled"), F.col("n")).otherwise(F.col("p")).alias("state")).where("state is not null")


def overlay(base: DataFrame, local: DataFrame) -> DataFrame:
    """J14 on flattened settings (path, value): a local path wins, and its null clears; the rest is inherited."""
    b, o = base.select("path", F.col("value").alias("b")), local.select("path", F.col("value").alias("o"), F.lit(True).alias("set"))
    return b.join(o, "path", "full_outer").select("path", F.when(F.col("set"), F.col("o")).otherwise(F.col("b")).alias("value"), F.coalesce("set", F.lit(False)).alias("overridden"))


def overlay_maps(base: dict, local: dict) -> dict:
    """J14 on nested settings: maps merge by key, everything else is replaced, null clears."""
    out = dict(base)
    for k, v in local.items():
        out[k] = overlay_maps(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def managed_block(content: Column, begin: str, end: str, block: str | None) -> Column:
    """K9: content with the lines between the marker lines replaced by `block`, or without them (block None); appended if there are none.

    One begin and one end marker in order are needed, or neither; anything else fails the row's job.
    """
    body = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\n\z", ""), "\n"))
    at, to = F.array_position(body, begin), F.array_position(body, end)
    marks = F.size(F.filter(body, lambda x: (x == begin) | (x == end)))
    new = F.array(F.lit(begin), *[F.lit(x) for x in block.rstrip("\n").split("\n")], F.lit(end)) if block is not None else F.array().cast("array<string>")
    head, tail = F.slice(body, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.slice(body, (to + 1).cast("int"), F.size(body))
    out = F.when(marks == 0, F.concat(body, new)).when((marks == 2) & (at > 0) & (at < to), F.concat(head, new, tail)).otherwise(F.raise_error(F.lit("malformed managed block")).cast("array<string>"))
    return F.when(F.size(out) == 0, "").otherwise(F.concat(F.array_join(out, "\n"), F.lit("\n")))


def merge_settings(content: str, data: dict, managed: list[str], defaults: list[str]) -> str:
    """JSON settings with managed dotted paths replaced (or dropped), default paths filled where absent, and the rest kept."""
    out = json.loads(content) if content.strip() else {}
    if not isinstance(out, dict):
        raise ValueError("settings must be an object")

    def get(node, parts):
        for p in parts:
            if not isinstance(node, dict) or p not in node:
                return None, False
            node = node[p]
        return node, True

    def put(parts, value):
        node = out
        for p in parts[:-1]:
            if not isinstance(node.get(p), dict):
                node[p] = {}
            node = node[p]
        node[parts[-1]] = value

    for path in managed + defaults:
        parts = path.split(".")
        value, known = get(data, parts)
        _, there = get(out, parts)
        if known and (path in managed or not there):
            put(parts, value)
        elif not known and path in managed and there:
            parent, _ = get(out, parts[:-1])
            parent.pop(parts[-1])
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def settings_udf(data: dict, managed: list[str], defaults: list[str]):
    """K10 over a column of JSON texts."""

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda s: merge_settings(s or "", data, managed, defaults))

    return F.pandas_udf(run, "string")
