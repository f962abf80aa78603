"""Skills and rendered instructions: metadata, ownership of written files, heading rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of a skill's metadata, and names that interrupted writes leave behind.
NAME, MAX_NAME, MAX_DESCRIPTION = r"^[a-z0-9]+(-[a-z0-9]+)*$", 64, 1024
LEFTOVER = r"^\.trash-|^(?=\.).*\.tmp-"


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it stands there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def front_matter(content: Column) -> Column:
    """struct(opened, closed, name, description) of a SKILL.md; plain and quoted one-line values. Null name or description: not set."""
    text = _let(content, lambda c: F.replace(F.when(F.startswith(c, F.lit("\ufeff")), F.substring(c, F.lit(2), F.length(c))).otherwise(c), F.lit("\r\n"), F.lit("\n")))
    plain = lambda v: F.when(v.rlike('^".*"$|^\'.*\'$'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(F.regexp_replace(v, r"[ \t]+#.*$", ""))
    found = lambda body, key: _let(_let(F.regexp_extract(body, rf"(?m)^{key}:[ \t]*(.*?)[ \t]*$", 1), plain), lambda v: F.nullif(v, F.lit("")))
    body = lambda lines, end: F.array_join(F.slice(lines, F.lit(2), F.greatest(end.cast("int") - 1, F.lit(0))), "\n")
    some = lambda closed, b: F.struct(F.when(closed, found(b, "name")).alias("name"), F.when(closed, found(b, "description")).alias("description"))

    def read(lines: Column, mark: Column) -> Column:
        opened = F.coalesce(F.get(mark, 0), F.lit(False))
        end = F.array_position(F.slice(mark, F.lit(2), F.greatest(F.size(mark) - 1, F.lit(0))), True)
        return _let(F.struct(opened.alias("opened"), (opened & (end > 0)).alias("closed"), end.alias("end")), lambda s: _let(some_of(s, lines), lambda m: F.struct(s["opened"].alias("opened"), s["closed"].alias("closed"), m["name"].alias("name"), m["description"].alias("description"))))

    some_of = lambda s, lines: _let(body(lines, s["end"]), lambda b: some(s["closed"], b))
    return _let(F.split(text, "\n"), lambda lines: _let(F.transform(lines, lambda x: F.rtrim(x, F.lit(" \t")) == "---"), lambda mark: read(lines, mark)))


def metadata_problem(meta: Column, folder: Column) -> Column:
    """the first rule that the metadata of a skill in this folder breaks, or null."""
    name, text = meta["name"], meta["description"]
    return (
        F.when(~meta["opened"], "front matter must come first").when(~meta["closed"], "front matter is not closed").when(name.isNull(), "name is missing")
        .when((F.octet_length(name) > MAX_NAME) | ~name.rlike(NAME), "name is malformed").when(name != folder, "name differs from the folder")
        .when(text.isNull() | (F.trim(text) == ""), "description is missing").when(F.char_length(text) > MAX_DESCRIPTION, "description is too long")
    )


def leftover(name: Column) -> Column:
    """F13."""
    return name.rlike(LEFTOVER)


def ownership(skills: DataFrame, manifest: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """(target, path, action) for skills (target, name, rel) to write, a manifest (target, path) of what was written before, and what is there: folders (target, name) and files (target, path).

    A skill whose folder is there though no file of it was ours is refused:
    `unowned`, with the folder as path, and nothing else of it. Others are
    written; files that were ours, are no longer wanted and are still there
    are removed.
    """
    wanted = skills.select("target", "name", F.concat_ws("/", "name", "rel").alias("path")).distinct()
    ours = manifest.select("target", F.substring_index("path", "/", 1).alias("name")).distinct()
    unowned = wanted.select("target", "name").distinct().join(folders.select("target", "name").distinct(), ["target", "name"]).join(ours, ["target", "name"], "left_anti")
    write = wanted.join(unowned, ["target", "name"], "left_anti").select("target", "path", F.lit("write").alias("action"))
    old = manifest.select("target", "path").distinct().join(wanted, ["target", "path"], "left_anti").join(files.select("target", "path"), ["target", "path"], "left_semi")
    return write.unionByName(old.withColumn("action", F.lit("remove"))).unionByName(unowned.select("target", F.col("name").alias("path"), F.lit("unowned").alias("action")))


def heading_problems(headings: DataFrame) -> DataFrame:
    """(doc, pos, problem): the first broken rule of each document's headings (doc, pos, level, chunk).

    chunk is 0 in the main template. One title; no level is skipped; a chunk's
    headings lie below the main heading before it, its first one just below. A
    document without a title has that problem, at no place, if nothing else
    comes first. Documents without headings have no rows here.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    main = F.col("chunk") == 0
    rows = headings.select("doc", "pos", "level", "chunk", F.count_if(F.col("level") == 1).over(upto).alias("titles"), F.coalesce(F.lag("level").over(w), F.lit(0)).alias("before"), F.coalesce(F.last(F.when(main, F.col("level")), ignorenulls=True).over(upto), F.lit(0)).alias("section"), F.count_if(main).over(upto).alias("part"))
    first = F.row_number().over(Window.partitionBy("doc", "part", "chunk").orderBy("pos")) == 1
    rows = rows.withColumn("first", first)
    base = F.col("section") + 1
    problem = (
        F.when((F.col("level") == 1) & (F.col("titles") > 1), "second title").when(~main & (F.col("section") == 0), "no section").when(~main & F.col("first") & (F.col("level") != base), "first level")
        .when(~main & (F.col("level") < base), "escapes section").when(F.col("level") > F.col("before") + 1, "level skipped")
    )
    found = rows.withColumn("problem", problem).groupBy("doc").agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("pos", "problem"))).alias("p"), F.max("titles").alias("titles"))
    none = F.struct(F.lit(None).cast(headings.schema["pos"].dataType).alias("pos"), F.lit("no title").alias("problem"))
    return found.select("doc", F.coalesce("p", F.when(F.col("titles") == 0, none)).alias("p")).where("p is not null").select("doc", "p.pos", "p.problem")
