"""Journal records on disk: entries as JSON files, events as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = """version int, id string, title string, status string, tags array<string>, created_at timestamp, updated_at timestamp, expires_at timestamp,
 runtime string, session string, refs struct<branch:string,commit:string,pr:string,issue:string>"""
ENTRY_FIELDS = [
    "version: int", "id: string", "title: string", "status: string", "tags: array<string>", "created_at: timestamp", "updated_at: timestamp", "expires_at: timestamp", "runtime: string", "session: string",
    "refs: struct<branch:string,commit:string,pr:string,issue:string>",
]
EVENT = "at timestamp, event string, runtime string, session string, summary string"
STANDARD = ("journal", "index", "backups", "cache", "tmp")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every entry record, by (updated_at desc, id); `problem` is null for a valid one (D3)."""
    raw = spark.read.schema(f"{ENTRY}, _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/*/entry.json")
    found = raw.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    problem = (
        F.when(F.col("_bad").isNotNull(), "not valid JSON")
        .when(F.col("id").isNull() | (F.col("id") != F.col("folder")), "id differs from the folder")
        .when(~F.col("status").isin("open", "done", "abandoned") | F.col("status").isNull(), "unknown status")
        .when(F.col("created_at").isNull() | F.col("updated_at").isNull(), "a time is missing")
    )
    return found.withColumn("problem", problem).drop("_bad").orderBy(F.desc("updated_at"), F.asc("id"))


def events(spark: SparkSession, root: str) -> DataFrame:
    """All events, of logs that are files of lines and of those that are folders; blank and unparsable lines are skipped."""
    raw = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(f"{root}/*/log*")
    return raw.withColumn("id", F.regexp_extract(F.input_file_name(), r"([^/]+)/log(?:\.jsonl)?(?:/[^/]+)?$", 1)).where("at is not null")


def folded(spark: SparkSession, root: str) -> DataFrame:
    """Each entry's record after the last change of its log, with the number of changes; entries without such a log as recorded."""
    logs = spark.read.schema(f"version int, entry struct<{', '.join(ENTRY_FIELDS)}>").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*.json").json(root)
    own = F.input_file_name().rlike(r"/log/\d{8}\.json$") & F.col("entry").isNotNull()
    last = logs.where(own).groupBy("entry.id").agg(F.max_by("entry", "version").alias("entry"), F.max("version").alias("log_version"))
    names = [f.split(":")[0].split()[0] for f in ENTRY_FIELDS]
    told = last.select(*[F.col(f"entry.{n}").alias(n) for n in names], "log_version")
    only = entries(spark, root).where("problem is null").join(told.select("id"), "id", "left_anti")
    return told.unionByName(only.select(*names, F.lit(0).alias("log_version")))


def notes(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.text(f"{root}/*/notes.md", wholetext=True)
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("id"), F.col("value").alias("notes"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, size) of every file of every entry."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    rest = F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.length(base) + 2, F.lit(1 << 20))
    return raw.select(F.substring_index(rest, "/", 1).alias("id"), F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 2, F.lit(1 << 20)).alias("path"), "size").where("path <> ''")


def append_events(df: DataFrame, root: str, entry: str) -> None:
    """K4: each append is a file of its own, so no torn line can arise."""
    df.select("at", "event", "runtime", "session", "summary").coalesce(1).write.mode("append").json(f"{root}/{entry}/log.jsonl")


def write_index(index: DataFrame, path: str) -> None:
    """K3."""
    index.coalesce(1).write.mode("overwrite").json(path)


def ci_event(events_df: DataFrame) -> DataFrame:
    """S24 over (payload, file_payload): the inline payload first, then the file's; the comment or review body and the number."""
    schema = "action string, comment struct<body:string>, review struct<body:string>, issue struct<number:int,title:string>, pull_request struct<number:int,title:string>"
    parsed = events_df.withColumn("e", F.coalesce(F.from_json(F.nullif("payload", F.lit("")), schema), F.from_json("file_payload", schema)))
    return parsed.select(
        F.col("e.action").alias("action"), F.coalesce(F.nullif("e.comment.body", F.lit("")), F.nullif("e.review.body", F.lit(""))).alias("body"),
        F.coalesce("e.issue.number", "e.pull_request.number").alias("number"), F.coalesce("e.issue.title", "e.pull_request.title").alias("title"),
    )
