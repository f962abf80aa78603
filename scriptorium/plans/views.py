"""The engine's input tables, derived from the driver's tables: a corpus of files, snapshots of it, a document graph and a journal.

Snapshots, metadata and edges are made up from ids by the rules below, the same
in SQL (see SQL_VIEWS); texts are the documents' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, kind, language, content): a file for each document; the extension follows from the id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.element_at(F.array(F.lit(".md"), F.lit(".go"), F.lit(".yaml")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content")).select("doc_id", "path", text.file_kind("path")["kind"].alias("kind"), "language", "content")


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots (doc_id, path, hash, size, chunks): the later one lost, gained and changed files."""
    c = corpus(spark, sf_dir).select("doc_id", "path", text.content_hash("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("chunks"))
    old = c.where("doc_id % 11 <> 0")
    new = c.where("doc_id % 13 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))
    return old, new


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents with metadata, and links: each document relates to the one of half its id."""
    c = corpus(spark, sf_dir)
    d = F.col("doc_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    docs = c.select(
        "doc_id", "path", F.concat(F.lit("D-"), F.when(d % 50 == 7, d - 1).otherwise(d).cast("string")).alias("id"), F.substring_index("content", "\n", 1).alias("title"),
        pick(("requirements", "decisions", "handbook", "templates"), d % 4).alias("collection"), pick(("draft", "accepted", "superseded", "proposed", "retired"), d % 5).alias("status"),
        F.when(d % 9 == 0, "2024-13-01").otherwise("2024-05-06").alias("date"), F.array(F.concat(F.lit("D-"), F.floor(d / 2).cast("string")), F.concat(F.lit("D-"), (d * 3).cast("string"))).alias("related"),
        F.when((d % 4 == 1) & (d % 5 == 2), F.concat(F.lit("D-"), (d + 20).cast("string"))).when((d % 4 == 1) & (d % 5 == 1) & (d % 3 == 0), F.concat(F.lit("D-"), (d + 40).cast("string"))).otherwise("").alias("superseded_by"),
        (d % 100).cast("int").alias("sidebar_position"),
    )
    links = c.select("path", F.concat(F.when(d % 6 == 0, "gone").otherwise(F.concat(F.lit("src"), ((d + 1) % 20).cast("string"))), F.lit("/"), (d + 1).cast("string"), F.element_at(F.array(F.lit(".md"), F.lit(".go"), F.lit(".yaml")), ((d + 1) % 3 + 1).cast("int"))).alias("link_path"), (d % 17 + 1).cast("int").alias("line"))
    return docs, links


def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, at, event): an entry for each user; the event follows from the type's first letters."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.array(*[F.lit(k) for k in ("new", "note", "done", "abandoned", "keep")])
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("ts").alias("at"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("event"))


SQL_VIEWS = {
    "corpus": """corpus AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.go' ELSE '.yaml' END AS path,
 CASE doc_id % 3 WHEN 0 THEN 'documentation' WHEN 1 THEN 'code' ELSE 'config' END AS kind, lang AS language, text AS content FROM documents)""",
    "lines": """lines AS (SELECT path, kind, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM
 (SELECT path, kind, string_split(CASE WHEN right(content, 1) = chr(10) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS l FROM corpus WHERE content <> ''))""",
    "old": """old AS (SELECT doc_id, path, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size FROM corpus WHERE doc_id % 11 <> 0)""",
    "new": """new AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN sha256(sha256(content) || 'x') ELSE sha256(content) END AS hash, CAST(strlen(content) AS BIGINT) AS size FROM corpus WHERE doc_id % 13 <> 0)""",
    "graph": """docs AS (SELECT doc_id, path, 'D-' || CAST(CASE WHEN doc_id % 50 = 7 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS id,
 CASE doc_id % 4 WHEN 0 THEN 'requirements' WHEN 1 THEN 'decisions' WHEN 2 THEN 'handbook' ELSE 'templates' END AS collection,
 CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'accepted' WHEN 2 THEN 'superseded' WHEN 3 THEN 'proposed' ELSE 'retired' END AS status,
 CASE WHEN doc_id % 9 = 0 THEN '2024-13-01' ELSE '2024-05-06' END AS date, string_split(content, chr(10))[1] AS title,
 'D-' || CAST(doc_id // 2 AS VARCHAR) AS related1, 'D-' || CAST(doc_id * 3 AS VARCHAR) AS related2,
 CASE WHEN doc_id % 4 = 1 AND doc_id % 5 = 2 THEN 'D-' || CAST(doc_id + 20 AS VARCHAR) WHEN doc_id % 4 = 1 AND doc_id % 5 = 1 AND doc_id % 3 = 0 THEN 'D-' || CAST(doc_id + 40 AS VARCHAR) ELSE '' END AS superseded_by,
 CAST(doc_id % 100 AS INTEGER) AS sidebar_position FROM corpus),
 links AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'gone' ELSE 'src' || CAST((doc_id + 1) % 20 AS VARCHAR) END || '/' || CAST(doc_id + 1 AS VARCHAR) || CASE (doc_id + 1) % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.go' ELSE '.yaml' END AS link_path, CAST(doc_id % 17 + 1 AS INTEGER) AS line FROM corpus)""",
    "asked": r"""asked AS (SELECT DISTINCT split_part(path, '/', 1) AS changed FROM corpus WHERE doc_id % 20 = 3 UNION SELECT path FROM corpus WHERE doc_id % 10 = 4 UNION SELECT 'missing/' || path FROM corpus WHERE doc_id % 10 = 6)""",
    "journal": """journal AS (SELECT CAST(user_id AS VARCHAR) AS id, ts AS moment, CASE event_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'note' WHEN 2 THEN 'done' WHEN 3 THEN 'abandoned' ELSE 'keep' END AS event FROM events),
 folded AS (SELECT j.id, s.event AS last_event, s.moment AS last_at, min(j.moment) AS created_at, max(j.moment) AS updated_at, max(CASE WHEN j.event = 'keep' THEN j.moment END) AS keep_at
 FROM journal j LEFT JOIN (SELECT id, event, moment FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment DESC, event DESC) AS r FROM journal WHERE event <> 'keep') WHERE r = 1) s ON s.id = j.id GROUP BY j.id, s.event, s.moment),
 entries AS (SELECT id, CASE WHEN last_event IN ('done', 'abandoned') THEN last_event ELSE 'open' END AS status, created_at, updated_at,
 CASE WHEN last_event IN ('done', 'abandoned') AND (keep_at IS NULL OR keep_at < last_at) THEN last_at + CASE last_event WHEN 'done' THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END END AS expires_at FROM folded)""",
}


def sql(query: str, *views: str) -> str:
    """A query with the views it needs, in order."""
    return "WITH RECURSIVE " + ",\n".join(SQL_VIEWS[v] for v in views) + "\n" + query
