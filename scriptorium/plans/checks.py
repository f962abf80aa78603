"""Queries of the column rules and record checks, each through its operator, and their SQL. They join the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import catalog, journal, locks
from scriptorium.plans.registry import query, stop_list
from scriptorium.plans.views import corpus, graph, sql

#: Odd cases are written into the corpus by the id, the same in SQL.
_NAMES = (".env", ".env.local", "id_rsa", "id_ed25519.pub", "server.PEM", "key.txt", "x.pfx", "main.go", "id_notes.md")
_PATHS = ("a/b.md", "/abs", "a//b", "a/../b", "./a", "a\\b", "c:d", "", "ok")


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query(sql("SELECT path, length(left(content, list_max(list_filter(range(0, 102), lambda k: strlen(left(content, k)) <= 101)))) AS chars, sha256(left(content, list_max(list_filter(range(0, 102), lambda k: strlen(left(content, k)) <= 101)))) AS hash FROM corpus", "corpus"))
def utf8_prefixes(spark, sf_dir):
    """The longest prefix of 101 bytes of every file."""
    c = corpus(spark, sf_dir).select("path", text.utf8_prefix("content", 101).alias("p"))
    return c.select("path", F.length("p").cast("bigint").alias("chars"), F.sha2("p", 256).alias("hash"))


@query(f"""SELECT doc_id, CASE WHEN len(list_filter(t, lambda x: NOT regexp_full_match(x, '[a-z0-9][a-z0-9-]{{0,31}}'))) = 0 AND len(list_distinct(t)) = len(t) THEN array_to_string(t, ',') END AS tags
 FROM (SELECT doc_id, [lower(trim(' ' || lang)), lower(source), CASE doc_id % 3 WHEN 0 THEN lower(lang) WHEN 1 THEN 'b c' ELSE 'x-1' END] AS t FROM documents)""")  # fmt: skip
def tag_lists(spark, sf_dir):
    """Language, source, and a third tag that repeats or is malformed in some."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    third = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, "b c").otherwise("X-1")
    return d.select("doc_id", F.array_join(text.normalize_tags(F.array(F.concat(F.lit(" "), "lang"), "source", third)), ",").alias("tags"))


@query(f"SELECT doc_id, {_list(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS name, regexp_matches(lower({_list(_NAMES)}[doc_id % {len(_NAMES)} + 1]), '^\\.env(\\..*)?$|^id_(rsa|dsa|ecdsa|ed25519)|\\.(pem|key|p12|pfx)$') AS sensitive FROM documents")
def sensitive_files(spark, sf_dir):
    """F12."""
    name = _pick(_NAMES, F.col("doc_id"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", name.alias("name"), text.sensitive_name(F.concat(F.lit("a/"), name)).alias("sensitive"))


@query(f"""SELECT doc_id, p <> '' AND NOT regexp_matches(p, '[\\\\:]') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS portable FROM
 (SELECT doc_id, {_list(_PATHS)}[doc_id % {len(_PATHS)} + 1] AS p FROM documents)""")  # fmt: skip
def portable_paths(spark, sf_dir):
    """F17."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.portable_path(_pick(_PATHS, F.col("doc_id"))).alias("portable"))


_HEAD = "CASE doc_id % 3 WHEN 0 THEN '// Code generated by x. DO NOT EDIT.' || chr(10) || 'package a' || chr(10) WHEN 1 THEN 'package a' || chr(10) || '// Code generated by x. DO NOT EDIT.' || chr(10) ELSE '' END"


@query(sql(f"SELECT path, doc_id % 3 = 0 OR regexp_matches(split_part(chr(10) || {_HEAD} || content, chr(10) || 'package ', 1), '(^|\\n)// Code generated [^\\n]* DO NOT EDIT\\.(\\n|$)') AS generated FROM corpus", "corpus"))
def generated_sources(spark, sf_dir):
    """The mark before the package clause, after it, and none."""
    mark = "// Code generated by x. DO NOT EDIT.\n"
    head = F.when(F.col("doc_id") % 3 == 0, mark + "package a\n").when(F.col("doc_id") % 3 == 1, "package a\n" + mark).otherwise("")
    return corpus(spark, sf_dir).select("path", text.generated_go(F.concat(head, "content")).alias("generated"))


_ID = "CASE doc_id % 4 WHEN 0 THEN '20240105-' || lang || '-00af' WHEN 1 THEN '20240105-x' WHEN 2 THEN '20240105-' || upper(lang) || '-00af' ELSE '20240105-' || repeat('a', 60) || '-00af' END"


@query(f"""SELECT doc_id, regexp_full_match(i, '[0-9]{{8}}-[a-z0-9][a-z0-9-]*-[0-9a-f]{{4}}') AND length(i) <= 64 AS id_ok, length(trim(t)) BETWEEN 1 AND 200 AS title_ok FROM
 (SELECT doc_id, {_ID} AS i, CASE WHEN doc_id % 3 = 0 THEN repeat('t', CAST(doc_id % 400 AS INTEGER)) ELSE lang END AS t FROM documents)""")  # fmt: skip
def valid_records(spark, sf_dir):
    """ids and titles, some too long, empty or in upper case."""
    d, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    day = F.lit("20240105-")
    i = F.when(n % 4 == 0, F.concat(day, "lang", F.lit("-00af"))).when(n % 4 == 1, "20240105-x").when(n % 4 == 2, F.concat(day, F.upper("lang"), F.lit("-00af"))).otherwise(F.concat(day, F.lit("a" * 60 + "-00af")))
    title = F.when(n % 3 == 0, F.repeat(F.lit("t"), (n % 400).cast("int"))).otherwise(F.col("lang"))
    return d.select("doc_id", text.valid_id(i).alias("id_ok"), text.valid_title(title).alias("title_ok"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS ref FROM orders")
def merged_refs(spark, sf_dir):
    """A third of the updates are empty."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", text.merge_refs(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))).alias("ref"))


@query("SELECT id, CASE WHEN in_lock IS NULL THEN 'not_locked' ELSE 'not_declared' END AS problem FROM (SELECT o_orderkey AS id, true AS in_manifest FROM orders WHERE o_orderkey % 7 <> 0) FULL JOIN (SELECT o_orderkey AS id, true AS in_lock FROM orders WHERE o_orderkey % 5 <> 0) USING (id) WHERE in_manifest IS NULL OR in_lock IS NULL")
def lock_matches(spark, sf_dir):
    """The dependencies of a manifest and of a lock, each without some orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return locks.matches(o.where("id % 7 <> 0"), o.where("id % 5 <> 0"))


@query(sql("""SELECT path, CASE WHEN owned IS NULL THEN 'unowned_target' ELSE 'locally_modified' END AS conflict FROM (SELECT path, CASE WHEN doc_id % 9 <> 0 THEN h END AS live,
 CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'o' ELSE h END AS owned, CASE WHEN doc_id % 5 = 0 THEN h ELSE 'n' END AS incoming FROM (SELECT doc_id, path, sha256(content) AS h FROM corpus))
 WHERE live IS NOT NULL AND live <> incoming AND (owned IS NULL OR live <> owned)""", "corpus"))  # fmt: skip
def lock_conflicts(spark, sf_dir):
    """targets changed by hand or owned by nobody."""
    n, h = F.col("doc_id"), text.content_hash("content")
    plan = corpus(spark, sf_dir).select("path", F.when(n % 9 != 0, h).alias("live"), F.when(n % 4 == 0, None).when(n % 4 == 1, "o").otherwise(h).alias("owned"), F.when(n % 5 == 0, h).otherwise("n").alias("incoming"))
    return locks.conflicts(plan).select("path", "conflict")


@query(sql("SELECT kind, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes, count(*) <= 10000 AND sum(strlen(content)) <= 268435456 AS fits FROM corpus GROUP BY kind", "corpus"))
def tree_limits(spark, sf_dir):
    """S19 for the files of each kind."""
    c = corpus(spark, sf_dir).select("kind", F.octet_length("content").cast("bigint").alias("size"))
    out = None
    for kind in ("documentation", "code", "config"):
        one = locks.validate_tree(c.where(F.col("kind") == kind)).select(F.lit(kind).alias("kind"), "files", F.col("bytes").cast("bigint").alias("bytes"), "fits").where("files > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT doc_id, array_to_string(CASE WHEN len(w) > 10 THEN list_concat(w[1:10], ['and ' || CAST(len(w) - 10 AS VARCHAR) || ' more']) ELSE w END, '|') AS evidence
 FROM (SELECT doc_id, list_transform(range(0, doc_id % 25), lambda i: 'line ' || CAST(i AS VARCHAR)) AS w FROM documents)""")  # fmt: skip
def bounded_evidence(spark, sf_dir):
    """Up to 24 pieces of evidence a document."""
    d, n = spark.read.parquet(f"{sf_dir}/documents.parquet"), (F.col("doc_id") % 25).cast("int")
    all_of = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("line "), (i - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.array_join(journal.limit_evidence(all_of), "|").alias("evidence"))


@query(sql(r"SELECT path, CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(content || repeat('`', CAST(doc_id % 6 AS INTEGER)), '`+'), lambda x: length(x))), 0) + 1) AS INTEGER) AS ticks FROM corpus", "corpus"))
def fence_sizes(spark, sf_dir):
    """A fence longer than any run of backticks."""
    c = corpus(spark, sf_dir)
    body = F.concat("content", F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")))
    return c.select("path", F.length(text.fence_for(body)).cast("int").alias("ticks"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(p, ''), lambda c: CASE WHEN contains('*?[]\!# ', c) AND c <> '' THEN '\' || c ELSE c END), '') AS pattern FROM (SELECT doc_id, source || '/a b*[' || CAST(doc_id AS VARCHAR) || ']!#?' AS p FROM documents)")
def ignore_patterns(spark, sf_dir):
    """Paths as ignore-file patterns."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.escape_glob(F.concat("source", F.lit("/a b*["), F.col("doc_id").cast("string"), F.lit("]!#?"))).alias("pattern"))


_TERMS = r"(SELECT path, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT path, regexp_extract_all(lower(content), '[\p{L}\p{Nd}_]+') AS w FROM corpus))"


@query(sql(f"""SELECT path, coalesce(terms, '') AS terms FROM corpus LEFT JOIN (SELECT path, string_agg(term, ' ' ORDER BY pos) AS terms FROM
 (SELECT path, term, pos, row_number() OVER (PARTITION BY path ORDER BY pos) AS r FROM (SELECT path, term, min(pos) AS pos FROM {_TERMS} WHERE term NOT IN ({stop_list()}) GROUP BY path, term)) WHERE r <= 32 GROUP BY path) USING (path)""", "corpus"))  # fmt: skip
def query_terms(spark, sf_dir):
    """The first 32 distinct terms of every file, taken as a question."""
    return corpus(spark, sf_dir).select("path", F.array_join(text.query_terms("content"), " ").alias("terms"))


@query(sql("SELECT DISTINCT path, code FROM (SELECT path, 'related' AS code FROM docs UNION ALL SELECT path, 'link' FROM links UNION ALL SELECT path, 'link' FROM links)", "corpus", "graph"))
def diagnostics_once(spark, sf_dir):
    """Each finding once, however many checks report it."""
    docs, links = graph(spark, sf_dir)
    found = docs.select("path", F.lit("related").alias("code")).unionByName(links.select("path", F.lit("link").alias("code"))).unionByName(links.select("path", F.lit("link").alias("code")))
    return catalog.first_diagnostics(found)
