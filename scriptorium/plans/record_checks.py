"""Queries of skills, headings, locks and impact reports, and their SQL. They join the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import paths, text
from scriptorium.operators import catalog, chunks, journal, locks, skills
from scriptorium.plans.registry import _DIRECT, _EDGES, _asked, query
from scriptorium.plans.views import corpus, graph, sql
from scriptorium.sources import tree


@query(sql(""", headings AS (SELECT path AS doc, CAST(line_no AS INTEGER) AS pos, CASE WHEN line_no = 1 AND length(line) % 9 > 0 THEN 1 ELSE length(line) % 3 + 2 END AS level, CASE WHEN line_no = 1 THEN 0 ELSE length(line) // 11 % 3 END AS chunk FROM lines),
 rows AS (SELECT *, count(*) FILTER (level = 1) OVER u AS titles, coalesce(lag(level) OVER (PARTITION BY doc ORDER BY pos), 0) AS before, coalesce(last_value(CASE WHEN chunk = 0 THEN level END IGNORE NULLS) OVER u, 0) AS section, count(*) FILTER (chunk = 0) OVER u AS part
 FROM headings WINDOW u AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY doc, part, chunk ORDER BY pos) AS nth FROM rows),
 judged AS (SELECT doc, pos, titles, CASE WHEN level = 1 AND titles > 1 THEN 'second title' WHEN chunk > 0 AND section = 0 THEN 'no section' WHEN chunk > 0 AND nth = 1 AND level <> section + 1 THEN 'first level' WHEN chunk > 0 AND level < section + 1 THEN 'escapes section' WHEN level > before + 1 THEN 'level skipped' END AS problem FROM numbered)
 SELECT doc AS path, min(pos) FILTER (problem IS NOT NULL) AS pos, coalesce(arg_min(problem, pos) FILTER (problem IS NOT NULL), 'no title') AS problem FROM judged GROUP BY doc HAVING count(problem) > 0 OR max(titles) = 0""", "corpus", "lines"))  # fmt: skip
def heading_problems(spark, sf_dir):
    """Every line is a heading, of a level and a chunk that follow from its length."""
    size, top = F.length("line"), F.col("line_no") == 1
    level = F.when(top & (size % 9 > 0), 1).otherwise(size % 3 + 2)
    rows = chunks.lines(corpus(spark, sf_dir)).select(F.col("path").alias("doc"), F.col("line_no").alias("pos"), level.alias("level"), F.when(top, 0).otherwise(F.floor(size / 11) % 3).alias("chunk"))
    return skills.heading_problems(rows).select(F.col("doc").alias("path"), F.col("pos").cast("int").alias("pos"), "problem")


_SKILL = """CASE doc_id % 8 WHEN 6 THEN 'x' ELSE '' END || '---' || CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE '' END || chr(10) || CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'name: ' || CASE doc_id % 3 WHEN 0 THEN '"' || folder || '"' WHEN 1 THEN folder || '  # own' ELSE upper(folder) END || chr(10) END
 || 'description: ' || CASE WHEN doc_id % 7 = 3 THEN '' ELSE left(replace(text, chr(10), ' '), 1100) END || chr(10) || CASE WHEN doc_id % 11 = 5 THEN '' ELSE '---' || chr(10) END || text"""


@query(rf"""WITH given AS (SELECT doc_id, folder, {_SKILL} AS content FROM (SELECT doc_id, lang || '-' || CAST(doc_id % 10 AS VARCHAR) AS folder, replace(replace(replace(coalesce(text, ''), '#', ''), '"', ''), '---', '') AS text FROM documents)),
 parts AS (SELECT *, regexp_matches(content, '^---[ \t]*(\n|$)') AS opened, regexp_extract(content, '^---[ \t]*\n((?:.*\n)*?)---[ \t]*(?:\n|$)', 1) AS body, regexp_matches(content, '^---[ \t]*\n(?:.*\n)*?---[ \t]*(?:\n|$)') AS closed FROM given),
 raw AS (SELECT *, regexp_extract(body, '(?m)^name:[ \t]*(.*?)[ \t]*$', 1) AS n, regexp_extract(body, '(?m)^description:[ \t]*(.*?)[ \t]*$', 1) AS d FROM parts),
 meta AS (SELECT *, CASE WHEN n LIKE '"%"' THEN substr(n, 2, length(n) - 2) ELSE regexp_replace(n, '[ \t]+#.*$', '') END AS name FROM raw)
 SELECT doc_id, CASE WHEN NOT opened THEN 'front matter must come first' WHEN NOT closed THEN 'front matter is not closed' WHEN name = '' THEN 'name is missing' WHEN strlen(name) > 64 OR NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'name is malformed'
 WHEN name <> folder THEN 'name differs from the folder' WHEN trim(d) = '' THEN 'description is missing' WHEN length(d) > 1024 THEN 'description is too long' END AS problem FROM meta""")  # fmt: skip
def skill_metadata(spark, sf_dir):
    """Front matter before every text; some is not opened, not closed, or lacks a name or a description."""
    n = F.col("doc_id")
    clean = F.coalesce("text", F.lit(""))
    for mark in ("#", '"', "---"):
        clean = F.replace(clean, F.lit(mark), F.lit(""))
    folder = F.concat_ws("-", "lang", (n % 10).cast("string"))
    named = F.when(n % 3 == 0, F.concat(F.lit('"'), folder, F.lit('"'))).when(n % 3 == 1, F.concat(folder, F.lit("  # own"))).otherwise(F.upper(folder))
    pick = lambda cond, then, other="": F.when(cond, then).otherwise(F.lit(other) if isinstance(other, str) else other)
    content = F.concat(
        pick(n % 8 == 6, "x"), F.lit("---"), pick(n % 2 == 0, "  "), F.lit("\n"), pick(n % 5 == 4, "", F.concat(F.lit("name: "), named, F.lit("\n"))), F.lit("description: "),
        pick(n % 7 == 3, "", F.substring(F.replace("clean", F.lit("\n"), F.lit(" ")), 1, 1100)), F.lit("\n"), pick(n % 11 == 5, "", "---\n"), "clean",
    )
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("clean", clean)
    return d.withColumn("meta", skills.front_matter(content)).select("doc_id", skills.metadata_problem(F.col("meta"), folder).alias("problem"))


@query("""WITH d AS (SELECT source AS target, 's' || CAST(doc_id % 23 AS VARCHAR) AS name, doc_id FROM documents),
 wanted AS (SELECT target, name, name || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path FROM d WHERE doc_id % 4 <> 1), manifest AS (SELECT target, name || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path, name FROM d WHERE doc_id % 3 = 0 AND doc_id % 23 <> 7),
 unowned AS (SELECT DISTINCT target, name FROM wanted w WHERE EXISTS (SELECT 1 FROM d WHERE d.target = w.target AND d.name = w.name AND d.doc_id % 5 = 0) AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.target = w.target AND m.name = w.name))
 SELECT DISTINCT target, path, 'write' AS action FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM unowned u WHERE u.target = w.target AND u.name = w.name)
 UNION ALL SELECT target, path, 'remove' FROM manifest m WHERE (target, path) NOT IN (SELECT target, path FROM wanted) AND (target, path) IN (SELECT target, name || '/' || CAST(doc_id AS VARCHAR) || '.md' FROM d WHERE doc_id % 5 < 4) UNION ALL SELECT target, name, 'unowned' FROM unowned""")  # fmt: skip
def skill_ownership(spark, sf_dir):
    """Each source is a target; what is wanted, was written and is there follows from the id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("target"), F.concat(F.lit("s"), (F.col("doc_id") % 23).cast("string")).alias("name"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"))
    path = d.withColumn("path", F.concat_ws("/", "name", "rel"))
    return skills.ownership(d.where("doc_id % 4 <> 1"), path.where("doc_id % 3 = 0 and doc_id % 23 <> 7"), d.where("doc_id % 5 = 0"), path.where("doc_id % 5 < 4"))


@query("""WITH f AS (SELECT o_custkey AS id, 'a/' || CAST(o_orderkey % 4 AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders), m AS (SELECT c_custkey AS id, 'a/' || CAST(c_custkey % 5 AS VARCHAR) AS "to", c_custkey % 2 = 0 AS directory FROM customer UNION ALL SELECT o_custkey, 'a/' || CAST(o_orderkey % 4 AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR), false FROM orders WHERE o_orderkey % 7 = 0)
 SELECT id, path FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.id = f.id AND (f.path = m."to" OR (m.directory AND starts_with(f.path, m."to" || '/'))))""")  # fmt: skip
def lock_uncovered(spark, sf_dir):
    """Locked paths of each customer's orders outside its file and folder mappings."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    path = F.concat(F.lit("a/"), (F.col("o_orderkey") % 4).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    files = o.select(F.col("o_custkey").alias("id"), path.alias("path"), "o_orderkey")
    maps = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("a/"), (F.col("c_custkey") % 5).cast("string")).alias("to"), (F.col("c_custkey") % 2 == 0).alias("directory"))
    return locks.uncovered(files.select("id", "path"), maps.unionByName(files.where("o_orderkey % 7 = 0").select("id", F.col("path").alias("to"), F.lit(False).alias("directory"))))


@query("""WITH r AS (SELECT source, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"hash":"' || sha256(coalesce(text, '')) || '"}') AS h FROM documents), b AS (SELECT source, left(h, 3) AS k, sha256(string_agg(h, '' ORDER BY h)) AS part FROM r GROUP BY source, left(h, 3))
 SELECT source, sha256(string_agg(part, '' ORDER BY k)) AS digest FROM b GROUP BY source""")  # fmt: skip
def manifest_digests(spark, sf_dir):
    """A digest of the documents of each source, whatever their order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return locks.digests(d.select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), "source")


@query(sql("", "corpus", "graph", "asked").strip() + ",\n" + _EDGES + f""", hits AS ({_DIRECT}), zero AS (SELECT DISTINCT path FROM hits),
 hop1 AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM zero) AND dst NOT IN (SELECT path FROM zero)),
 hop2 AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM hop1) AND dst NOT IN (SELECT path FROM zero) AND dst NOT IN (SELECT path FROM hop1)),
 every AS (SELECT path, min(CASE reason WHEN 'changed_document' THEN 0 ELSE 1 END) AS rank, count(DISTINCT changed) AS n, least(count(DISTINCT CASE WHEN line IS NOT NULL THEN CAST(line AS VARCHAR) || ':' || changed END), 10) AS lines FROM hits GROUP BY path
 UNION ALL SELECT path, 2, NULL, NULL FROM (SELECT path FROM hop1 UNION SELECT path FROM hop2))
 SELECT path, CASE rank WHEN 0 THEN 'changed_document' WHEN 1 THEN 'direct_link' ELSE 'related_document' END AS reason, CAST(n AS INTEGER) AS n_changed, CAST(lines AS INTEGER) AS n_lines FROM every ORDER BY rank, path LIMIT 100""")  # fmt: skip
def impact_report(spark, sf_dir):
    """The first hundred affected documents by reason, with the number of changed paths and of link lines kept."""
    docs, links = graph(spark, sf_dir)
    return catalog.impact(docs, links, _asked(spark, sf_dir)).select("path", "reason", F.when(F.col("changed").isNotNull(), F.size("changed")).alias("n_changed"), F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"))


@query("SELECT p_partkey, name, starts_with(name, '.trash-') OR (left(name, 1) = '.' AND contains(name, '.tmp-')) AS leftover FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.entry.json.tmp-' || p_brand WHEN 1 THEN '.trash-' WHEN 2 THEN '.trashed' WHEN 3 THEN 'x.tmp-' WHEN 4 THEN '.tmp-1' ELSE p_name END AS name FROM part)")
def leftover_names(spark, sf_dir):
    """F13."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat(F.lit(".entry.json.tmp-"), "p_brand")).when(k == 1, ".trash-").when(k == 2, ".trashed").when(k == 3, "x.tmp-").when(k == 4, ".tmp-1").otherwise(F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name"), skills.leftover(name).alias("leftover"))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE NOT starts_with(n_name, '.') AND n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 2)")
def stray_names(spark, sf_dir):
    """Names of the tables' nations that the first regions do not allow."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), "n_regionkey")
    return journal.stray(n.select("name"), n.where("n_regionkey < 2")).distinct()


@query("""WITH now AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS updated_at, min(ts) AS created_at FROM events GROUP BY user_id), stored AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS updated_at, min(ts) AS created_at FROM events WHERE event_type <> 'purchase' GROUP BY user_id)
 SELECT id, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM now) UNION ALL SELECT id, 'rendered' FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM stored)""")  # fmt: skip
def index_differences(spark, sf_dir):
    """An index that was stored before the purchases against one of all events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("id"), "ts", "event_type")
    none = F.lit(None)
    made = lambda df: df.groupBy("id").agg(F.max("ts").alias("updated_at"), F.min("ts").alias("created_at")).select(
        "id", F.lit("t").alias("title"), F.lit("open").alias("status"), F.array().cast("array<string>").alias("tags"), "created_at", "updated_at", none.cast("timestamp").alias("expires_at"), F.lit("").alias("runtime")
    )
    return journal.index_differs(journal.index_of(made(e.where("event_type <> 'purchase'"))), made(e)).select("id", "side")


#: Rules of ignore files by folder, and the same as the regular expressions that they stand for.
_IGNORE = {"": "*.go\n!/src1/**/*.go\n/src2/\nsrc3/*/1*.md\n# a comment\n\n1/\n", "src4": "*[05].md\n!/2/?5.md\n", "src5/0": "**\n!*.yaml\n", "src10": "0/**\n"}
_IGNORE_SQL = """(VALUES (1, '', false, false, '(.*/)?[^/]*[.]go'), (2, '', true, false, 'src1/([^/]+/)*[^/]*[.]go'), (3, '', false, true, 'src2'), (4, '', false, false, 'src3/[^/]*/1[^/]*[.]md'), (5, '', false, true, '(.*/)?1'),
 (6, 'src4', false, false, '(.*/)?[^/]*[05][.]md'), (7, 'src4', true, false, '2/[^/]5[.]md'), (8, 'src5/0', false, false, '(.*/)?.*'), (9, 'src5/0', true, false, '(.*/)?[^/]*[.]yaml'), (10, 'src10', false, false, '0/([^/]+/)*[^/]*'))"""


@query(sql(f""", files AS (SELECT split_part(path, '/', 1) || '/' || CAST(doc_id % 4 AS VARCHAR) || '/' || split_part(path, '/', 2) AS path FROM corpus),
 parts AS (SELECT path, split_part(path, '/', 1) AS p, true AS dir FROM files UNION ALL SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), true FROM files UNION ALL SELECT path, path, false FROM files),
 hits AS (SELECT path, p, arg_max(negated, n) AS kept FROM parts JOIN {_IGNORE_SQL} r(n, domain, negated, only_dirs, rx) ON (domain = '' OR starts_with(p, domain || '/')) AND (dir OR NOT only_dirs) AND regexp_full_match(substr(p, CASE WHEN domain = '' THEN 1 ELSE length(domain) + 2 END), rx) GROUP BY path, p)
 SELECT path FROM files WHERE path NOT IN (SELECT path FROM hits WHERE NOT kept)""", "corpus"))  # fmt: skip
def ignored_files(spark, sf_dir):
    """What ignore files of several folders leave of the corpus; rules that negate, name folders, or stand above."""
    rules = paths.IgnoreRules()
    for folder, body in _IGNORE.items():
        rules.add(folder, body)
    part = F.split("path", "/")
    files = corpus(spark, sf_dir).select(F.concat_ws("/", part[0], (F.col("doc_id") % 4).cast("string"), part[1]).alias("path"))
    return tree.without_ignored(files, rules)


_KIND = "['git', 'http', 'npm', 'confluence', 'ftp'][ascii(substr(h, 1, 1)) % 5 + 1]"
_FIELD = "CASE WHEN substr(h, {k}, 1) < '8' THEN {v} ELSE '' END"


@query(
    "WITH d AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), s AS (SELECT doc_id AS id, " + _KIND + " AS type, " + ", ".join(f"{_FIELD.format(k=k, v=v)} AS {c}" for k, c, v in ((2, "url", "'https://e.org/x'"), (3, "ref", "'main'"), (4, "sha256", "CASE WHEN substr(h, 9, 1) < '8' THEN h ELSE upper(h) END"), (5, "package", "'p'"), (6, "version", "'1.0.0'"), (7, "page", "'7'"))) + """ FROM d),
 f AS (SELECT id, type, unnest(['url', 'ref', 'sha256', 'package', 'version', 'page']) AS name, unnest([url, ref, sha256, package, version, page]) AS value FROM s),
 allowed AS (SELECT * FROM (VALUES ('git', 'url', true), ('git', 'ref', true), ('http', 'url', true), ('http', 'sha256', false), ('npm', 'package', true), ('npm', 'version', true), ('confluence', 'url', true), ('confluence', 'page', true)) a(type, name, needed))
 SELECT id, 'unknown type' AS problem FROM s WHERE type NOT IN (SELECT type FROM allowed) UNION ALL SELECT id, name || ' does not belong to ' || f.type FROM f WHERE value <> '' AND f.type IN (SELECT type FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.type = f.type AND a.name = f.name)
 UNION ALL SELECT id, f.name || ' is required for ' || f.type FROM f JOIN allowed a ON a.type = f.type AND a.name = f.name AND a.needed WHERE value = '' UNION ALL SELECT id, 'sha256 must be 64 lower-case hex digits' FROM s WHERE sha256 <> '' AND NOT regexp_full_match(sha256, '[0-9a-f]{64}')"""
)
def source_rules(spark, sf_dir):
    """sources whose type and fields follow from a hash of the id, so that every rule is broken in many ways."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    kinds = F.array(*map(F.lit, ("git", "http", "npm", "confluence", "ftp")))
    some = lambda k, v: F.when(F.substring("h", k, 1) < "8", v).otherwise("")
    sha = F.when(F.substring("h", 9, 1) < "8", F.col("h")).otherwise(F.upper("h"))
    fields = [some(k, v).alias(c) for k, c, v in ((2, "url", "https://e.org/x"), (3, "ref", "main"), (4, "sha256", sha), (5, "package", "p"), (6, "version", "1.0.0"), (7, "page", "7"))]
    return locks.source_problems(d.select("id", F.get(kinds, F.ascii(F.substring("h", 1, 1)) % 5).alias("type"), *fields))


@query("WITH d AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents), s AS (SELECT doc_id, " + ", ".join(f"CASE WHEN substr(h, {k}, 1) < '{t}' THEN {v} ELSE '' END AS {c}" for k, c, t, v in ((2, "revision", "3", "ltrim(regexp_replace(substr(h, 20, 3), '[a-f]', '', 'g') || '7', 'x')"), (3, "commit", "5", "substr(h, 1, CASE WHEN substr(h, 12, 1) < '4' THEN 39 ELSE 40 END)"), (4, "url", "5", "CASE WHEN substr(h, 13, 1) < '4' THEN 'ftp://e.org/x' ELSE 'https://e.org/x' END"), (5, "version", "7", "CASE WHEN substr(h, 14, 1) < '4' THEN '1.2' ELSE '1.2.3-rc.1' END"), (6, "integrity", "7", "'sha256-' || base64(unhex(h))"), (7, "sha256", "b", "CASE WHEN substr(h, 15, 1) < '4' THEN upper(h) ELSE h END"))) + """ FROM d)
 SELECT doc_id, CASE WHEN revision <> '' THEN CASE WHEN regexp_full_match(revision, '[1-9][0-9]*') AND commit || url || version || integrity || sha256 = '' THEN 'confluence' END
 WHEN commit <> '' THEN CASE WHEN regexp_full_match(commit, '[0-9a-f]{40}|[0-9a-f]{64}') AND url || version || integrity || sha256 = '' THEN 'git' END
 WHEN url || version || integrity <> '' THEN CASE WHEN regexp_full_match(version, '[0-9]+[.][0-9]+[.][0-9]+([-+][0-9A-Za-z.+-]+)?') AND regexp_full_match(sha256, '[0-9a-f]{64}') AND integrity <> '' AND regexp_matches(url, '^https?://[^/@]+/') THEN 'npm' END
 WHEN regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'http' END AS type FROM s""")  # fmt: skip
def resolved_types(spark, sf_dir):
    """locked identities whose fields follow from a hash of the id: whole, malformed and mixed ones."""
    h = F.col("h")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    some = lambda k, below, v: F.when(F.substring("h", k, 1) < below, v).otherwise("")
    odd = lambda k, bad, good: F.when(F.substring("h", k, 1) < "4", bad).otherwise(good)
    rows = d.select(
        "doc_id", some(2, "3", F.concat(F.regexp_replace(F.substring("h", 20, 3), "[a-f]", ""), F.lit("7"))).alias("revision"), some(3, "5", odd(12, F.substring("h", 1, 39), F.substring("h", 1, 40))).alias("commit"),
        some(4, "5", odd(13, F.lit("ftp://e.org/x"), F.lit("https://e.org/x"))).alias("url"), some(5, "7", odd(14, F.lit("1.2"), F.lit("1.2.3-rc.1"))).alias("version"),
        some(6, "7", F.concat(F.lit("sha256-"), F.base64(F.unhex(h)))).alias("integrity"), some(7, "b", odd(15, F.upper(h), h)).alias("sha256"),
    )
    return rows.select("doc_id", locks.resolved_type().alias("type"))


_MODULE = """'module x // go 9.9' || chr(10) || CASE WHEN substr(h, 1, 1) < '3' THEN '// go 1.1' || chr(10) ELSE '' END || CASE WHEN substr(h, 2, 1) < 'd' THEN CASE WHEN substr(h, 3, 1) < '4' THEN chr(9) ELSE '' END || 'go' || CASE WHEN substr(h, 4, 1) < '4' THEN '   ' ELSE ' ' END || '1.' || CAST(ascii(substr(h, 5, 1)) AS VARCHAR) || CASE WHEN substr(h, 6, 1) < '8' THEN ' // why' ELSE '' END || chr(10) ELSE '' END
 || CASE WHEN substr(h, 7, 1) < '8' THEN 'golang 1.5' || chr(10) ELSE '' END || CASE WHEN substr(h, 8, 1) < '9' THEN 'toolchain go1.22.' || CAST(ascii(substr(h, 9, 1)) AS VARCHAR) || chr(10) ELSE 'toolchains x' || chr(10) END || 'go 7.7' || chr(10)"""


@query(rf"""SELECT doc_id, nullif(regexp_extract(m, '(?m)^\s*go\s+(\S+)', 1), '') AS go, nullif(regexp_extract(m, '(?m)^\s*toolchain\s+(\S+)', 1), '') AS toolchain FROM (SELECT doc_id, {_MODULE} AS m FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents))""")
def module_directives(spark, sf_dir):
    """Module files with comments, odd blanks, look-alikes and lines that are missing or repeated, by a hash of the id."""
    h = F.col("h")
    at = lambda k, below, yes, no="": F.when(F.substring(h, k, 1) < below, yes).otherwise(no)
    code = lambda k: F.ascii(F.substring(h, k, 1)).cast("string")
    go = F.concat(at(3, "4", "\t"), F.lit("go"), at(4, "4", "   ", " "), F.lit("1."), code(5), at(6, "8", " // why"), F.lit("\n"))
    body = F.concat(F.lit("module x // go 9.9\n"), at(1, "3", "// go 1.1\n"), at(2, "d", go), at(7, "8", "golang 1.5\n"), F.when(F.substring(h, 8, 1) < "9", F.concat(F.lit("toolchain go1.22."), code(9), F.lit("\n"))).otherwise("toolchains x\n"), F.lit("go 7.7\n"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.select("doc_id", text.go_directive(body, "go").alias("go"), text.go_directive(body, "toolchain").alias("toolchain"))


_SRI = """trim(CASE WHEN substr(h, 1, 1) < '8' THEN ' md5-' || h ELSE '' END || CASE WHEN substr(h, 2, 1) < '8' THEN ' sha256-' || to_base64(unhex(h)) ELSE '' END || CASE WHEN substr(h, 3, 1) < '6' THEN '   sha512-' || to_base64(unhex(reverse(h) || h)) ELSE '' END
 || CASE WHEN substr(h, 4, 1) < '6' THEN ' sha384-' || to_base64(unhex(h || left(h, 32))) ELSE '' END || CASE WHEN substr(h, 5, 1) < '6' THEN ' sha256-' || to_base64(unhex(reverse(h))) ELSE '' END || ' ')"""


@query(f"""SELECT doc_id, CASE WHEN p <> '' THEN split_part(p, '-', 1) || ':' || lower(hex(from_base64(substr(p, 8)))) END AS checksum FROM
 (SELECT doc_id, coalesce(nullif(regexp_extract(i, 'sha512-[^ ]+'), ''), nullif(regexp_extract(i, 'sha384-[^ ]+'), ''), regexp_extract(i, 'sha256-[^ ]+')) AS p FROM (SELECT doc_id, {_SRI} AS i FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)))""")  # fmt: skip
def integrity_checksums(spark, sf_dir):
    """Lists of up to five digests of four kinds in one order, each there or not by a hash of the id."""
    h = F.col("h")
    some = lambda k, below, name, raw: F.when(F.substring(h, k, 1) < below, F.concat(F.lit(name), F.regexp_replace(F.base64(F.unhex(raw)), "\\s", ""))).otherwise("")
    value = F.concat(
        F.when(F.substring(h, 1, 1) < "8", F.concat(F.lit(" md5-"), h)).otherwise(""), some(2, "8", " sha256-", h), some(3, "6", "   sha512-", F.concat(F.reverse(h), h)), some(4, "6", " sha384-", F.concat(h, F.substring(h, 1, 32))), some(5, "6", " sha256-", F.reverse(h)), F.lit(" "),
    )
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return d.select("doc_id", text.integrity_checksum(value).alias("checksum"))
