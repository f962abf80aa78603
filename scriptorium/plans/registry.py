"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import convert, text
from scriptorium.operators import catalog, chunks, context, diff, journal, locks, merge, search
from scriptorium.plans.session import ship
from scriptorium.plans.views import corpus, graph, journal_events, manifests, sql

FLAGSHIP = "search_strict"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def stop_list() -> str:
    return ", ".join(f"'{w}'" for w in text.STOP_WORDS)


# --- Lines and chunks -------------------------------------------------------


@query(sql("SELECT path, CAST(line_no AS INTEGER) AS line_no, strlen(line) AS bytes, sha256(line) AS line_hash FROM lines", "corpus", "lines"))
def source_lines(spark, sf_dir):
    """P2."""
    return chunks.lines(corpus(spark, sf_dir)).select("path", "line_no", F.octet_length("line").cast("bigint").alias("bytes"), F.sha2("line", 256).alias("line_hash"))


_WINDOWS = r"""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line) - 1 AS INTEGER) AS chunk_no,
 path || '#' || CAST(row_number() OVER (PARTITION BY path ORDER BY start_line) - 1 AS VARCHAR) AS chunk_id, start_line, end_line FROM
 (SELECT path, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line FROM lines GROUP BY path, (line_no - 1) // 80 HAVING max(CASE WHEN regexp_matches(line, '[^\s]') THEN 1 ELSE 0 END) = 1)"""


@query(sql(_WINDOWS, "corpus", "lines"))
def chunk_numbering(spark, sf_dir):
    """P3 (line rule), P8, W1."""
    return chunks.line_windows(corpus(spark, sf_dir))


@query()
def chunk_files(spark, sf_dir):
    """P3 to P5 in full: sections, line and byte limits. Sequential, so without SQL; tests/test_parts.py checks it against its rules."""
    return chunks.chunk_files(corpus(spark, sf_dir)).select("path", "chunk_no", "chunk_id", "title", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


@query(sql("""SELECT path, CAST(3 AS INTEGER) AS start_line, CAST(2 + least(5, greatest(n - 2, 0)) AS INTEGER) AS end_line, n AS total,
 coalesce(body, '') AS content, CASE WHEN 2 + least(5, greatest(n - 2, 0)) < n THEN CAST(3 + least(5, greatest(n - 2, 0)) AS INTEGER) END AS next_start_line FROM
 (SELECT path, CAST(max(line_no) AS INTEGER) AS n, string_agg(CASE WHEN line_no BETWEEN 3 AND 7 THEN line END, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY path)""", "corpus", "lines"))  # fmt: skip
def line_range_read(spark, sf_dir):
    """Lines 3 to 7 of every file."""
    return chunks.read_lines(corpus(spark, sf_dir), start=3, count=5)


@query(sql("SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(bytes AS BIGINT) AS bytes FROM (SELECT path, line_no, sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no) AS bytes FROM lines) WHERE bytes <= 2000", "corpus", "lines"))
def byte_budget(spark, sf_dir):
    """Lines that fit 2000 bytes."""
    return chunks.fit_lines(chunks.lines(corpus(spark, sf_dir)), 2000).select("path", "line_no", F.col("bytes").cast("bigint").alias("bytes"))


def _headings(spark, sf_dir):
    """Every line counts as a heading; its level follows from its length."""
    return chunks.lines(corpus(spark, sf_dir)).select("path", "line_no", (F.length("line") % 4 + 1).alias("level"), F.sha2("line", 256).alias("title"))


_HEADINGS = "headings AS (SELECT path, CAST(line_no AS INTEGER) AS line_no, length(line) % 4 + 1 AS level, sha256(line) AS title FROM lines)"
_TRAIL = """SELECT h.path, h.line_no, CAST(h.level AS INTEGER) AS level,
 concat_ws(' > ', {parts}) AS trail, CAST((SELECT min(n.line_no) - 1 FROM headings n WHERE n.path = h.path AND n.line_no > h.line_no) AS INTEGER) AS section_end,
 CAST((SELECT min(n.line_no) - 1 FROM headings n WHERE n.path = h.path AND n.line_no > h.line_no AND n.level <= h.level) AS INTEGER) AS heading_end FROM headings h"""
_PART = """(SELECT arg_max(p.title, p.line_no) FROM headings p WHERE p.path = h.path AND p.level = {k} AND h.level >= {k} AND p.line_no <= h.line_no
 AND p.line_no > coalesce((SELECT max(q.line_no) FROM headings q WHERE q.path = h.path AND q.level < {k} AND q.line_no <= h.line_no), 0))"""


@query("WITH " + ",\n".join([sql("", "corpus", "lines").removeprefix("WITH RECURSIVE ").strip(), _HEADINGS]) + "\n" + _TRAIL.format(parts=", ".join(_PART.format(k=k) for k in range(1, 5))))
def heading_trail(spark, sf_dir):
    """P5, P12, W2, W3."""
    return chunks.heading_trail(_headings(spark, sf_dir)).select("path", "line_no", F.col("level").cast("int").alias("level"), "trail", F.col("section_end").cast("int").alias("section_end"), F.col("heading_end").cast("int").alias("heading_end"))


@query("WITH " + ",\n".join([sql("", "corpus", "lines").removeprefix("WITH RECURSIVE ").strip()]) + """
 SELECT path, CAST(prev + 1 AS INTEGER) AS gap_start, CAST(start_line - 1 AS INTEGER) AS gap_end FROM
 (SELECT path, line_no AS start_line, coalesce(lag(line_no) OVER (PARTITION BY path ORDER BY line_no), 0) AS prev FROM lines WHERE regexp_matches(line, '^[A-M]')) WHERE prev + 1 < start_line""")  # fmt: skip
def declaration_gaps(spark, sf_dir):
    """W4, with lines that begin with one of the first capitals taken as declarations."""
    d = chunks.lines(corpus(spark, sf_dir)).where(F.col("line").rlike("^[A-M]")).select("path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))
    return chunks.gaps(d).select("path", F.col("gap_start").cast("int").alias("gap_start"), F.col("gap_end").cast("int").alias("gap_end"))


# --- Scalar functions -------------------------------------------------------


@query(sql("SELECT path, kind, CASE kind WHEN 'documentation' THEN 'md' WHEN 'code' THEN 'go' ELSE 'yaml' END AS language, sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size FROM corpus", "corpus"))
def classify_and_hash(spark, sf_dir):
    """P1, P10."""
    c = corpus(spark, sf_dir)
    return c.select("path", text.file_kind("path").alias("k"), text.content_hash("content").alias("hash"), F.octet_length("content").cast("bigint").alias("size")).select("path", "k.kind", "k.language", "hash", "size")


_NAME = "concat('load', p_type, 'HTTPServer', CAST(p_size AS {t}), '_', p_brand)"
_SPLIT = r"""list_filter(flatten(list_transform(string_split(w, '_'), lambda u: string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '(\p{Nd})([^\p{Nd}|])', '\1|\2', 'g'), '([^\p{Nd}|])(\p{Nd})', '\1|\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1|\2', 'g'), '(\p{Ll})(\p{Lu})', '\1|\2', 'g'), '|'))), lambda x: x <> '')"""


@query(r"""SELECT p_partkey, string_agg(CASE WHEN len(parts) > 1 THEN w || ' ' || array_to_string(parts, ' ') ELSE w END, ' ' ORDER BY pos) AS words,
 coalesce(string_agg(CASE WHEN len(parts) > 1 THEN w || ' ' || array_to_string(parts, ' ') END, ' ' ORDER BY pos), '') AS compounds FROM
 (SELECT p_partkey, w, pos, """ + _SPLIT + r""" AS parts FROM (SELECT p_partkey, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM
 (SELECT p_partkey, regexp_extract_all(""" + _NAME.format(t="VARCHAR") + r""", '[\p{L}\p{Nd}_]+') AS ws FROM part))) GROUP BY p_partkey""")  # fmt: skip
def identifier_words(spark, sf_dir):
    """P6, P7 on identifiers made of part names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.expr(_NAME.format(t="STRING"))
    return p.select("p_partkey", text.identifier_words(name).alias("words"), text.compound_words(name).alias("compounds"))


@query(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || regexp_replace(substring(regexp_replace(regexp_replace(lower(o_orderpriority || ' ' || CAST(o_totalprice AS VARCHAR)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') || '-' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS id FROM orders""")
def entry_ids(spark, sf_dir):
    """P18, with a suffix derived from the key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    title = F.concat_ws(" ", "o_orderpriority", F.col("o_totalprice").cast("string"))
    return o.select("o_orderkey", text.entry_id(F.col("o_orderdate"), title, F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4)).alias("id"))


@query(sql("SELECT path, collection, status, CASE WHEN collection = 'templates' THEN 'Authoring template; replace its metadata and prompts before adoption' WHEN status IN ('draft', 'proposed') THEN 'Not accepted; proposed intent does not authorize implementation' WHEN status IN ('retired', 'rejected', 'superseded') THEN 'Historical record; retain its reasoning and consult current guidance' WHEN status = 'accepted' AND collection = 'requirements' THEN 'Agreed intent; acceptance does not establish implementation' WHEN status = 'accepted' THEN 'Accepted decision; implementation must be verified in source' ELSE 'Project documentation; verify implementation against current source' END AS meaning FROM docs", "corpus", "graph"))
def status_meaning(spark, sf_dir):
    """P14."""
    return graph(spark, sf_dir)[0].select("path", "collection", "status", text.status_meaning("collection", "status").alias("meaning"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * l_partkey * l_partkey AS BIGINT) AS size,
 CASE WHEN s < 1024 THEN CAST(s AS VARCHAR) || ' B' WHEN s < 1048576 THEN printf('%.1f KiB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MiB', s / 1048576.0) WHEN s < 1099511627776 THEN printf('%.1f GiB', s / 1073741824.0) ELSE printf('%.1f TiB', s / 1099511627776.0) END AS shown
 FROM (SELECT *, CAST(l_extendedprice * l_partkey * l_partkey AS BIGINT) AS s FROM lineitem)""")  # fmt: skip
def format_sizes(spark, sf_dir):
    """P30 on sizes made of prices; TiB is the largest unit."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("size", F.rint(F.col("l_extendedprice") * F.col("l_partkey") * F.col("l_partkey")).cast("bigint"))
    return li.select("l_orderkey", "l_linenumber", "size", text.format_size("size", "T").alias("shown"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '^(https?://)', '\1user:pw@'), '^(https?://)[^/@]*@', '\1') AS remote FROM pages""")
def sanitize_remotes(spark, sf_dir):
    """A user and password put in front of every address are dropped again."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.sanitize_remote(F.regexp_replace("url", "^(https?://)", "$1user:pw@")).alias("remote"))


@query()
def html_to_markdown(spark, sf_dir):
    """P23, X1; a tree walk, so without SQL."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", convert.column_udf("html-to-markdown")("html").alias("markdown"))


@query()
def adf_to_markdown(spark, sf_dir):
    """P24 to P29 on page trees made of the documents; a tree walk, so without SQL."""
    c = corpus(spark, sf_dir)
    node = lambda kind, *more: F.struct(F.lit(kind).alias("type"), *more)
    line = lambda x: node("paragraph", F.array(node("text", x.alias("text"))).alias("content"))
    tree = F.to_json(F.struct(F.lit("doc").alias("type"), F.transform(text.source_lines("content"), line).alias("content")))
    return c.select("path", convert.column_udf("adf-to-markdown")(tree).alias("markdown"))


# --- Search -----------------------------------------------------------------


def _chunked(spark, sf_dir) -> DataFrame:
    """Chunks by the line rule, with the search fields; the title is the file's first line."""
    c = corpus(spark, sf_dir).withColumn("title", F.substring_index("content", "\n", 1))
    made = c.select("path", "kind", "language", "title", F.posexplode(chunks.windows("content")).alias("chunk_no", "w"))
    made = made.select("path", "kind", "language", "title", "chunk_no", F.array_join("w.lines", "\n").alias("content"), "w.start_line", "w.end_line")
    docs = F.col("kind") == text.DOCUMENTATION
    base = F.element_at(F.split("path", "/"), -1)
    return made.select(
        "path", "kind", "language", "title", F.array(F.split("title", " ")[0]).alias("symbols"), F.lit("").alias("names"), base.alias("filename"), "content",
        F.when(docs, "").otherwise(F.col("content")).alias("code"), F.when(docs, F.col("content")).otherwise("").alias("prose"), "start_line", "end_line", "chunk_no", F.concat_ws("#", "path", F.col("chunk_no").cast("string")).alias("chunk_id"),
    )


def _search(spark, sf_dir, q: search.Query):
    return search.search_chunks(_chunked(spark, sf_dir), q)


_POSTINGS = r"""chunked AS (SELECT l.path, l.kind, c.language, c.title, l.path || '#' || CAST((line_no - 1) // 80 AS VARCHAR) AS chunk_id, string_agg(line, chr(10) ORDER BY line_no) AS content
 FROM lines l JOIN (SELECT path, language, string_split(content, chr(10))[1] AS title FROM corpus) c USING (path) GROUP BY l.path, l.kind, c.language, c.title, (line_no - 1) // 80),
 fields AS (SELECT chunk_id, path, kind, language, 'title' AS field, 5 AS boost, title AS body FROM chunked UNION ALL SELECT chunk_id, path, kind, language, 'filename', 3, split_part(path, '/', -1) FROM chunked
 UNION ALL SELECT chunk_id, path, kind, language, CASE kind WHEN 'documentation' THEN 'prose' ELSE 'code' END, 1, content FROM chunked),
 terms AS (SELECT chunk_id, path, kind, language, field, boost, unnest(regexp_extract_all(lower(body), '[\p{L}\p{Nd}_]+')) AS term FROM fields),
 postings AS (SELECT chunk_id, path, kind, language, field, boost, term, count(*) AS tf FROM terms WHERE field NOT IN ('prose', 'title') OR term NOT IN (""" + stop_list() + r""") GROUP BY ALL)"""


_WEIGHED = """sizes AS (SELECT chunk_id, field, sum(tf) AS len FROM postings GROUP BY ALL), means AS (SELECT field, count(*) AS n, avg(len) AS mean FROM sizes GROUP BY field),
 dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
 weighed AS (SELECT p.*, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS s FROM postings p JOIN sizes USING (chunk_id, field) JOIN means USING (field) JOIN dfs USING (field, term))"""


def _search_sql(words: list[str], terms: list[str], symbol: str, relaxed: bool, where: str = "true", limit: int = 10, offset: int = 0) -> str:
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    if relaxed:
        body = f"SELECT chunk_id, round(sum(s), 6) AS score FROM weighed WHERE {where} AND term IN ({quoted(terms)}) GROUP BY chunk_id HAVING count(DISTINCT term) >= {max(2, (len(terms) + 1) // 2)}"
    else:
        body = f"""SELECT chunk_id, round(sum(s), 6) AS score FROM (SELECT chunk_id, field, sum(s) AS s FROM weighed WHERE {where} AND term IN ({quoted(sorted({*words, *terms}))}) GROUP BY chunk_id, field
 HAVING count(DISTINCT term) = CASE WHEN field IN ('prose', 'title') THEN {len(terms)} ELSE {len(words)} END
 UNION ALL SELECT chunk_id, 'symbols', 20.0 FROM chunked WHERE {where} AND string_split(title, ' ')[1] = '{symbol}') GROUP BY chunk_id"""
    tail = f" ORDER BY score DESC, chunk_id LIMIT {limit} OFFSET {offset}"
    return "WITH " + sql("", "corpus", "lines").removeprefix("WITH RECURSIVE ").strip() + ",\n" + _POSTINGS + ",\n" + _WEIGHED + f"\nSELECT chunk_id, score, {str(relaxed).lower()} AS relaxed FROM ({body})" + tail


@query(_search_sql(["inor"], ["inor"], "inor", False, limit=10))
def search_strict(spark, sf_dir):
    """One word; the best ten."""
    return _search(spark, sf_dir, search.Query("inor"))


@query(_search_sql([], ["inor", "erst", "qqqq", "zzzz"], "", True, limit=20))
def search_relaxed(spark, sf_dir):
    """nothing holds all four words, so two of them are enough."""
    return _search(spark, sf_dir, search.Query("inor the erst qqqq zzzz", limit=20))


@query(_search_sql(["erst"], ["erst"], "erst", False, "true", 10, 10))
def search_page2(spark, sf_dir):
    """The second ten."""
    return _search(spark, sf_dir, search.Query("erst", limit=10, offset=10))


@query(_search_sql(["erst"], ["erst"], "erst", False, "kind = 'documentation' AND language = 'en' AND starts_with(path, 'src1')", 50))
def search_filtered(spark, sf_dir):
    """by kind, language and raw path prefix."""
    return _search(spark, sf_dir, search.Query("erst", "documentation", "en", "src1", 50))


@query("WITH " + sql("", "corpus", "lines").removeprefix("WITH RECURSIVE ").strip() + ",\n" + _POSTINGS + "\nSELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY field, term")
def term_statistics(spark, sf_dir):
    """Document and collection frequency of every term of every field."""
    return search.term_counts(_chunked(spark, sf_dir)).select("field", "term", "df", F.col("cf").cast("bigint").alias("cf"))


@query(sql("""SELECT c.path, CAST(greatest(coalesce(min(CASE WHEN contains(lower(line), 'inor') THEN line_no END), 1) - 2, 1) AS INTEGER) AS start_line FROM corpus c LEFT JOIN lines l ON l.path = c.path GROUP BY c.path""", "corpus", "lines"))
def search_excerpt(spark, sf_dir):
    """Where the excerpt of every file begins."""
    return corpus(spark, sf_dir).select("path", (text.excerpt_start(text.source_lines("content"), ["inor"]) + 1).cast("int").alias("start_line"))


@query(sql("SELECT path, kind, language FROM corpus WHERE kind = 'code' ORDER BY path LIMIT 100 OFFSET 20", "corpus"))
def list_files(spark, sf_dir):
    """F5, T3."""
    return search.list_files(corpus(spark, sf_dir).select("path", "kind", "language"), kind="code", limit=100, offset=20)


# --- Incremental builds -----------------------------------------------------

_DIFF = "SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN n.hash IS NOT DISTINCT FROM o.hash THEN 'unchanged' ELSE 'indexed' END AS state FROM new n FULL JOIN old o ON n.path = o.path"
_FRESH = """SELECT path, state FROM (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NOT NULL AND n.hash <> o.hash THEN 'changed' WHEN n.path IS NULL AND d.path IS NULL THEN 'deleted' WHEN n.path IS NULL THEN 'excluded' END AS state
 FROM new n FULL JOIN old o ON n.path = o.path LEFT JOIN (SELECT path FROM corpus WHERE doc_id % 2 = 0) d ON d.path = coalesce(n.path, o.path)) WHERE state IS NOT NULL"""


def _fresh(spark, sf_dir):
    old, new = manifests(spark, sf_dir)
    return diff.freshness(new, old, corpus(spark, sf_dir).where("doc_id % 2 = 0"))


@query(sql(_DIFF, "corpus", "old", "new"))
def build_diff(spark, sf_dir):
    """J1."""
    old, new = manifests(spark, sf_dir)
    return diff.build_diff(new, old)


@query(sql(f"SELECT count(*) FILTER (state = 'indexed') AS indexed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'deleted') AS deleted, (SELECT count(*) FROM new) AS files, (SELECT count(*) FROM new) AS chunks FROM ({_DIFF})", "corpus", "old", "new"))
def build_report(spark, sf_dir):
    """A1."""
    old, new = manifests(spark, sf_dir)
    return diff.build_report(diff.build_diff(new, old), new)


@query(sql("SELECT count(*) AS files, count(*) AS chunks FROM new", "corpus", "new"))
def index_stats(spark, sf_dir):
    """A2."""
    return diff.index_stats(manifests(spark, sf_dir)[1])


@query(sql(_FRESH, "corpus", "old", "new"))
def freshness(spark, sf_dir):
    """J2, U3."""
    return _fresh(spark, sf_dir)


@query(sql(f"SELECT state, count(*) AS count, array_to_string(list(path ORDER BY path)[1:100], ' ') AS paths FROM ({_FRESH}) GROUP BY state", "corpus", "old", "new"))
def freshness_summary(spark, sf_dir):
    """A5: counts, and samples of 100 paths."""
    return diff.freshness_summary(_fresh(spark, sf_dir)).select("state", "count", F.array_join("paths", " ").alias("paths"))


@query(sql("SELECT h.path, CASE WHEN o.path IS NULL OR n.path IS NULL THEN true ELSE o.size <> n.size OR o.hash <> n.hash END AS stale FROM corpus h LEFT JOIN old o ON h.path = o.path LEFT JOIN new n ON h.path = n.path", "corpus", "old", "new"))
def stale_hits(spark, sf_dir):
    """Every file as a hit."""
    old, new = manifests(spark, sf_dir)
    return diff.mark_stale(corpus(spark, sf_dir).select("path"), old, new)


@query(sql("SELECT sha256(content) AS hash, count(*) AS copies, min(path) AS first_path FROM corpus GROUP BY sha256(content) HAVING count(*) > 1", "corpus"))
def duplicate_content(spark, sf_dir):
    """P10, A3."""
    return diff.duplicate_content(corpus(spark, sf_dir).select("path", text.content_hash("content").alias("hash")))


# --- Documents and their graph ----------------------------------------------


@query(sql("""SELECT path, 'invalid_metadata' AS code, message FROM (
 SELECT path, 'title is required and must be at most 1024 bytes' AS message FROM docs WHERE trim(title) = '' OR strlen(title) > 1024
 UNION ALL SELECT path, 'Requirement status must be draft, accepted, or retired' FROM docs WHERE collection = 'requirements' AND status NOT IN ('draft', 'accepted', 'retired')
 UNION ALL SELECT path, 'Decision status must be proposed, accepted, rejected, or superseded' FROM docs WHERE collection = 'decisions' AND status NOT IN ('proposed', 'accepted', 'rejected', 'superseded')
 UNION ALL SELECT path, 'Decision date must be YYYY-MM-DD' FROM docs WHERE collection = 'decisions' AND try_cast(date AS DATE) IS NULL
 UNION ALL SELECT path, 'Superseded decision requires superseded_by' FROM docs WHERE collection = 'decisions' AND status = 'superseded' AND superseded_by = ''
 UNION ALL SELECT path, 'Handbook sidebar_position must be positive' FROM docs WHERE collection = 'handbook' AND sidebar_position < 1)""", "corpus", "graph"))  # fmt: skip
def metadata_problems(spark, sf_dir):
    """F22."""
    return catalog.metadata_problems(graph(spark, sf_dir)[0])


@query(sql("SELECT path, id, copies FROM (SELECT path, id, count(*) OVER (PARTITION BY id) AS copies FROM docs) WHERE copies > 1", "corpus", "graph"))
def duplicate_ids(spark, sf_dir):
    """A3."""
    return catalog.duplicate_ids(graph(spark, sf_dir)[0])


@query(sql("SELECT path, sidebar_position, previous_path FROM (SELECT path, sidebar_position, lag(path) OVER (PARTITION BY sidebar_position ORDER BY path) AS previous_path FROM docs WHERE collection = 'handbook' AND sidebar_position >= 1) WHERE previous_path IS NOT NULL", "corpus", "graph"))
def duplicate_positions(spark, sf_dir):
    """A4."""
    return catalog.duplicate_positions(graph(spark, sf_dir)[0])


_IDS = "ids AS (SELECT id, count(*) AS n, min(path) AS p, bool_or(collection = 'templates') AS t FROM docs GROUP BY id)"


@query(sql("", "corpus", "graph").strip() + ",\n" + _IDS + """ SELECT a.path, a.related_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN t THEN 'template' ELSE 'resolved' END AS outcome, CASE WHEN n = 1 AND NOT t THEN p END AS related_path
 FROM (SELECT path, related1 AS related_id FROM docs UNION ALL SELECT path, related2 FROM docs) a LEFT JOIN ids ON a.related_id = ids.id""")  # fmt: skip
def related_resolution(spark, sf_dir):
    """J5."""
    return catalog.resolve_related(graph(spark, sf_dir)[0])


@query(sql("SELECT link_path, path, line FROM links WHERE link_path NOT IN (SELECT path FROM corpus)", "corpus", "graph"))
def broken_links(spark, sf_dir):
    """J6."""
    return catalog.broken_links(graph(spark, sf_dir)[1], corpus(spark, sf_dir)).select("link_path", "path", "line")


_EDGES = _IDS + """, one AS (SELECT d.path AS src, i.p AS dst FROM (SELECT path, related1 AS id FROM docs UNION SELECT path, related2 FROM docs UNION SELECT path, superseded_by FROM docs WHERE superseded_by <> '') d JOIN ids i ON d.id = i.id AND i.n = 1 WHERE d.path <> i.p),
 edges AS (SELECT src, dst FROM one UNION SELECT dst, src FROM one)"""


@query(sql("", "corpus", "graph").strip() + ",\n" + _EDGES + " SELECT src, dst FROM edges")
def document_edges(spark, sf_dir):
    """U1, U2."""
    return catalog.edges(graph(spark, sf_dir)[0])


def _asked(spark, sf_dir):
    c = corpus(spark, sf_dir)
    gone = c.where("doc_id % 10 = 6").select(F.concat(F.lit("missing/"), "path").alias("path"))
    return c.where("doc_id % 20 = 3").select(F.substring_index("path", "/", 1).alias("path")).union(c.where("doc_id % 10 = 4").select("path")).union(gone).distinct()


_OVERLAP = "({a} = {b} OR starts_with({a}, {b} || '/') OR starts_with({b}, {a} || '/'))"
_DIRECT = f"""SELECT DISTINCT path, 'changed_document' AS reason, changed, CAST(NULL AS INTEGER) AS line FROM docs, asked WHERE {_OVERLAP.format(a='path', b='changed')}
 UNION SELECT DISTINCT path, 'direct_link', changed, line FROM links, asked WHERE {_OVERLAP.format(a='link_path', b='changed')}"""


@query(sql(_DIRECT, "corpus", "graph", "asked"))
def impact_direct(spark, sf_dir):
    """By equality on ancestors."""
    docs, links = graph(spark, sf_dir)
    return catalog.direct_impact(docs, links, _asked(spark, sf_dir))


@query(sql("", "corpus", "graph").strip() + ",\n" + _EDGES + """, start AS (SELECT path FROM docs WHERE doc_id % 20 = 0),
 hop1 AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM start) AND dst NOT IN (SELECT path FROM start)),
 hop2 AS (SELECT DISTINCT dst AS path FROM edges WHERE src IN (SELECT path FROM hop1) AND dst NOT IN (SELECT path FROM start) AND dst NOT IN (SELECT path FROM hop1))
 SELECT path, CAST(0 AS INTEGER) AS hops FROM start UNION ALL SELECT path, 1 FROM hop1 UNION ALL SELECT path, 2 FROM hop2""")  # fmt: skip
def impact_bfs(spark, sf_dir):
    """G1: two steps from the documents asked for, those whose id is divisible by 20."""
    docs, _ = graph(spark, sf_dir)
    return catalog.spread(docs.where("doc_id % 20 = 0"), catalog.edges(docs)).select("path", "hops")


@query(sql("", "corpus", "graph").strip() + ",\n" + """good AS (SELECT id, min(superseded_by) AS after FROM docs GROUP BY id HAVING count(*) = 1 AND min(collection) = 'decisions' AND min(status) IN ('accepted', 'superseded')),
 chain(path, hop, target, seen) AS (SELECT path, 0, superseded_by, [id] FROM docs WHERE collection = 'decisions' AND superseded_by <> ''
 UNION ALL SELECT c.path, c.hop + 1, g.after, list_append(c.seen, c.target) FROM chain c JOIN good g ON g.id = c.target WHERE NOT list_contains(c.seen, c.target) AND c.hop < 32 AND c.target <> '')
 SELECT path, CAST(hop AS INTEGER) AS hop, seen[hop + 1] AS replacement FROM chain WHERE hop > 0""")  # fmt: skip
def supersession_chain(spark, sf_dir):
    """G2."""
    return catalog.replacements(graph(spark, sf_dir)[0])


@query(sql("", "corpus", "graph", "asked").strip() + f""", direct AS ({_DIRECT}) SELECT changed AS path FROM asked WHERE changed NOT IN (SELECT changed FROM direct)""")
def unmapped_paths(spark, sf_dir):
    """U6."""
    docs, links = graph(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    return catalog.unmapped(asked, catalog.direct_impact(docs, links, asked))


@query()
def context_assembly(spark, sf_dir):
    """A request for every fifty documents, about the candidates that a catalog allows; sequential, so without SQL (tests/test_parts.py checks its invariants)."""
    c = corpus(spark, sf_dir)
    rows = c.select(F.floor(F.col("doc_id") / 50).cast("bigint").alias("request"), "path", (F.col("doc_id") % 5).cast("int").alias("priority"), F.lit(1).alias("start_line"), "content", F.array(F.col("doc_id").cast("string")).alias("evidence"))
    return context.assemble(context.candidates(rows)).select("request", "item", "path", "reason", "bytes", "next_start_line")


# --- Journal ----------------------------------------------------------------

_NOW = "2024-03-01 00:00:00"


def _entries(spark, sf_dir):
    return journal.state(journal_events(spark, sf_dir))


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(sql("SELECT id, status, created_at, updated_at, expires_at FROM entries", "journal"))
def journal_state(spark, sf_dir):
    """R6."""
    return _entries(spark, sf_dir)


@query(sql("SELECT id, status, updated_at FROM entries WHERE status = 'done' AND updated_at >= (SELECT min(ts) + INTERVAL 1 DAY FROM events)", "journal"))
def journal_list(spark, sf_dir):
    """F6, F7, T4."""
    since = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts")).first()[0]
    return journal.list_entries(_entries(spark, sf_dir), "done", F.lit(since) + F.make_dt_interval(F.lit(1))).select("id", "status", "updated_at")


@query(sql("SELECT count(*) AS entries, CAST(coalesce(sum(n), 0) AS BIGINT) AS size FROM (SELECT e.id, (SELECT count(*) FROM journal j WHERE j.id = e.id) AS n FROM entries e WHERE status <> 'open' AND expires_at IS NOT NULL AND expires_at <= (SELECT max(ts) FROM events))", "journal"))
def journal_gc(spark, sf_dir):
    """The size of an entry is its number of events."""
    events = journal_events(spark, sf_dir)
    now = events.agg(F.max("at")).first()[0]
    return journal.gc_report(journal.gc(_entries(spark, sf_dir), events.groupBy("id").agg(F.count("*").alias("size")), F.lit(now))).select("entries", F.col("size").cast("bigint").alias("size"))


@query(sql("SELECT id, CASE WHEN status <> 'open' AND expires_at IS NULL THEN 'kept' ELSE 'stale' END AS why FROM entries WHERE (status <> 'open' AND expires_at IS NULL) OR (status = 'open' AND updated_at < (SELECT max(ts) FROM events) - INTERVAL 14 DAY)", "journal"))
def journal_kept_and_stale(spark, sf_dir):
    """F10, F11."""
    now = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0]
    e = _entries(spark, sf_dir)
    return e.where(journal.kept()).select("id", F.lit("kept").alias("why")).unionByName(e.where(journal.stale(F.lit(now))).select("id", F.lit("stale").alias("why")))


@query("""WITH notes AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, text) AS notes FROM conversations GROUP BY conv_id),
 lines AS (SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT conv_id, string_split(notes, chr(10)) AS l FROM notes))
 SELECT CAST(conv_id AS VARCHAR) AS id, array_to_string(list(trim(line) ORDER BY n)[1:3], chr(10)) AS lines FROM lines WHERE contains(lower(line), 'tion') AND NOT starts_with(trim(line), '<!--') GROUP BY conv_id""")  # fmt: skip
def journal_search(spark, sf_dir):
    """F8, T5: conversations as notes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.sort_array(F.collect_list(F.struct("turn", "text", "role")))
    notes = c.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("notes"))
    entries = notes.select("id", F.lit("").alias("title"), F.array().cast("array<string>").alias("tags"), F.lit(0).alias("updated_at"))
    return journal.search(entries, notes, " TION ").select("id", F.array_join("lines", "\n").alias("lines"))


# --- Pinned files and merges ------------------------------------------------


@query(sql("SELECT o.path, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.hash <> o.hash THEN 'differs' ELSE 'ok' END AS state FROM old o LEFT JOIN new n ON o.path = n.path", "corpus", "old", "new"))
def lock_check(spark, sf_dir):
    """J7."""
    old, new = manifests(spark, sf_dir)
    return locks.check(old, new)


@query(sql("SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'remove' WHEN o.path IS NULL THEN 'create' WHEN n.hash <> o.hash THEN 'update' ELSE 'keep' END AS op FROM new n FULL JOIN old o ON n.path = o.path", "corpus", "old", "new"))
def lock_changes(spark, sf_dir):
    """J8, K8, U4."""
    old, new = manifests(spark, sf_dir)
    return locks.changes(new, old)


_TARGETS = "targets AS (SELECT path FROM corpus UNION SELECT upper(path) FROM corpus WHERE doc_id % 9 = 0 UNION SELECT split_part(path, '/', 1) FROM corpus WHERE doc_id % 8 = 0)"


@query("WITH " + sql("", "corpus").removeprefix("WITH RECURSIVE ").strip() + ", " + _TARGETS + """ SELECT path, 'case_duplicate' AS problem FROM targets WHERE lower(path) IN (SELECT lower(path) FROM targets GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT path, 'file_is_directory' FROM targets t WHERE EXISTS (SELECT 1 FROM targets u WHERE starts_with(lower(u.path), lower(t.path) || '/'))""")  # fmt: skip
def lock_collisions(spark, sf_dir):
    """A12, D12."""
    c = corpus(spark, sf_dir)
    extra = c.where("doc_id % 9 = 0").select(F.upper("path").alias("path")).union(c.where("doc_id % 8 = 0").select(F.substring_index("path", "/", 1)))
    return locks.collisions(c.select("path").union(extra))


@query("WITH " + sql("", "corpus").removeprefix("WITH RECURSIVE ").strip() + """, t AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS owner, CASE WHEN doc_id % 10 < 2 THEN 'p/' || CAST(doc_id // 4 AS VARCHAR) ELSE 'p/' || CAST(doc_id // 4 AS VARCHAR) || '/f' || CAST(doc_id % 4 AS VARCHAR) END AS path FROM documents)
 SELECT DISTINCT a.owner, a.path, b.owner AS other, b.path AS other_path FROM t a, t b WHERE a.owner < b.owner AND (lower(a.path) = lower(b.path) OR starts_with(lower(a.path), lower(b.path) || '/') OR starts_with(lower(b.path), lower(a.path) || '/'))""")  # fmt: skip
def ownership_overlap(spark, sf_dir):
    """J10."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.concat_ws("/", F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))
    path = F.when(F.col("doc_id") % 10 < 2, base).otherwise(F.concat(base, F.lit("/f"), (F.col("doc_id") % 4).cast("string")))
    return locks.ownership_overlap(d.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("owner"), path.alias("path")))


_MERGE = """base AS (SELECT path, sha256(content) AS hash FROM corpus WHERE doc_id % 5 <> 0),
 cur AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN 'c' || sha256(content) ELSE sha256(content) END AS hash FROM corpus WHERE doc_id % 7 <> 0),
 inc AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'i' || sha256(content) ELSE sha256(content) END AS hash FROM corpus WHERE doc_id % 9 <> 0)"""


@query("WITH " + sql("", "corpus").removeprefix("WITH RECURSIVE ").strip() + ", " + _MERGE + """ SELECT p.path, CASE WHEN i.hash IS NULL THEN CASE WHEN c.hash IS NULL THEN 'absent' WHEN c.hash IS NOT DISTINCT FROM b.hash THEN 'remove' ELSE 'conflict' END
 WHEN c.hash IS NULL THEN CASE WHEN b.hash IS NULL THEN 'take_incoming' WHEN b.hash = i.hash THEN 'absent' ELSE 'conflict' END
 WHEN c.hash IS NOT DISTINCT FROM b.hash OR c.hash = i.hash THEN 'take_incoming' WHEN b.hash IS NOT DISTINCT FROM i.hash THEN 'keep_current' ELSE 'merge' END AS action
 FROM (SELECT path FROM base UNION SELECT path FROM cur UNION SELECT path FROM inc) p LEFT JOIN base b USING (path) LEFT JOIN cur c USING (path) LEFT JOIN inc i USING (path)""")  # fmt: skip
def merge3_decision(spark, sf_dir):
    """J11, J12, U5."""
    c = corpus(spark, sf_dir).select("doc_id", "path", text.content_hash("content").alias("hash"))
    changed = lambda k, mark: F.when(F.col("doc_id") % k == 0, F.concat(F.lit(mark), F.col("hash"))).otherwise(F.col("hash")).alias("hash")
    return merge.merge3(c.where("doc_id % 5 <> 0"), c.where("doc_id % 7 <> 0").select("path", changed(4, "c")), c.where("doc_id % 9 <> 0").select("path", changed(6, "i")))


@query("""SELECT coalesce(b.path, l.path) AS path, CASE WHEN l.path IS NOT NULL THEN l.value ELSE b.value END AS value, l.path IS NOT NULL AS overridden FROM
 (SELECT 'customer.' || CAST(c_custkey AS VARCHAR) AS path, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0) b FULL JOIN
 (SELECT 'customer.' || CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(c_mktsegment) END AS value FROM customer WHERE c_custkey % 4 <> 0) l ON b.path = l.path""")  # fmt: skip
def overlay_merge(spark, sf_dir):
    """Null clears."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("path", F.concat(F.lit("customer."), F.col("c_custkey").cast("string")))
    local = c.where("c_custkey % 4 <> 0").select("path", F.when(F.col("c_custkey") % 5 != 0, F.lower("c_mktsegment")).alias("value"))
    return merge.overlay(c.where("c_custkey % 3 <> 0").select("path", F.col("c_mktsegment").alias("value")), local)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN i ELSE p END AS state FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS i FROM orders) WHERE CASE WHEN o_orderkey % 4 = 0 THEN i ELSE p END IS NOT NULL")
def merge_lock(spark, sf_dir):
    """J13."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey").cast("string"))
    return merge.merge_lock(o.where("o_orderkey % 4 = 0").select("id"), o.where("o_orderkey % 3 <> 0").select("id", F.col("o_orderstatus").alias("state")), o.where("o_orderkey % 5 <> 0").select("id", F.col("o_orderpriority").alias("state")))


@query(sql("SELECT path, sha256(CASE WHEN coalesce(content, '') IN ('', chr(10)) THEN coalesce(content, '') WHEN right(content, 1) = chr(10) THEN content ELSE content || chr(10) END || '# begin' || chr(10) || 'managed' || chr(10) || '# end' || chr(10)) AS hash FROM corpus", "corpus"))
def managed_blocks(spark, sf_dir):
    """K9: a block is written, replaced by another, and that is the same as writing the other at once."""
    c = corpus(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    first = c.select("path", merge.managed_block(F.col("content"), "# begin", "# end", "old\nlines").alias("content"))
    return first.select("path", F.sha2(merge.managed_block(F.col("content"), "# begin", "# end", "managed"), 256).alias("hash"))


@query()
def settings_merge(spark, sf_dir):
    """K10 on event properties; nested paths of a JSON text, so without SQL."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    run = merge.settings_udf({"managed": {"by": "engine"}, "extra": 1}, ["managed.by"], ["extra"])
    return e.select("event_id", F.sha2(run("props"), 256).alias("hash"))


@query("SELECT o_orderstatus AS engine, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, count(*) AS checks FROM orders GROUP BY o_orderstatus")
def doctor_status(spark, sf_dir):
    """A check for each order; its priority is its status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "fail").when(F.col("o_orderpriority") == "2-HIGH", "warn").otherwise("pass")
    rank = F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0)
    worst = o.groupBy(F.col("o_orderstatus").alias("engine")).agg(F.max(rank).alias("r"), F.count("*").alias("checks"))
    return worst.select("engine", F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("r") + 1).alias("status"), "checks")
