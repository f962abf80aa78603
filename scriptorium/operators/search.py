"""Two-phase ranked search over postings.

Strict: the whole query equals a symbol (boost 20), or all query words stand in
one field. Only if nothing matches and the query has two prose words at least,
relaxed: at least max(2, half of them) stand in any field.

Score: over the matching fields and words, boost * idf * saturated frequency.
idf = ln(1 + (N - df + 0.5) / (df + 0.5)) with N the chunks that have the field
and df those of them with the word; a frequency tf counts as
2.2 tf / (tf + 1.2 (0.25 + 0.75 length / mean length)), lengths in terms of the
field. A symbol adds 20. Rounded to six places. Order: score descending, then
chunk id as text.

Postings carry frequency and length, so one pass over a query's terms gives
both phases. Numbers of chunks, mean lengths and document frequencies come
first, a few numbers for each word. `top` needs no totals and reads less: terms
are stored in blocks with their largest frequency and shortest length, and a
block whose bound stays below the k-th best of some scored chunks is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text

#: Fields and boosts.
BOOSTS = {"names": 6, "title": 5, "filename": 3, "code": 1, "prose": 1}
SYMBOL_BOOST = 20
MAX_OFFSET, MAX_LIMIT, MAX_QUERY_BYTES = 10_000, 100, 4096
#: Saturation and the weight of a field's length.
K1, B = 1.2, 0.75
#: Postings of a term in a block.
BLOCK = 128


@dataclass(frozen=True)
class Query:
    text: str
    kind: str = ""
    language: str = ""
    path_prefix: str = ""
    limit: int = 10
    offset: int = 0

    def validate(self) -> None:
        """F16."""
        if not self.text.strip() or len(self.text.encode()) > MAX_QUERY_BYTES:
            raise ValueError("query must be 1 to 4096 bytes and not blank")
        if not 1 <= self.limit <= MAX_LIMIT or not 0 <= self.offset <= MAX_OFFSET:
            raise ValueError("limit must be 1 to 100 and offset 0 to 10000")
        if self.kind and self.kind not in (text.CODE, text.DOCUMENTATION, text.CONFIG):
            raise ValueError("kind must be code, documentation or config")


@dataclass(frozen=True)
class Weights:
    """Chunks that have a field, their mean length, and document frequencies of a query's words."""

    chunks: dict[str, int]
    mean: dict[str, float]
    df: dict[tuple[str, str], int]

    def of(self, tf: Column, length: Column) -> Column:
        """The score of a posting with these columns; its field and term are columns too."""
        key = F.concat_ws(" ", "field", "term")
        idf = {(f, t): BOOSTS[f] * F.log(F.lit(1 + (self.chunks[f] - n + 0.5) / (n + 0.5))) for (f, t), n in self.df.items()}
        if not idf:
            return F.lit(0.0)
        scale = F.create_map(*[x for (f, t), v in idf.items() for x in (F.lit(f"{f} {t}"), v)])
        mean = F.create_map(*[F.lit(x) for f, v in self.mean.items() for x in (f, v)])
        return scale[key] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean[F.col("field")]))


def _fields(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep..., field, terms): the analyzed fields of every chunk. Prose and title drop stop words; the other fields keep them."""
    own = F.array(*[F.struct(F.lit(f).alias("field"), (text.prose_tokens if f in ("prose", "title") else text.tokens)(f).alias("terms")) for f in BOOSTS])
    return chunks.select(*keep, F.explode(own).alias("f")).select(*keep, "f.field", "f.terms")


_KEEP = ("chunk_id", "path", "kind", "language")


def postings(chunks: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(field, term, chunk_id, path, kind, language, tf, length), of these words or of all."""
    each = _fields(chunks, *_KEEP).withColumn("length", F.size("terms"))
    held = F.col("terms") if words is None else F.filter("terms", lambda t: t.isin(words))
    each = each.select(*_KEEP, "field", "length", F.explode(held).alias("term"))
    return each.groupBy("field", "term", *_KEEP, "length").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(path, field, chunks, terms): how many chunks of a file have the field, and their terms."""
    each = _fields(chunks, "path").select("path", "field", F.size("terms").alias("n")).where("n > 0")
    return each.groupBy("path", "field").agg(F.count("*").alias("chunks"), F.sum("n").alias("terms"))


def term_statistics(held: DataFrame) -> DataFrame:
    """(field, term, df, cf)."""
    return held.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """`term_statistics` of chunks with ids of their own, without their postings: a chunk counts its terms where it is, so that only terms are shuffled."""
    each = _fields(chunks).select("field", F.sort_array("terms").alias("terms"))
    first = each.select("field", F.posexplode("terms").alias("at", "term"), "terms").select("field", "term", F.when((F.col("at") > 0) & (F.get("terms", F.col("at") - 1) == F.col("term")), 0).otherwise(1).alias("first"))
    return first.groupBy("field", "term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def blocked(held: DataFrame) -> DataFrame:
    """Postings with `block`: runs of BLOCK postings of a term and field, the ones of largest frequency first, in the order in which they are to be stored.

    Terms that stand in many chunks are dealt out by a hash of the chunk first,
    so no task numbers all postings of one.
    """
    dealt = held.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int"))
    order = Window.partitionBy("term", "field", "_part").orderBy(F.desc("tf"), "length", "chunk_id")
    return dealt.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("long") * 64 + F.col("_part")).drop("_part")


def blocks(held: DataFrame) -> DataFrame:
    """(term, field, block, n, most, least): the largest frequency and the shortest field in each block."""
    return held.groupBy("term", "field", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"))


def _analyzed(spark, query: str) -> tuple[list[str], list[str]]:
    row = spark.range(1).select(F.array_distinct(text.tokens(F.lit(query))), text.query_terms(F.lit(query))).first()
    return list(row[0]), list(row[1])


def filtered(df: DataFrame, q: Query) -> DataFrame:
    """equality on kind and language, and a raw string prefix of the path; all reach the scan."""
    if q.kind:
        df = df.where(F.col("kind") == q.kind)
    if q.language:
        df = df.where(F.col("language") == q.language)
    if q.path_prefix:
        df = df.where(F.startswith("path", F.lit(q.path_prefix)))
    return df


def weigh(held: DataFrame, sizes: DataFrame, words: list[str]) -> Weights:
    """From stored postings and lengths; a few rows for each word."""
    found = held.where(F.col("term").isin(words)).groupBy("field", "term").count().collect()
    fields = sizes.groupBy("field").agg(F.sum("chunks").alias("n"), F.sum("terms").alias("terms")).collect()
    return Weights({r["field"]: r["n"] for r in fields}, {r["field"]: r["terms"] / r["n"] for r in fields}, {(r["field"], r["term"]): r["count"] for r in found})


def weigh_chunks(chunks: DataFrame, words: list[str]) -> Weights:
    """The same from chunks, in one pass that keeps no postings."""
    hits = F.array_intersect("terms", F.array(*map(F.lit, words)).cast("array<string>"))
    each = _fields(chunks).select("field", F.size("terms").alias("n"), F.posexplode_outer(hits).alias("at", "term")).where("n > 0")
    own = F.coalesce(F.col("at"), F.lit(0)) == 0
    rows = each.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum(F.when(own, F.col("n"))).alias("terms"), F.count_if(own).alias("chunks")).collect()
    total = lambda c: {f: sum(r[c] or 0 for r in rows if r["field"] == f) for f in {r["field"] for r in rows}}
    n, terms = total("chunks"), total("terms")
    return Weights(n, {f: terms[f] / n[f] for f in n}, {(r["field"], r["term"]): r["df"] for r in rows if r["term"] is not None})


@dataclass(frozen=True)
class Plan:
    """A query's words, and what both of its phases ask for."""

    q: Query
    words: list[str]
    terms: list[str]

    @property
    def asked(self) -> list[str]:
        return sorted({*self.words, *self.terms})

    @property
    def least(self) -> int:
        return max(2, (len(self.terms) + 1) // 2)


def plan(spark, q: Query) -> Plan:
    q.validate()
    return Plan(q, *_analyzed(spark, q.text))


def scored(held: DataFrame, chunks: DataFrame, p: Plan, weights: Weights) -> DataFrame:
    """F1, F2: (chunk_id, strict, relaxed) of every chunk with a word or the symbol; a score is null where that phase does not match."""
    each = filtered(held, p.q).where(F.col("term").isin(p.asked)).withColumn("s", weights.of(F.col("tf"), F.col("length")))
    need = F.when(F.col("field").isin("prose", "title"), len(p.terms)).otherwise(len(p.words))
    # A chunk's fields hold as many rows as the query has words, so both sums stay small.
    fields = each.groupBy("chunk_id", "field").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.collect_set("term").alias("terms"), F.sum(F.when(F.col("term").isin(p.terms), F.col("s"))).alias("r"))
    fields = fields.select("chunk_id", F.when((F.col("n") == need) & (need > 0), F.col("s")).alias("strict"), F.array_intersect("terms", F.array(*map(F.lit, p.terms)).cast("array<string>")).alias("terms"), "r")
    none = F.array().cast("array<string>")
    whole = filtered(chunks, p.q).where(F.array_contains("symbols", p.q.text)).select("chunk_id", F.lit(float(SYMBOL_BOOST)).alias("strict"), none.alias("terms"), F.lit(None).cast("double").alias("r"))
    found = fields.unionByName(whole).groupBy("chunk_id").agg(F.round(F.sum("strict"), 6).alias("strict"), F.size(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("n"), F.round(F.sum("r"), 6).alias("relaxed"))
    return found.select("chunk_id", "strict", F.when((F.col("n") >= p.least) & F.lit(len(p.terms) >= 2), F.col("relaxed")).alias("relaxed"))


def chosen(found: DataFrame) -> tuple[DataFrame, int, bool]:
    """(chunk_id, score) of strict matches, or of relaxed ones if there are none, and their number; decided once for the query, not for a page."""
    n = found.agg(F.count("strict").alias("strict"), F.count("relaxed").alias("relaxed")).first()
    is_relaxed = not n["strict"] and n["relaxed"] > 0
    phase = "relaxed" if is_relaxed else "strict"
    return found.where(F.col(phase).isNotNull()).select("chunk_id", F.col(phase).alias("score")), n[phase], is_relaxed


def ranked(found: DataFrame, q: Query) -> DataFrame:
    """A top-k with offset; plans as TakeOrderedAndProject."""
    return found.orderBy(F.desc("score"), F.asc("chunk_id")).offset(q.offset).limit(q.limit)


def search_chunks(chunks: DataFrame, q: Query) -> DataFrame:
    """(chunk_id, score, relaxed) of the page, from chunks without stored postings: one pass for the weights, one for the chunks that hold a word."""
    p = plan(chunks.sparkSession, q)
    weights = weigh_chunks(chunks, p.asked)
    # A cheap look before the analysis. Lower-casing is what the analyzers do first.
    seen = [F.contains(F.lower(F.col(f)), F.lit(w)) for f in BOOSTS for w in p.asked]
    near = filtered(chunks, q).where(F.array_contains("symbols", q.text) | F.coalesce(*[F.when(s, True) for s in seen], F.lit(False)))
    found, _, is_relaxed = chosen(scored(postings(near, p.asked), near, p, weights))
    return ranked(found, q).select("chunk_id", "score", F.lit(is_relaxed).alias("relaxed"))


def top(held: DataFrame, stored: DataFrame, chunks: DataFrame, sizes: DataFrame, q: Query) -> DataFrame:
    """(chunk_id, score, relaxed): the page of `ranked`, over blocks that can hold its rows alone. `held` and `stored` as of `blocked` and `blocks`.

    A block's bound is what its largest frequency in its shortest field would
    score, plus the best bounds of the query's other fields and words. A chunk
    scores no more than any of its blocks' bounds, so all postings of a chunk
    on the page are in blocks whose bound reaches the page's last score, and
    the postings that are left of any other chunk give less than that.
    """
    p = plan(chunks.sparkSession, q)
    weights = weigh(held, sizes, p.asked)
    k = q.offset + q.limit
    keys = [c for c in ("segment", "term", "field", "block") if c in stored.columns]
    # A hair is added, for the last digit of sums taken in another order.
    own = stored.where(F.col("term").isin(p.asked)).withColumn("own", weights.of(F.col("most"), F.col("least")) + 1e-5)
    best = own.groupBy("field", "term").agg(F.max("own").alias("best"))
    total = best.agg(F.coalesce(F.sum("best"), F.lit(0.0))).first()[0] + SYMBOL_BOOST
    bound = own.join(F.broadcast(best), ["field", "term"]).withColumn("bound", F.col("own") - F.col("best") + total)
    few = bound.orderBy(F.desc("bound"), *keys).limit(k)
    mine = filtered(held, q).where(F.col("term").isin(p.asked))
    some = mine.join(F.broadcast(few.select(*keys)), keys, "left_semi").select("chunk_id").distinct()
    tried = scored(mine.join(F.broadcast(some), "chunk_id", "left_semi"), chunks.join(F.broadcast(some), "chunk_id", "left_semi"), p, weights)
    first, _, is_relaxed = chosen(tried)
    if is_relaxed or first.isEmpty():
        # No strict match among them says nothing about the rest.
        found, _, is_relaxed = chosen(scored(mine, chunks, p, weights))
        return ranked(found, q).select("chunk_id", "score", F.lit(is_relaxed).alias("relaxed"))
    last = first.orderBy(F.desc("score")).offset(k - 1).limit(1).collect()
    if last:
        mine = mine.join(bound.where(F.col("bound") >= last[0]["score"]).select(*keys), keys, "left_semi")
    found, _, _ = chosen(scored(mine, chunks, p, weights))
    return ranked(found, q).select("chunk_id", "score", F.lit(False).alias("relaxed"))


def page(held: DataFrame, chunks: DataFrame, q: Query, sizes: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The page with excerpts (P16), and total, next_offset, window_limited and relaxed.

    Excerpts are cut only for the page: its at most 100 rows are joined back to the chunks.
    """
    p = plan(chunks.sparkSession, q)
    found, total, is_relaxed = chosen(scored(held, chunks, p, weigh(held, lengths(chunks) if sizes is None else sizes, p.asked)))
    after = q.offset + q.limit
    info = {"total": total, "relaxed": is_relaxed, "next_offset": after if after < total and after <= MAX_OFFSET else None, "window_limited": after < total and after > MAX_OFFSET}
    top = ranked(found, q)
    words = [w for w in "".join(c if c.isalnum() else " " for c in q.text.lower()).split()]
    full = chunks.join(F.broadcast(top), "chunk_id").withColumn("_lines", text.source_lines("content")).withColumn("_at", text.excerpt_start(F.col("_lines"), words))
    out = full.select(
        "chunk_id", "score", "path", "kind", "language", "title", "symbols", F.col("start_line").alias("chunk_start_line"), F.col("end_line").alias("chunk_end_line"),
        (F.col("start_line") + F.col("_at")).alias("start_line"), F.least(F.col("start_line") + F.col("_at") + 11, F.col("end_line")).alias("end_line"), text.utf8_prefix(text.excerpt(F.col("_lines"), F.col("_at")), 2000).alias("excerpt"),
    )
    return out.orderBy(F.desc("score"), F.asc("chunk_id")), info


def list_files(manifest: DataFrame, kind: str = "", language: str = "", path_prefix: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """F5, T3."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return filtered(manifest, Query("-", kind, language, path_prefix)).orderBy("path").offset(offset).limit(limit)
