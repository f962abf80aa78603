"""Lines, sections and chunks of files, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import markdown, text

MAX_LINES, MAX_BYTES = 80, 16 * 1024

CHUNK_SCHEMA = """path string, kind string, language string, title string, symbols array<string>, names string, filename string, content string,
 code string, prose string, start_line int, end_line int, chunk_no int, chunk_id string"""


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): every line of every file, numbered from 1."""
    return files.select("path", F.posexplode(text.source_lines("content")).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def windows(content: Column | str, size: int = MAX_LINES) -> Column:
    """array<struct(lines, start_line, end_line)>: a text's lines by `size`, cut out of the line array, without a shuffle."""
    every = text.source_lines(content)
    n = F.size(every)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    piece = lambda w: F.struct(F.slice(every, w * size + 1, size).alias("lines"), (w * size + 1).alias("start_line"), F.least((w + 1) * size, n).alias("end_line"))
    return F.transform(starts, piece)


def line_windows(files: DataFrame, size: int = MAX_LINES) -> DataFrame:
    """P3's line rule alone, W1: windows of `size` lines; blank windows are dropped and do not count in the ordinal."""
    some = F.filter(windows("content", size), lambda w: F.exists(w["lines"], lambda x: x.rlike(r"\S")))
    kept = files.select("path", F.posexplode(some).alias("chunk_no", "w"))
    return kept.select("path", "chunk_no", F.concat_ws("#", "path", F.col("chunk_no").cast("string")).alias("chunk_id"), "w.start_line", "w.end_line")


def read_lines(files: DataFrame, start: int = 1, count: int = 200, max_bytes: int = 64 * 1024) -> DataFrame:
    """Lines from `start`, at most `count` (500 at most) and max_bytes; next_start_line if lines are left."""
    if start < 1 or not 1 <= count <= 500:
        raise ValueError("start must be positive and count 1 to 500")
    every = text.source_lines("content")
    page = files.select("path", F.size(every).alias("total"), F.slice(every, start, count).alias("page"))
    sums = F.aggregate(F.transform("page", lambda x: F.octet_length(x) + 1), F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint")) + x)))
    fit = page.withColumn("n", F.greatest(F.size(F.filter(sums, lambda s: s <= max_bytes)), F.least(F.lit(1), F.size("page"))))
    last = F.lit(start - 1) + F.col("n")
    return fit.select(
        "path", F.lit(start).alias("start_line"), last.cast("int").alias("end_line"), "total", F.array_join(F.slice("page", F.lit(1), F.col("n")), "\n").alias("content"),
        F.when(last < F.col("total"), last + 1).cast("int").alias("next_start_line"),
    )


def fit_lines(source: DataFrame, budget: int) -> DataFrame:
    """The longest run of first lines of each path whose bytes, newlines included, stay in the budget."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return source.withColumn("bytes", F.sum(F.octet_length("line") + 1).over(w)).where(F.col("bytes") <= budget)


def heading_trail(headings: DataFrame) -> DataFrame:
    """P5, P12, W2, W3 for (path, line_no, level, title): the trail joined by ` > `, the section's end and the heading's end.

    A section ends before the next heading of any level, a heading before the
    next one of the same or a shallower level; both are null at the file's end.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = headings.withColumn("section_end", F.lead("line_no").over(w) - 1)
    for k in range(1, 7):
        out = out.withColumn(f"_s{k}", F.max(F.when(F.col("level") < k, F.col("line_no"))).over(upto))
        out = out.withColumn(f"_h{k}", F.max(F.when(F.col("level") == k, F.struct("line_no", "title"))).over(upto))
    trail = [F.when((F.col("level") >= k) & F.col(f"_h{k}").isNotNull() & (F.col(f"_h{k}.line_no") > F.coalesce(F.col(f"_s{k}"), F.lit(0))), F.col(f"_h{k}.title")) for k in range(1, 7)]
    out = out.withColumn("trail", F.concat_ws(" > ", *trail))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(after)) for k in range(1, 7)]
    return out.withColumn("heading_end", F.coalesce(*ends) - 1).select("path", "line_no", "level", "title", "trail", "section_end", "heading_end")


def gaps(declarations: DataFrame) -> DataFrame:
    """W4 for (path, start_line, end_line): the unclaimed lines before each declaration."""
    w = Window.partitionBy("path").orderBy("start_line")
    before = F.coalesce(F.lag("end_line").over(w), F.lit(0))
    return declarations.withColumn("gap_start", before + 1).where(F.col("gap_start") < F.col("start_line")).select("path", "gap_start", (F.col("start_line") - 1).alias("gap_end"))


def windows_of(all_lines: list[str], start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Pieces (first, last, content) of lines [start, end): MAX_LINES and MAX_BYTES at most; a longer line is cut between characters."""
    held: list[str] = []
    size, first = 0, start
    for at in range(start, end):
        raw = all_lines[at].encode()
        if held and (len(held) == MAX_LINES or size + len(raw) + 1 > MAX_BYTES):
            yield first, at - 1, "\n".join(held)
            held, size, first = [], 0, at
        while len(raw) > MAX_BYTES:
            piece = raw[:MAX_BYTES].decode("utf-8", "ignore")
            yield at, at, piece
            raw, first = raw[len(piece.encode()) :], at
        held.append(raw.decode())
        size += len(raw) + 1
    if held:
        yield first, end - 1, "\n".join(held)


def chunk_files(files: DataFrame) -> DataFrame:
    """(path, kind, language, content) to chunks; Arrow batches of whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                content = f.content or ""
                every = content.removesuffix("\n").split("\n") if content else []
                n = 0
                for start, end, title, symbols in markdown.sections(f.path, f.kind, f.language, every, content):
                    for a, b, piece in windows_of(every, start, end):
                        if piece.strip():
                            rows.append((f.path, f.kind, f.language, title, symbols, piece, a + 1, b + 1, n))
                            n += 1
            yield pd.DataFrame(rows, columns=["path", "kind", "language", "title", "symbols", "content", "start_line", "end_line", "chunk_no"])

    raw = files.select("path", "kind", "language", "content").mapInPandas(run, "path string, kind string, language string, title string, symbols array<string>, content string, start_line int, end_line int, chunk_no int")
    return with_fields(raw)


def with_fields(chunks: DataFrame) -> DataFrame:
    """Search fields: documentation is searched as prose (and its compound identifiers as code), everything else as code."""
    docs = F.col("kind") == text.DOCUMENTATION
    base = F.element_at(F.split("path", "/"), -1)
    empty: Column = F.lit("")
    return chunks.select(
        "path", "kind", "language", "title", "symbols", text.identifier_words(F.array_join("symbols", " ")).alias("names"), F.concat_ws(" ", base, text.identifier_words(base)).alias("filename"), "content",
        F.when(docs, text.compound_words("content")).otherwise(text.identifier_words("content")).alias("code"), F.when(docs, F.col("content")).otherwise(empty).alias("prose"),
        "start_line", "end_line", "chunk_no", F.concat_ws("#", "path", F.col("chunk_no").cast("string")).alias("chunk_id"),
    )
