"""The documentation catalog of a scan: documents, headings, links and diagnostics as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import markdown

MAX_FILES, MAX_BYTES = 10_000, 64 << 20

PARSED = """path string, has_metadata boolean, id string, title string, status string, date string, related array<string>, superseded_by string,
 sidebar_position int, collection string, body_line int, lines int, headings array<struct<level:int,title:string,start_line:int,end_line:int>>,
 links array<struct<target:string,link_path:string,fragment:string,kind:string,line:int>>, diagnostics array<struct<code:string,message:string>>"""


def parse(files: DataFrame) -> DataFrame:
    """One row for each Markdown file; Arrow batches of whole files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                p = markdown.parse(path, content or "")
                m = p.metadata or {}
                rows.append({
                    "path": path, "has_metadata": p.metadata is not None, **{k: m.get(k, "") for k in ("id", "title", "status", "date", "superseded_by", "collection")},
                    "related": m.get("related", []), "sidebar_position": m.get("sidebar_position", 0), "body_line": p.body_line, "lines": p.lines,
                    "headings": [{"level": h.level, "title": h.title, "start_line": h.start_line, "end_line": h.end_line} for h in p.headings],
                    "links": [dict(zip(("target", "link_path", "fragment", "kind", "line"), x)) for x in p.links], "diagnostics": [dict(zip(("code", "message"), d)) for d in p.diagnostics],
                })
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in _columns()])

    return files.select("path", "content").mapInPandas(run, PARSED)


def _columns() -> list[str]:
    return ["path", "has_metadata", "id", "title", "status", "date", "related", "superseded_by", "sidebar_position", "collection", "body_line", "lines", "headings", "links", "diagnostics"]


def load(files: DataFrame, entrypoint: str = "docs/README.md") -> dict[str, DataFrame]:
    """Documents (with front matter, or the entrypoint), headings, links and diagnostics. More than 10,000 files or 64 MiB is an error."""
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b")).first()
    if size["n"] > MAX_FILES or size["b"] > MAX_BYTES:
        raise ValueError("the catalog exceeds 10000 files or 64 MiB")
    parsed = parse(files)
    documents = parsed.where(F.col("has_metadata") | (F.col("path") == entrypoint))
    return {
        "documents": documents.drop("headings", "links", "diagnostics"),
        "headings": documents.select("path", F.inline("headings")).withColumnRenamed("start_line", "line_no"),
        "links": documents.select("path", F.inline("links")),
        "diagnostics": parsed.select("path", F.inline("diagnostics")),
    }
