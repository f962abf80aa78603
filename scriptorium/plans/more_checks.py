"""Queries of templates and their SQL. They join the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import templates
from scriptorium.plans.registry import query

_SOURCES = (
    ("head.tpl.md", '# {{ .lang | upper }}{{ if eq .source "src1" }} (first){{ else if eq .source "src2" }} (second){{ else }} from {{ .source }}{{ end }}\n'),
    ("words.tpl.md", "{{/* the first words */ -}}\n{{ range .words }}- {{ . | trim | lower }}\n{{ else }}no words\n{{ end }}\n{{- with .note }}note: {{ . }}\n{{ end -}}\nin all {{ len .words }}: {{ join .words \", \" }}\n"),
)


@query(r"""WITH given AS (SELECT doc_id, lang, source, list_filter(string_split(left(text, 60), ' '), lambda x: x <> '') AS words, CASE WHEN doc_id % 3 = 0 THEN 'n' || CAST(doc_id AS VARCHAR) ELSE '' END AS note FROM documents),
 parts AS (SELECT *, '# ' || upper(lang) || CASE source WHEN 'src1' THEN ' (first)' WHEN 'src2' THEN ' (second)' ELSE ' from ' || source END || chr(10) AS head,
 CASE WHEN len(words) = 0 THEN 'no words' || chr(10) ELSE array_to_string(list_transform(words, lambda w: '- ' || lower(regexp_replace(w, '^\s+|\s+$', '', 'g')) || chr(10)), '') END AS list, CASE WHEN note <> '' THEN 'note: ' || note || chr(10) ELSE '' END AS noted, 'in all ' || CAST(len(words) AS VARCHAR) || ': ' || array_to_string(words, ', ') || chr(10) AS foot FROM given)
 SELECT doc_id, head || list || noted || foot AS content, CAST(length(head || list || noted) AS INTEGER) AS foot_at, CAST(CASE WHEN len(words) = 0 THEN 0 ELSE len(words) END AS INTEGER) AS items FROM parts""")  # fmt: skip
def rendered_templates(spark, sf_dir):
    """Two sources over every document, with the place of the last line and the number of printed items."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.split(F.substring("text", 1, 60), " "), lambda x: x != "")
    given = d.select("doc_id", "lang", "source", words.alias("words"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).otherwise("").alias("note"))
    out = templates.render(given, *_SOURCES)
    spans = F.col("rendered.spans")
    last = F.filter(spans, lambda s: (s["source"] == "words.tpl.md") & (s["line"] == 7))
    items = F.filter(spans, lambda s: (s["source"] == "words.tpl.md") & (s["line"] == 2))
    # A word prints itself and the "- " before it from one line; an item that trims to nothing prints the mark alone.
    marks = F.filter(items, lambda s: F.substring("rendered.content", s["start"] + 1, s["end"] - s["start"]) == "- ")
    return out.select("doc_id", F.col("rendered.content").alias("content"), last[0]["start"].alias("foot_at"), F.size(marks).alias("items"))
