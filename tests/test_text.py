import pytest
from pyspark.sql import functions as F

from scriptorium.functions import markdown, paths, text
from scriptorium.operators.chunks import MAX_BYTES, windows_of


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "word, parts",
    [("HTTPServer", ["HTTP", "Server"]), ("newHTTPServer2", ["new", "HTTP", "Server", "2"]), ("snake_case_id", ["snake", "case", "id"]), ("plain", ["plain"]), ("v10beta", ["v", "10", "beta"]), ("__init__", ["init"])],
)
def test_identifier_parts(spark, word, parts):
    assert one(spark, text.identifier_parts(F.lit(word))) == parts


def test_identifier_words(spark):
    assert one(spark, text.identifier_words(F.lit("run NewServer now"))) == "run NewServer New Server now"
    assert one(spark, text.compound_words(F.lit("run NewServer now"))) == "NewServer New Server"


@pytest.mark.parametrize("content, lines", [("", []), ("\n", [""]), ("a\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("a", ["a"])])
def test_source_lines(spark, content, lines):
    assert one(spark, text.source_lines(F.lit(content))) == lines


@pytest.mark.parametrize("limit, want", [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (5, "aé"), (7, "aé😀"), (99, "aé😀")])
def test_utf8_prefix(spark, limit, want):
    assert one(spark, text.utf8_prefix(F.lit("aé😀"), limit)) == want


@pytest.mark.parametrize("path, kind", [("a/b.md", ("documentation", "md")), ("x.GO", ("code", "go")), ("go.mod", ("config", "mod")), ("Makefile", ("config", "text")), ("d.x/Makefile", ("config", "text"))])
def test_file_kind(spark, path, kind):
    assert tuple(one(spark, text.file_kind(F.lit(path)))) == kind


@pytest.mark.parametrize("size, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (1 << 20, "1.0 MiB"), (5 << 40, "5.0 TiB"), (3 << 50, "3.0 PiB")])
def test_format_size(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size))) == shown


@pytest.mark.parametrize("size, shown", [(1 << 50, "1024.0 TiB"), (3 << 50, "3072.0 TiB"), (1280, "1.2 KiB"), (1792, "1.8 KiB"), ((1 << 20) - 1, "1024.0 KiB"), (None, None)])
def test_format_size_like_printf(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size).cast("bigint"), "T")) == shown


def test_tags(spark):
    f = lambda *t: one(spark, text.normalize_tags(F.array(*map(F.lit, t))))
    assert f(" Go ", "x-1") == ["go", "x-1"]
    assert f("a", "A") is None and f("a b") is None and f(*map(str, range(9))) is None


def test_integrity(spark):
    assert one(spark, text.integrity_checksum(F.lit("sha256-AAAA sha512-/w=="))) == "sha512:ff"
    assert one(spark, text.integrity_checksum(F.lit("md5-AAAA"))) is None


def test_overlap(spark):
    f = lambda a, b: one(spark, text.paths_overlap(F.lit(a), F.lit(b)))
    assert f("a/b", "a") and f("a", "a/b") and f(".", "z") and f("a", "a")
    assert not f("ab", "a") and not f("a/b", "a/c")


def test_generated_go(spark):
    f = lambda s: one(spark, text.generated_go(F.lit(s)))
    assert f("// Code generated by x. DO NOT EDIT.\n\npackage a\n")
    assert not f("package a\n// Code generated by x. DO NOT EDIT.\n")


def test_slug_and_runtime(spark):
    assert one(spark, text.slug(F.lit("  Fix: THE bug!! "))) == "fix-the-bug"
    assert one(spark, text.slug(F.lit("***"))) == "entry"
    assert one(spark, text.slug(F.lit("a" * 39 + " b"))) == "a" * 39
    assert one(spark, text.runtime_of_client(F.lit("Codex CLI"))) == "codex"


def test_fence_and_remote(spark):
    assert one(spark, text.fence_for(F.lit("a ```` b"))) == "`" * 5
    assert one(spark, text.fence_for(F.lit("a"))) == "```"
    assert one(spark, text.sanitize_remote(F.lit("https://u:p@h/x"))) == "https://h/x"
    assert one(spark, text.sanitize_remote(F.lit("git@h:x"))) == "git@h:x"


def test_ignore_rules():
    r = paths.IgnoreRules()
    r.add("", "*.log\n!keep.log\n/top\nlogs/\n# c\ndoc/**\n\\#x\n")
    r.add("sub", "only\n/here.txt\n!*.log")
    assert r.ignored("a.log") and not r.ignored("keep.log") and r.ignored("top") and not r.ignored("a/top")
    assert r.ignored("x/logs/file") and not r.ignored("logs") and r.ignored("doc/a/b") and r.ignored("#x")
    assert r.ignored("sub/a/only") and not r.ignored("only") and r.ignored("sub/here.txt") and not r.ignored("sub/x/here.txt") and not r.ignored("sub/a.log")
    r.add("", "!x/logs/file")
    assert r.ignored("x/logs/file"), "content of a pruned directory cannot come back"


def test_normalize_paths():
    assert paths.normalize_paths(["b/./c", "a//x", "b/c"]) == ["a/x", "b/c"]
    for bad in (["../x"], ["/abs"], [""], []):
        with pytest.raises(ValueError):
            paths.normalize_paths(bad)


MD = """---
id: REQ-1
title: Thing
status: accepted
related: [ADR-1]
collection: requirements
---
# Top

| a | [src](../src/auth.go#L7) |

```
# not a heading
[no](x.md)
```

Second
------

[out](https://x.y) [up](../../etc) [t](../tests/a.go)
"""


def test_markdown():
    p = markdown.parse("docs/req.md", MD)
    assert p.metadata["id"] == "REQ-1" and p.metadata["related"] == ["ADR-1"] and p.body_line == 8
    assert [(h.level, h.title, h.start_line, h.end_line) for h in p.headings] == [(1, "Top", 8, 20), (2, "Second", 17, 20)]
    assert p.links == [("../src/auth.go#L7", "src/auth.go", "L7", "source", 10), ("../tests/a.go", "tests/a.go", "", "test", 20)]
    assert p.diagnostics == [("link_outside_project", "Local link escapes the project root")]
    assert [(a, b, t) for a, b, t, _ in markdown.markdown_sections(MD)] == [(0, 7, ""), (7, 16, "Top"), (16, 20, "Top > Second")]


def test_go_sections():
    lines = ["// Package a does.", "package a", "", "import (", '\t"fmt"', ")", "", "// F does.", "func F() {", '\tfmt.Println("}")', "}", "", "type T struct{}", "", "func (t T) M() {}"]
    got = [(a + 1, b, t) for a, b, t, _ in markdown.go_sections(lines)]
    assert got == [(8, 11, "F"), (13, 13, "T"), (15, 15, "M")]


def test_note_sections():
    notes = "# Title\n<!-- c\n## no -->\nintro\n## A\nx\n```\n## inside\n```\n## Empty\n\n## B\ny"
    assert markdown.note_sections(notes) == [("", "intro"), ("A", "x\n```\n## inside\n```"), ("B", "y")]


def test_windows_of_limits():
    lines = ["x" * 10] * 200 + ["é" * 20000] + ["tail"]
    got = list(windows_of(lines, 0, len(lines)))
    assert all(len(c.encode()) <= MAX_BYTES and b - a < 80 for a, b, c in got)
    assert "".join(c.replace("\n", "") for _, _, c in got) == "".join(lines)


def test_templates(spark):
    """Branches, loops, trim marks, places of every piece, and refused templates."""
    import pytest
    from pyspark.sql import functions as F

    from scriptorium.functions.templates import Template, TemplateError, render

    rows = [("Ann", ["b", " C "], 3, (True, None), "x"), ("", [], 0, (False, "n"), None)]
    df = spark.createDataFrame(rows, "name string, tags array<string>, n int, at struct<ok: boolean, note: string>, raw string")
    show = lambda *t: [r.rendered.content for r in render(df, *[(f"t{i}", x) for i, x in enumerate(t)]).collect()]
    assert show("{{ .name }}|{{ .n }}|{{ .raw }}|{{ .at.ok }}|{{ .at.note }}") == ["Ann|3|x|true|<no value>", "|0|<no value>|false|n"]
    assert show("{{ if .name }}a{{ else if .at.ok }}b{{ else }}c{{ end }}") == ["a", "c"]
    assert show("{{ range .tags }}[{{ . | trim | lower }}]{{ else }}none{{ end }}", "{{ with .at }}{{ .note }}{{ end }}") == ["[b][c]<no value>", "nonen"]
    assert show('a  {{- /* gone */ -}}  b {{ join .tags ", " | upper }} {{ len .tags }}{{ len "é" }}') == ["ab B,  C  22", "ab  02"]
    assert show('{{ if and .name (eq .n 3) }}y{{ end }}{{ if or .raw (not .name) }}z{{ end }}{{ if ne .name "Ann" }}w{{ end }}') == ["yz", "zw"]
    assert show("{{ `raw }} {{` }}") == ["raw }} {{"] * 2 and show("") == ["", ""] and show("plain") == ["plain"] * 2
    got = render(df, ("head", "one\n{{ .name }}\n"), ("body", "{{ range .tags }}\n<{{ . }}>{{ end }}")).where(F.col("name") == "Ann").first().rendered
    spans = [(got.content[s.start : s.end], s.source, s.line) for s in got.spans]
    assert spans == [("one\n", "head", 1), ("Ann", "head", 2), ("\n", "head", 2), ("\n<", "body", 1), ("b", "body", 2), (">", "body", 2), ("\n<", "body", 1), (" C ", "body", 2), (">", "body", 2)]
    for bad in ("{{ .gone }}", "{{ if .name }}", "{{ end }}", "{{ else }}", "{{ lower .n }}", "{{ .tags }}", "{{ . }}", "{{ .name | }}", "{{ }}", "a {{ .name", "{{ range .name }}{{ end }}", "{{ x .n }}", "{{ (.n }}"):
        with pytest.raises(TemplateError, match="t0?:1"):
            Template(("t", bad)).column(df.schema)
