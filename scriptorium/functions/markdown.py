"""Markdown and Go structure of one file: front matter, headings, links, sections, note sections.

Line parsers, as no Markdown or Go parser is at hand: fenced code hides
headings and links; ATX and setext headings count; Go declarations are found
at column zero, which is where gofmt puts them.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import yaml

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_LINK = re.compile(r"!?\[(?:[^\]\[]|\[[^\]]*\])*\]\(\s*(<[^>]*>|[^\s)]+)(?:\s+[\"'(][^)]*)?\s*\)")
_REFERENCE = re.compile(r"^ {0,3}\[[^\]]+\]:\s*(<[^>]*>|\S+)")
_COMMENT = re.compile(r"<!--.*?-->", re.S)


@dataclass
class Heading:
    level: int
    title: str
    start_line: int
    end_line: int = 0


@dataclass
class Parsed:
    path: str
    metadata: dict | None = None
    body_line: int = 1
    headings: list[Heading] = field(default_factory=list)
    links: list[tuple[str, str, str, str, int]] = field(default_factory=list)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)
    lines: int = 0


def split_lines(content: str) -> list[str]:
    return content.removesuffix("\n").split("\n") if content else []


def _unfenced(lines: list[str], first: int) -> Iterator[tuple[int, str]]:
    """(index, line) outside fenced code; a fence is closed by a run of its character, as long at least and alone."""
    fence = ""
    for i in range(first, len(lines)):
        m = _FENCE.match(lines[i])
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            continue
        yield i, lines[i]


def front_matter(lines: list[str]) -> tuple[dict | None, int, str]:
    """Metadata, index of the first body line, and an error message."""
    if not lines or lines[0].strip() != "---":
        return None, 0, ""
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if end is None:
        return None, 0, "Front matter is not closed"
    try:
        data = yaml.safe_load("\n".join(lines[1:end])) or {}
    except yaml.YAMLError as e:
        return None, end + 1, f"Front matter is not valid YAML: {str(e).splitlines()[0]}"
    if not isinstance(data, dict):
        return None, end + 1, "Front matter must be a mapping"
    text = lambda k: "" if data.get(k) is None else str(data[k])
    related = data.get("related") or []
    position = data.get("sidebar_position")
    return {
        "id": text("id"), "title": text("title"), "status": text("status"), "date": text("date"), "related": [str(x) for x in related] if isinstance(related, list) else [str(related)],
        "superseded_by": text("superseded_by"), "sidebar_position": position if isinstance(position, int) else 0, "collection": text("collection"),
    }, end + 1, ""


def resolve_link(path: str, target: str) -> tuple[str, str, str] | str | None:
    """(path, fragment, kind) of a local link; a diagnostic code; or None for links to elsewhere."""
    if len(target.encode()) > 4096:
        return "link_too_long"
    try:
        url = urlsplit(target)
    except ValueError:
        return None
    if url.scheme or url.netloc:
        return None
    local = unquote(url.path)
    joined = posixpath.normpath(posixpath.join(posixpath.dirname(path), local)) if local else path
    if local.startswith("/") or joined == ".." or joined.startswith("../") or "\\" in joined:
        return "link_outside_project"
    if posixpath.splitext(joined)[1].lower() in (".md", ".markdown"):
        kind = "document"
    else:
        kind = "test" if joined.endswith("_test.go") or joined.startswith("tests/") else "source"
    return joined, unquote(url.fragment), kind


def parse(path: str, content: str) -> Parsed:
    """P11, P12, P13. Line numbers are those of the file, front matter included."""
    lines = split_lines(content)
    out = Parsed(path, lines=len(lines))
    out.metadata, body, problem = front_matter(lines)
    out.body_line = body + 1
    if problem:
        out.diagnostics.append(("invalid_front_matter", problem))
    paragraph = -2
    for i, line in _unfenced(lines, body):
        atx = _ATX.match(line)
        setext = _SETEXT.match(line)
        if atx:
            out.headings.append(Heading(len(atx[1]), (atx[2] or "").strip(), i + 1))
        elif setext and paragraph == i - 1:
            out.headings.append(Heading(1 if setext[1][0] == "=" else 2, lines[i - 1].strip(), i))
        plain = re.sub(r"(`+)(?:(?!\1).)+\1", "", line)
        for m in [*_LINK.finditer(plain), *filter(None, [_REFERENCE.match(plain)])]:
            target = m[1].strip("<>")
            found = resolve_link(path, target)
            if isinstance(found, tuple):
                out.links.append((target, *found, i + 1))
            elif found:
                out.diagnostics.append((found, "Link target exceeds 4096 bytes" if found == "link_too_long" else "Local link escapes the project root"))
        paragraph = i if line.strip() and not atx and not setext and not line.startswith(("    ", ">", "- ", "* ", "|")) else -2
    for k, h in enumerate(out.headings):
        h.end_line = next((n.start_line - 1 for n in out.headings[k + 1 :] if n.level <= h.level), len(lines))
    return out


def markdown_sections(content: str, path: str = "") -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end exclusive, trail, []): text before the first heading, then each heading up to the next."""
    parsed = parse(path, content)
    at = [h.start_line - 1 for h in parsed.headings]
    first = at[0] if at else parsed.lines
    if first > 0:
        yield 0, first, "", []
    trail: list[tuple[int, str]] = []
    for k, h in enumerate(parsed.headings):
        trail = [t for t in trail if t[0] < h.level] + [(h.level, h.title)]
        yield at[k], at[k + 1] if k + 1 < len(at) else parsed.lines, " > ".join(t for _, t in trail), []


_GO_DECLARATION = re.compile(r"^(?:func\s+(?:\([^)]*\)\s*)?(\w+)|(type|var|const)\s+(\w+)|(type|var|const)\s*\(|(import)\b|(package)\b)")


def go_sections(lines: list[str]) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end exclusive, title, symbols): a section for each top-level declaration with its comment; imports are dropped; gaps that hold comments are kept."""
    starts: list[tuple[int, int, list[str], bool]] = []
    i, n = 0, len(lines)
    while i < n:
        m = _GO_DECLARATION.match(lines[i])
        if not m:
            i += 1
            continue
        end, depth = i, 0
        while end < n:
            bare = re.sub(r'"(?:\\.|[^"\\])*"|`[^`]*`|//.*', "", lines[end])
            depth += bare.count("{") + bare.count("(") - bare.count("}") - bare.count(")")
            end += 1
            if depth <= 0:
                break
        symbols = [m[1] or m[3]] if m[1] or m[3] else []
        if m[4]:
            symbols = [s for x in lines[i + 1 : end - 1] if (s := (re.match(r"\s+(\w+)", x) or [None, None])[1])]
        doc = i
        while doc and lines[doc - 1].startswith("//"):
            doc -= 1
        starts.append((doc, end, symbols, bool(m[5] or m[6])))
        i = end
    if not starts:
        yield 0, n, "", []
        return
    done = 0
    for start, end, symbols, dropped in starts:
        if start > done and any(x.strip().startswith(("//", "/*", "*")) for x in lines[done:start]):
            yield done, start, "", []
        if not dropped:
            yield start, end, symbols[0] if symbols else "", symbols
        done = max(done, end)
    if done < n and any(x.strip().startswith(("//", "/*", "*")) for x in lines[done:]):
        yield done, n, "", []


def sections(path: str, kind: str, language: str, lines: list[str], content: str) -> Iterator[tuple[int, int, str, list[str]]]:
    """Sections of a file by its language; other files are one section."""
    if not lines:
        return
    if language in ("md", "markdown"):
        yield from markdown_sections(content, path)
    elif language == "go":
        yield from go_sections(lines)
    else:
        yield 0, len(lines), "", []


def note_sections(notes: str) -> list[tuple[str, str]]:
    """(heading, text) of the second-level sections outside fenced code; comments, the first title and empty sections are left out."""
    lines = _COMMENT.sub("", notes).split("\n")
    heads = [(i, x) for i, x in _unfenced([x.strip() if x.strip()[:3] in ("```", "~~~") else x for x in lines], 0) if x.startswith(("# ", "## "))]
    cuts = [(i, x[3:].strip()) for i, x in heads if x.startswith("## ")]
    before = cuts[0][0] if cuts else len(lines)
    title = next((i for i, x in heads if x.startswith("# ") and i < before), None)
    out = [("", "\n".join(x for k, x in enumerate(lines[:before]) if k != title).strip())]
    for k, (i, heading) in enumerate(cuts):
        out.append((heading, "\n".join(lines[i + 1 : cuts[k + 1][0] if k + 1 < len(cuts) else len(lines)]).strip()))
    return [s for s in out if s[1]]
