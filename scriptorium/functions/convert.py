"""Converters of page formats to Markdown: HTML, and the JSON tree of a page editor (ADF).

Recursive trees have no column expression, so each converter is a plain
function and an Arrow UDF around it (Arrow batches). X1: `register` makes the
converters callable by name from SQL.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "form", "dl", "address", "body", "html"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Stands for a hard line break until a block is complete.
_BREAK = "\x00"
_HIDDEN = {"script", "style", "head", "noscript", "template", "iframe", "svg"}


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """Lenient tree: an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr", "td", "th", "dt", "dd") or tag in _BLOCKS:
            closes = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ("p",))
            stops = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr",), "th": ("tr",)}.get(tag, ("div", "section", "li", "td", "th", "blockquote", "root"))
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in stops:
                    break
                if self.open[k].tag in closes:
                    del self.open[k:]
                    break
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _escape(s: str) -> str:
    s = re.sub(r"([\\`*_\[\]])", r"\\\1", s)
    return re.sub(r"^(\s*)([#>+-]|\d+\.)(?=\s)", r"\1\\\2", s)


def _fence(s: str, least: int) -> str:
    return "`" * max(least, max((len(r) + 1 for r in re.findall("`+", s)), default=0))


def _code_span(s: str) -> str:
    f = _fence(s, 1)
    pad = " " if s.startswith("`") or s.endswith("`") else ""
    return f"{f}{pad}{s}{pad}{f}" if s else ""


def _wrap(mark: str, s: str) -> str:
    """Marks hug the text: outer spaces move outside."""
    core = s.strip()
    return s if not core else s[: len(s) - len(s.lstrip())] + mark + core + mark + s[len(s.rstrip()) :]


class _Html:
    def text(self, node: _Node) -> str:
        return "".join(c if isinstance(c, str) else self.text(c) for c in node.children)

    def inline(self, children) -> str:
        out = ""
        for c in children:
            if isinstance(c, str):
                out += _escape(re.sub(r"\s+", " ", c))
            elif c.tag in _HIDDEN:
                continue
            elif c.tag in ("strong", "b"):
                out += _wrap("**", self.inline(c.children))
            elif c.tag in ("em", "i"):
                out += _wrap("*", self.inline(c.children))
            elif c.tag in ("del", "s", "strike"):
                out += _wrap("~~", self.inline(c.children))
            elif c.tag in ("code", "kbd", "samp", "tt"):
                out += _code_span(re.sub(r"\s+", " ", self.text(c)))
            elif c.tag == "br":
                out += _BREAK
            elif c.tag == "img":
                alt, src = c.attrs.get("alt", ""), c.attrs.get("src", "")
                out += f"![{_escape(alt)}]({self._target(src, c.attrs.get('title', ''))})" if src else ""
            elif c.tag == "a":
                label, href = self.inline(c.children).strip(), c.attrs.get("href", "")
                out += f"[{label}]({self._target(href, c.attrs.get('title', ''))})" if href and label else label
            else:
                out += self.inline(c.children)
        return re.sub(r"(?<=[^ \n]) +(?= )", "", out)

    @staticmethod
    def _target(href: str, title: str) -> str:
        href = f"<{href}>" if re.search(r"[\s()]", href) else href
        return f'{href} "{title}"' if title else href

    def blocks(self, children) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush():
            if s := re.sub(rf" *{_BREAK} *", _BREAK, self.inline(run)).strip(" \n" + _BREAK):
                out.append(s.replace(_BREAK, "  \n"))
            run.clear()

        for c in children:
            if isinstance(c, str) or c.tag not in _BLOCKS and c.tag not in ("li", "dt", "dd", "tr", "tbody", "thead"):
                if isinstance(c, str) or not any(not isinstance(x, str) and x.tag in _BLOCKS for x in c.children):
                    run.append(c)
                    continue
            flush()
            if c.tag in _HIDDEN:
                continue
            out.extend(self.block(c))
        flush()
        return out

    def block(self, c: _Node) -> list[str]:
        if re.fullmatch("h[1-6]", c.tag):
            title = re.sub(rf"[\s{_BREAK}]+", " ", self.inline(c.children)).strip()
            return ["#" * int(c.tag[1]) + " " + title] if title else []
        if c.tag == "hr":
            return ["* * *"]
        if c.tag == "pre":
            code = self.text(c).strip("\n")
            inner = next((x for x in c.children if not isinstance(x, str) and x.tag == "code"), c)
            language = next((m[1] for k in inner.attrs.get("class", "").split() if (m := re.match(r"lang(?:uage)?-(\S+)", k))), "")
            f = _fence(code, 3)
            return [f"{f}{language}\n{code}\n{f}"]
        if c.tag == "blockquote":
            inner = "\n\n".join(self.blocks(c.children))
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        if c.tag in ("ul", "ol"):
            number = int(c.attrs["start"]) if c.tag == "ol" and c.attrs.get("start", "").isdigit() else 1
            rows = []
            for item in (x for x in c.children if not isinstance(x, str) and x.tag == "li"):
                mark = "- " if c.tag == "ul" else f"{number}. "
                number += 1
                parts = self.blocks(item.children)
                nested = [not isinstance(x, str) and x.tag in ("ul", "ol") for x in item.children]
                inner = ("\n" if any(nested) and len(parts) == 1 + sum(nested) else "\n\n").join(parts)
                rows.append(mark + inner.replace("\n", "\n" + " " * len(mark)).replace("\n" + " " * len(mark) + "\n", "\n\n"))
            return ["\n".join(rows)] if rows else []
        if c.tag == "table":
            return self.table(c)
        return self.blocks(c.children)

    def table(self, c: _Node) -> list[str]:
        rows: list[tuple[list[str], bool]] = []

        def walk(node):
            for x in node.children:
                if isinstance(x, str):
                    continue
                if x.tag == "tr":
                    cells = [y for y in x.children if not isinstance(y, str) and y.tag in ("td", "th")]
                    values = []
                    for y in cells:
                        values.append(re.sub(r"\s*\n\s*", " ", " ".join(self.blocks(y.children))).replace("|", "\\|").strip())
                        values += [""] * (int(y.attrs.get("colspan", "1")) - 1 if y.attrs.get("colspan", "1").isdigit() else 0)
                    rows.append((values, bool(cells) and all(y.tag == "th" for y in cells)))
                elif x.tag != "table":
                    walk(x)

        walk(c)
        return [grid([r for r, _ in rows], bool(rows) and rows[0][1])] if rows else []


def grid(rows: list[list[str]], header: bool) -> str:
    """A pipe table with one space around cells; without a header row an empty one is made."""
    width = max(len(r) for r in rows)
    rows = [r + [""] * (width - len(r)) for r in rows]
    head, body = (rows[0], rows[1:]) if header else ([""] * width, rows)
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(head), "|" + " --- |" * width, *map(line, body)])


def html_to_markdown(html: str) -> str:
    """Trimmed Markdown with one newline at the end; empty input gives the newline."""
    tree = _Tree()
    tree.feed(html.replace(_BREAK, "\ufffd"))
    tree.close()
    return "\n\n".join(_Html().blocks(tree.root.children)).strip() + "\n"


class _Adf:
    """Block and inline nodes of a page tree."""

    _MARKS = (("strong", "**"), ("em", "*"), ("strike", "~~"))

    def blocks(self, nodes) -> list[str]:
        return [s for n in nodes or [] if (s := self.block(n))]

    def block(self, n: dict) -> str:
        kind, attrs, inner = n.get("type", ""), n.get("attrs") or {}, n.get("content") or []
        if kind == "paragraph":
            s = self.inline(inner)
            level = next((int((m.get("attrs") or {}).get("level", 1)) for m in n.get("marks") or [] if m.get("type") == "indentation"), 0)
            return "\n".join("> " * level + x for x in s.split("\n")) if s.strip() else ""
        if kind == "heading":
            return "#" * max(1, min(6, int(attrs.get("level", 1)))) + " " + re.sub(r"\s*\n\s*", " ", self.inline(inner)).strip()
        if kind == "rule":
            return "---"
        if kind == "codeBlock":
            code = "".join(x.get("text", "") for x in inner)
            f = _fence(code, 3)
            return f"{f}{attrs.get('language') or ''}\n{code}\n{f}"
        if kind in ("blockquote", "panel"):
            return self._quote("\n\n".join(self.blocks(inner)))
        if kind == "bulletList":
            return self._list(inner, lambda i, _: "- ")
        if kind == "orderedList":
            first = int(attrs.get("order", 1) or 1)
            return self._list(inner, lambda i, _: f"{first + i}. ")
        if kind == "taskList":
            return self._list(inner, lambda i, x: f"- [{'x' if (x.get('attrs') or {}).get('state') == 'DONE' else ' '}] ")
        if kind == "decisionList":
            return self._list(inner, lambda i, x: "- ")
        if kind == "table":
            return self._table(inner)
        if kind in ("expand", "nestedExpand"):
            title = attrs.get("title") or ""
            return "\n\n".join(filter(None, [f"**{_escape(title)}**" if title else "", *self.blocks(inner)]))
        if kind in ("mediaSingle", "mediaGroup"):
            media = [self._media(x) for x in inner if x.get("type") == "media"]
            captions = [self.inline(x.get("content") or []) for x in inner if x.get("type") == "caption"]
            return "\n\n".join(filter(None, [*media, *(_wrap("*", c) for c in captions)]))
        if kind in ("extension", "bodiedExtension", "inlineExtension"):
            return "\n\n".join(self.blocks(inner)) or f"[macro: {attrs.get('extensionKey', 'unknown')}]"
        if kind in ("blockCard", "embedCard"):
            url = attrs.get("url") or ""
            return f"<{url}>" if url else ""
        if inner and any(x.get("type") in ("text", "hardBreak", "mention", "emoji") for x in inner):
            return self.inline(inner)
        return "\n\n".join(self.blocks(inner))

    @staticmethod
    def _quote(s: str) -> str:
        return "\n".join(f"> {x}".rstrip() for x in s.split("\n")) if s else ""

    def _list(self, items, mark) -> str:
        rows = []
        position = 0
        for item in items:
            if item.get("type") in ("taskList", "bulletList", "orderedList"):
                if rows:
                    rows[-1] += "\n  " + self.block(item).replace("\n", "\n  ")
                continue
            m = mark(position, item)
            position += 1
            content = item.get("content") or []
            parts = [self.inline(content)] if item.get("type") in ("taskItem", "decisionItem") else self.blocks(content)
            indent = " " * (2 if m.startswith("- ") else len(m))
            tight = all(x.get("type") in ("paragraph", "bulletList", "orderedList", "taskList", "text") for x in content) and sum(x.get("type") == "paragraph" for x in content) <= 1
            body = ("\n" if tight else "\n\n").join(parts)
            rows.append(m + re.sub(r"\n(?=.)", "\n" + indent, body))
        return "\n".join(rows)

    def _table(self, rows) -> str:
        out, head = [], False
        for k, row in enumerate(rows):
            cells, kinds = [], []
            for cell in row.get("content") or []:
                value = "<br>".join(x.replace("\n", "<br>") for x in self.blocks(cell.get("content"))).replace("|", "\\|")
                cells += [value] + [""] * (int((cell.get("attrs") or {}).get("colspan", 1) or 1) - 1)
                kinds.append(cell.get("type") == "tableHeader")
            head = head or k == 0 and bool(kinds) and all(kinds)
            out.append(cells)
        return grid(out, head) if out and max(map(len, out)) else ""

    @staticmethod
    def _media(n: dict) -> str:
        a = n.get("attrs") or {}
        alt = _escape(a.get("alt") or "")
        return f"![{alt}]({a['url']})" if a.get("url") else f"[media: {alt or a.get('id', 'file')}]"

    def inline(self, nodes) -> str:
        runs: list[list] = []
        for n in nodes or []:
            marks = {m.get("type"): m.get("attrs") or {} for m in n.get("marks") or []}
            if n.get("type") == "text":
                key = json.dumps(marks, sort_keys=True)
                if runs and runs[-1][0] == key:
                    runs[-1][2] += n.get("text", "")
                else:
                    runs.append([key, marks, n.get("text", "")])
            else:
                runs.append([None, {}, self._atom(n)])
        return "".join(s if key is None else self._marked(marks, s) for key, marks, s in runs)

    def _marked(self, marks: dict, s: str) -> str:
        out = _code_span(s) if "code" in marks else _escape(s)
        for kind, mark in self._MARKS:
            if kind in marks and (kind != "strong" or out.strip()):
                out = _wrap(mark, out)
        href = marks.get("link", {}).get("href")
        if href:
            core = out.strip()
            out = out.replace(core, f"[{core}]({_Html._target(href, marks['link'].get('title') or '')})", 1) if core else out
        return out

    def _atom(self, n: dict) -> str:
        kind, a = n.get("type"), n.get("attrs") or {}
        if kind == "hardBreak":
            return "  \n"
        if kind == "date":
            return dt.datetime.fromtimestamp(int(a.get("timestamp", 0)) / 1000, dt.timezone.utc).date().isoformat()
        if kind in ("mention", "emoji", "status", "placeholder"):
            s = a.get("text") or a.get("shortName") or ""
            return f"`{s}`" if kind == "status" and s else _escape(s) if kind != "emoji" else s
        if kind == "inlineCard":
            return f"<{a['url']}>" if a.get("url") else ""
        if kind in ("media", "mediaInline"):
            return self._media(n)
        if kind == "inlineExtension":
            return f"[macro: {a.get('extensionKey', 'unknown')}]"
        return self.inline(n.get("content"))


def adf_to_markdown(tree: str) -> str:
    """A JSON document node to Markdown, trimmed, with one newline at the end."""
    node = json.loads(tree)
    if not isinstance(node, dict) or node.get("type") != "doc":
        raise ValueError("the root must be a doc node")
    return "\n\n".join(_Adf().blocks(node.get("content"))).strip() + "\n"


def with_page_title(tree: str, title: str) -> str:
    """The page title as a first heading of the tree."""
    node = json.loads(tree)
    node["content"] = [{"type": "heading", "attrs": {"level": 1}, "content": [{"type": "text", "text": title}]}, *(node.get("content") or [])]
    return json.dumps(node)


def _adf_or_null(tree: str) -> str | None:
    try:
        return adf_to_markdown(tree)
    except ValueError:
        return None


CONVERTERS = {"html-to-markdown": html_to_markdown, "adf-to-markdown": _adf_or_null}


#: Texts that are Python strings at once; a batch's other texts stay in Arrow.
_AT_ONCE = 64


def column_udf(name: str):
    """An Arrow UDF of a registered converter; null stays null. A task holds its Arrow batch and result, and few texts as Python strings."""
    one = CONVERTERS[name]

    def run(values: pa.Array) -> pa.Array:
        pieces = [values.slice(at, _AT_ONCE) for at in range(0, len(values), _AT_ONCE)]
        done = [pa.array([None if s is None else one(s) for s in piece.to_pylist()], pa.string()) for piece in pieces]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return F.arrow_udf(run, "string")


def register(spark: SparkSession) -> None:
    """`html_to_markdown` and `adf_to_markdown` in SQL."""
    for name in CONVERTERS:
        spark.udf.register(name.replace("-", "_"), column_udf(name))
