"""Strict YAML manifests and locks, archives, and YAML helpers; small driver-side files turned into tables."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 4 << 20
SOURCE_FIELDS = ("type", "url", "ref", "sha256", "package", "version", "registry", "page", "auth")
FIELDS = {"source": SOURCE_FIELDS, "file": ("from", "to", "converter"), "directory": ("from", "to"), "resolved": ("url", "commit", "version", "revision", "integrity", "sha256")}


class _Strict(yaml.SafeLoader):
    """No aliases, no repeated keys; scalars are text."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.events.AliasEvent):
            raise yaml.YAMLError("aliases are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise yaml.YAMLError("a key is repeated")
        return super().construct_mapping(node, deep)


def strict_load(data: str) -> dict:
    """Exactly one document, a mapping, of strings only."""
    if len(data.encode()) > MAX_BYTES:
        raise ValueError("more than 4 MiB")
    try:
        found = list(yaml.load_all(data, Loader=_Strict))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e
    if len(found) != 1 or not isinstance(found[0], dict):
        raise ValueError("exactly one document, a mapping, is needed")

    def only_text(node, at):
        if isinstance(node, dict):
            for k, v in node.items():
                only_text(v, f"{at}.{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                only_text(v, f"{at}[{i}]")
        elif not isinstance(node, str):
            raise ValueError(f"{at[1:]} must be text")

    only_text(found[0], "")
    return found[0]


def _known(node: dict, fields: tuple[str, ...], what: str) -> dict:
    if extra := set(node) - set(fields):
        raise ValueError(f"unknown field {sorted(extra)[0]!r} in {what}")
    return node


def manifest(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    """sources (id, ...) and mappings (id, from, to, converter, directory) of a manifest."""
    root = _known(strict_load(data), ("dependencies",), "manifest")
    sources, mappings = [], []
    for name, d in (root.get("dependencies") or {}).items():
        _known(d, ("source", "files", "directories"), name)
        s = _known(d.get("source") or {}, FIELDS["source"], f"{name}.source")
        sources.append((name, *(s.get(f, "") for f in SOURCE_FIELDS)))
        for kind in ("file", "directory"):
            for m in d.get("files" if kind == "file" else "directories") or []:
                _known(m, FIELDS[kind], f"{name}.{kind}")
                mappings.append((name, m.get("from", ""), m.get("to", ""), m.get("converter", ""), kind == "directory"))
    return {
        "sources": spark.createDataFrame(sources, "id string, " + ", ".join(f"{f} string" for f in SOURCE_FIELDS)),
        "mappings": spark.createDataFrame(mappings, "id string, `from` string, `to` string, converter string, directory boolean"),
    }


def lock(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    """resolved (id, ...) and files (id, path, hash) of a lock."""
    root = _known(strict_load(data), ("manifest", "dependencies"), "lock")
    resolved, files = [], []
    for name, d in (root.get("dependencies") or {}).items():
        r = _known(d.get("resolved") or {}, FIELDS["resolved"], f"{name}.resolved")
        resolved.append((name, *(r.get(f, "") for f in FIELDS["resolved"])))
        files += [(name, p, h) for p, h in (d.get("files") or {}).items()]
    return {
        "resolved": spark.createDataFrame(resolved, "id string, " + ", ".join(f"{f} string" for f in FIELDS["resolved"])),
        "files": spark.createDataFrame(files, "id string, path string, hash string"),
    }


def marshal_lock(digest: str, dependencies: dict) -> str:
    """Canonical YAML, 4 MiB at most."""
    out = yaml.safe_dump({"manifest": digest, "dependencies": dependencies}, sort_keys=True, default_flow_style=False, allow_unicode=True)
    if len(out.encode()) > MAX_BYTES:
        raise ValueError("the lock exceeds 4 MiB")
    return out


def omit_empty(node):
    """The tree without nulls, empty texts, and what they leave empty."""
    if isinstance(node, dict):
        return {k: v for k, x in node.items() if (v := omit_empty(x)) not in (None, "", {}, [])}
    if isinstance(node, list):
        return [v for x in node if (v := omit_empty(x)) not in (None, "", {}, [])]
    return node


def yaml_value(value) -> str:
    """A scalar that YAML reads back unchanged."""
    return json.dumps(value, ensure_ascii=False)


def yaml_block(data, drop_empty: bool = False) -> str:
    """A fenced YAML block; the fence is longer than any run of backticks inside."""
    body = yaml.safe_dump(omit_empty(data) if drop_empty else data, sort_keys=False, allow_unicode=True).rstrip("\n")
    longest = max((len(run) for run in "".join(c if c == "`" else " " for c in body).split()), default=0)
    fence = "`" * max(3, longest + 1)
    return f"{fence}yaml\n{body}\n{fence}"


def _members(name: str, data: bytes) -> Iterator[tuple[str, int, bool]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                yield i.filename, i.file_size, (i.external_attr >> 28) == 0o12
    else:
        if name.endswith((".zst", ".zstd")):
            import zstandard

            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                yield m.name, m.size, not (m.isfile() or m.isdir())


def archive_problem(name: str, data: bytes, most_files: int = 10_000, most_bytes: int = 256 << 20) -> str:
    """Why an archive must not be unpacked, or an empty text."""
    seen, total, n = set(), 0, 0
    try:
        for path, size, link in _members(name, data):
            n, total = n + 1, total + size
            clean = path.rstrip("/")
            if n > most_files:
                return "too many entries"
            if total > most_bytes:
                return "too large"
            if link:
                return f"link: {path}"
            if clean.startswith("/") or ".." in clean.split("/") or "\\" in clean:
                return f"outside: {path}"
            if clean.lower() in seen:
                return f"duplicate: {path}"
            seen.add(clean.lower())
    except Exception as e:  # noqa: BLE001  damaged archives of any format
        return f"unreadable: {type(e).__name__}"
    return ""


def inspect_archives(files: DataFrame) -> DataFrame:
    """S18 over (path, content): (path, problem)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "problem": [archive_problem(p, bytes(c)) for p, c in zip(b["path"], b["content"])]})

    return files.select("path", "content").mapInPandas(run, "path string, problem string")


def parse_providers(value: str, supported: list[str]) -> list[str]:
    """A comma list of known, distinct names."""
    names = [n.strip() for n in value.split(",") if n.strip()]
    if unknown := [n for n in names if n not in supported]:
        raise ValueError(f"unknown provider {unknown[0]!r}")
    if len(set(names)) != len(names):
        raise ValueError("a provider is repeated")
    return names


def resolve_variables(text: str, values: dict[str, str]) -> str:
    """${name} by its value; ${{...}} stays as it is; an unknown name is an error."""
    import re

    def one(m: re.Match) -> str:
        if m[0].startswith("${{"):
            return m[0]
        if m[1] not in values:
            raise ValueError(f"unknown variable {m[1]!r}")
        return values[m[1]]

    return re.sub(r"\$\{\{.*?\}\}|\$\{([A-Za-z_][A-Za-z0-9_.]*)\}", one, text, flags=re.S)


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """P33 over (document, name, text): the texts in name order joined by newlines, with the output line on which each begins."""
    part = F.struct("name", "text")
    out = chunks.groupBy("document").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    count = lambda p: F.size(F.split(p["text"], "\n"))
    begins = F.aggregate("parts", F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1)) + count(p))))
    starts = F.concat(F.array(F.lit(1)), F.slice(begins, F.lit(1), F.greatest(F.size(begins) - 1, F.lit(0))))
    return out.select("document", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.arrays_zip(F.transform("parts", lambda p: p["name"]).alias("name"), starts.alias("line")).alias("source_map"))
