"""Locked artefacts from a mirror, as a Python data source with one partition for each.

A mirror is a folder that all machines mount, filled by whoever may reach the
network:

    git/<repository>/refs.json              {"main": "<commit>", ...}
    git/<repository>/<commit>/...           the tree of that commit
    http/<name>                             a file or an archive
    npm/<package>/package.json              {"name", "dist-tags": {tag: version}, "versions": {version: {"version", "dist": {"tarball", "integrity"}}}}
    npm/<package>/<tarball>                 an archive with a `package/` folder

Each task resolves its artefact's ref or tag, holds it against what is locked
and against its checksum, and only then gives rows: (id, resolved, sha256,
path, size, content), one for each file. A pin that does not hold stops the
job, with the artefact's id.

Names of repositories and packages are quoted like a URL's path, so none leaves
its folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import posixpath
import re
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, resolved string, sha256 string, path string, size bigint, content binary"
#: Limits of a fetched tree.
MAX_FILES, MAX_BYTES, MAX_DOWNLOAD = 10_000, 256 << 20, 64 << 20
_COMMIT = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")
_VERSION = re.compile(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?")
_STRENGTH = ("sha512", "sha384", "sha256")


class PinError(ValueError):
    """What the mirror holds is not what is asked for or locked."""


def _integrity(value: str, data: bytes) -> None:
    """The strongest digest of an integrity list must be that of the data."""
    given = dict(part.split("?")[0].split("-", 1) for part in reversed(value.split()) if "-" in part)
    kind = next((k for k in _STRENGTH if k in given), None)
    if kind is None:
        raise PinError("no integrity digest of a known kind")
    if base64.b64encode(hashlib.new(kind, data).digest()).decode() != given[kind]:
        raise PinError(f"{kind} integrity does not match")


def _checked(files: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Files with clean paths that occur once, within the limits of a tree."""
    seen, total = set(), 0
    for path, data in files:
        if path.startswith("/") or "\\" in path or posixpath.normpath(path) != path or path.split("/")[0] == "..":
            raise PinError(f"unsafe path {path!r}")
        if path.lower() in seen:
            raise PinError(f"path {path!r} occurs twice")
        seen.add(path.lower())
        total += len(data)
        if len(seen) > MAX_FILES or total > MAX_BYTES:
            raise PinError(f"a tree may hold {MAX_FILES} files and {MAX_BYTES} bytes")
        yield path, data


def _unpacked(data: bytes, prefix: str = "") -> Iterator[tuple[str, bytes]]:
    """Files of a tar or zip archive, below prefix; links and special files are refused."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                mode = info.external_attr >> 16
                if not info.is_dir():
                    if mode and not stat.S_ISREG(mode):
                        raise PinError(f"{info.filename!r} is no plain file")
                    if info.file_size > MAX_BYTES:
                        raise PinError(f"{info.filename!r} is too large")
                    yield from _below(info.filename, z.read(info), prefix)
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.isdir():
                continue
            if not m.isreg():
                raise PinError(f"{m.name!r} is no plain file")
            if m.size > MAX_BYTES:
                raise PinError(f"{m.name!r} is too large")
            yield from _below(m.name, t.extractfile(m).read(), prefix)


def _below(name: str, data: bytes, prefix: str) -> Iterator[tuple[str, bytes]]:
    name = name.removeprefix("./")
    if name.startswith(prefix):
        yield name.removeprefix(prefix), data


def _bounded(path: Path) -> bytes:
    if not path.is_file():
        raise PinError(f"the mirror has no {path.name}")
    if path.stat().st_size > MAX_DOWNLOAD:
        raise PinError(f"{path.name} is larger than {MAX_DOWNLOAD} bytes")
    return path.read_bytes()


def _git(mirror: Path, a: dict) -> tuple[str, str | None, Iterator[tuple[str, bytes]]]:
    home = mirror / "git" / quote(a["url"], safe="")
    commit = a.get("locked", {}).get("commit")
    if not commit:
        refs = json.loads(_bounded(home / "refs.json"))
        commit = a["ref"] if _COMMIT.fullmatch(a["ref"]) else refs.get(a["ref"])
    if not commit or not _COMMIT.fullmatch(commit):
        raise PinError(f"ref {a.get('ref')!r} is no commit of the mirror")
    top = home / commit
    if not top.is_dir():
        raise PinError(f"the mirror has no commit {commit}")

    def walk() -> Iterator[tuple[str, bytes]]:
        for p in sorted(top.rglob("*")):
            if p.is_symlink():
                raise PinError(f"{p.relative_to(top).as_posix()!r} is a link")
            if p.is_file():
                yield p.relative_to(top).as_posix(), p.read_bytes()

    return commit, None, walk()


def _http(mirror: Path, a: dict) -> tuple[str, str | None, Iterator[tuple[str, bytes]]]:
    data = _bounded(mirror / "http" / quote(a["url"], safe=""))
    got, pin = hashlib.sha256(data).hexdigest(), a.get("locked", {}).get("sha256") or a.get("sha256")
    if not pin:
        raise PinError("an http source needs a sha256")
    if got != pin:
        raise PinError(f"sha256 is {got}, not {pin}")
    if a.get("archive"):
        return a["url"], got, _unpacked(data)
    return a["url"], got, iter([(a["url"].rstrip("/").rpartition("/")[2] or "index", data)])


def _npm(mirror: Path, a: dict) -> tuple[str, str | None, Iterator[tuple[str, bytes]]]:
    home = mirror / "npm" / quote(a["package"], safe="")
    meta = json.loads(_bounded(home / "package.json"))
    locked = a.get("locked", {})
    version = locked.get("version") or (a["version"] if _VERSION.fullmatch(a["version"]) else meta.get("dist-tags", {}).get(a["version"]))
    if version is None:
        raise PinError(f"dist-tag {a['version']!r} is missing")
    found = meta.get("versions", {}).get(version)
    if meta.get("name") != a["package"] or not found or found.get("version") != version or not _VERSION.fullmatch(version):
        raise PinError(f"metadata of {a['package']}@{version} is missing or inconsistent")
    data = _bounded(home / quote(found["dist"]["tarball"].rpartition("/")[2], safe=""))
    _integrity(locked.get("integrity") or found["dist"].get("integrity", ""), data)
    got = hashlib.sha256(data).hexdigest()
    if locked.get("sha256", got) != got:
        raise PinError(f"sha256 is {got}, not {locked['sha256']}")
    return version, got, _unpacked(data, "package/")


_ADAPTERS = {"git": _git, "http": _http, "npm": _npm}


class _Artifact(InputPartition):
    def __init__(self, entry: dict):
        self.entry = entry


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.mirror, self.entries = options["path"], json.loads(options["artifacts"])
        ids = [a.get("id") for a in self.entries]
        if len(set(ids)) < len(ids) or not all(ids):
            raise ValueError("artefacts need ids that differ")
        for a in self.entries:
            if a.get("type") not in _ADAPTERS:
                raise ValueError(f"{a['id']}: unknown type {a.get('type')!r}")

    def partitions(self):
        return [_Artifact(a) for a in self.entries]

    def read(self, partition):
        a = partition.entry
        try:
            resolved, sha, files = _ADAPTERS[a["type"]](Path(self.mirror), a)
            for path, data in _checked(files):
                yield a["id"], resolved, sha, path, len(data), data
        except (PinError, OSError, KeyError, tarfile.TarError, zipfile.BadZipFile, json.JSONDecodeError) as e:
            raise ValueError(f"{a['id']}: {e}") from e


class Mirror(DataSource):
    """format("mirror"): `path` of the mirror, `artifacts` as a JSON list of {id, type, url | package, ref | version, sha256, archive, locked}."""

    @classmethod
    def name(cls):
        return "mirror"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def fetch(spark: SparkSession, mirror: str, artifacts: list[dict]) -> DataFrame:
    """The files of all artefacts."""
    spark.dataSource.register(Mirror)
    return spark.read.format("mirror").option("path", mirror).option("artifacts", json.dumps(artifacts)).load()
