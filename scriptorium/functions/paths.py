"""Path cleaning and ignore rules; sequential by nature, so plain Python used inside Arrow batches."""

from __future__ import annotations

import posixpath
import re
from functools import lru_cache


def clean(path: str) -> str:
    """Lexically shortest form, with forward slashes."""
    out = posixpath.normpath(path.replace("\\", "/")) if path else "."
    return out[1:] if out.startswith("//") else out


def normalize_paths(paths: list[str], most: int = 100, most_bytes: int = 16 * 1024) -> list[str]:
    """P20: relative cleaned paths inside the project, distinct and sorted."""
    if not 1 <= len(paths) <= most or sum(len(p.encode()) for p in paths) > most_bytes:
        raise ValueError(f"1 to {most} paths of at most {most_bytes} bytes together")
    out = set()
    for p in paths:
        c = clean(p)
        if not p.strip() or c.startswith("/") or c == ".." or c.startswith("../"):
            raise ValueError(f"path {p!r} is outside the project")
        out.add(c)
    return sorted(out)


@lru_cache(maxsize=4096)
def _compiled(glob: str) -> re.Pattern:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return re.compile(out + r"\Z", re.S)


class IgnoreRules:
    """Ignore files of nested directories. The last rule that fits decides; a pruned directory's content cannot come back."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, bool, bool, str]] = []

    def add(self, domain: str, text: str) -> None:
        for line in text.split("\n"):
            line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            if line.endswith("/**"):
                line += "/*"
            anchored = "/" in line
            line = line.lstrip("/")
            if line:
                self.rules.append((domain.strip("/"), negated, only_dirs, line if anchored else f"**/{line}"))

    def rows(self) -> list[tuple[int, str, bool, bool, str]]:
        """(ordinal, domain, negated, only_dirs, pattern) of every rule; a pattern fits a whole path below the domain."""
        return [(n, domain, negated, only_dirs, f"(?s)^{_compiled(glob).pattern.removesuffix(chr(92) + 'Z')}$") for n, (domain, negated, only_dirs, glob) in enumerate(self.rules)]

    def _one(self, path: str, is_dir: bool) -> bool:
        for domain, negated, only_dirs, glob in reversed(self.rules):
            if domain and not path.startswith(domain + "/"):
                continue
            if only_dirs and not is_dir:
                continue
            if _compiled(glob).match(path[len(domain) + 1 :] if domain else path):
                return not negated
        return False

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return any(self._one("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._one(path, is_dir)
