"""Column functions over paths, lines, identifiers and short strings; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENTATION, CODE, CONFIG = "documentation", "code", "config"

# File extensions of each kind.
DOCUMENTATION_EXTENSIONS = ("md", "markdown", "txt", "rst", "adoc")
CONFIG_EXTENSIONS = ("yaml", "yml", "json", "toml", "ini", "env", "mod", "sum")
CODE_EXTENSIONS = ("go", "js", "jsx", "ts", "tsx", "py", "rs", "java", "c", "h", "cpp", "cs", "rb", "php", "sh", "sql", "proto")

# English words that prose analysis drops.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

TOKEN = r"[\p{L}\p{Nd}_]+"
#: Places between the parts of an identifier: case changes, acronym ends and digit runs.
PARTS = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?!\p{Nd}|$)|(?<!\p{Nd}|^)(?=\p{Nd})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: Column | str) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(_col(path), "/"), -1), r"\.([^.]*)$", 1))


def file_kind(path: Column | str) -> Column:
    """struct(kind, language); unknown extensions are configuration text."""
    ext = extension(path)
    kind = F.when(ext.isin(*DOCUMENTATION_EXTENSIONS), DOCUMENTATION).when(ext.isin(*CODE_EXTENSIONS), CODE).otherwise(CONFIG)
    known = ext.isin(*DOCUMENTATION_EXTENSIONS, *CODE_EXTENSIONS, *CONFIG_EXTENSIONS)
    return F.struct(kind.alias("kind"), F.when(known, ext).otherwise("text").alias("language"))


def source_lines(content: Column | str) -> Column:
    """Lines of a text; one trailing newline is dropped and an empty text has no lines."""
    c = _col(content)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\n\z", ""), "\n"))


def tokens(text: Column | str) -> Column:
    """Lower-case words of the identifier analyzer."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(f"({TOKEN})"))


def prose_tokens(text: Column | str) -> Column:
    """Words of the prose analyzer, without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def query_terms(text: Column | str, limit: int = 32) -> Column:
    """Distinct prose words in order, at most `limit`."""
    return F.slice(F.array_distinct(prose_tokens(text)), 1, limit)


def identifier_parts(word: Column) -> Column:
    """Underscore parts, and their case and digit parts, in order."""
    pieces = F.filter(F.split(word, "_+"), lambda p: p != "")
    return F.flatten(F.transform(pieces, lambda p: F.filter(F.split(p, PARTS), lambda q: q != "")))


def expand_word(word: Column) -> Column:
    """The word, then its parts if it has several."""
    parts = identifier_parts(word)
    return F.when(F.size(parts) > 1, F.concat(F.array(word), parts)).otherwise(F.array(word))


def identifier_words(text: Column | str) -> Column:
    """Every word followed by its parts, space-joined."""
    return F.array_join(F.flatten(F.transform(F.regexp_extract_all(_col(text), F.lit(f"({TOKEN})")), expand_word)), " ")


def compound_words(text: Column | str) -> Column:
    """Expansions of the words that have parts."""
    words = F.filter(F.regexp_extract_all(_col(text), F.lit(f"({TOKEN})")), lambda w: F.size(identifier_parts(w)) > 1)
    return F.array_join(F.flatten(F.transform(words, expand_word)), " ")


def utf8_prefix(text: Column | str, limit: int) -> Column:
    """Longest prefix of at most `limit` bytes that ends between characters."""
    c = _col(text)
    data = F.encode(c, "UTF-8")
    cut = lambda n: F.substring(data, 1, n)
    whole = F.coalesce(*[F.try_validate_utf8(cut(max(limit - k, 0)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(c) <= limit, c).otherwise(whole)


def content_hash(content: Column | str) -> Column:
    """P10."""
    return F.sha2(_col(content), 256)


def excerpt_start(lines: Column, terms: list[str]) -> Column:
    """Zero-based first line of the excerpt: two before the first line with a term, or the first line."""
    if not terms:
        return F.lit(0)
    hit = lambda line: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(line), t))
    at = F.array_position(F.transform(lines, hit), True).cast("int")
    return F.when(at > 0, F.greatest(at - 3, F.lit(0))).otherwise(0)


def excerpt(lines: Column, start: Column, count: int = 12) -> Column:
    return F.array_join(F.slice(lines, start + 1, count), "\n")


def slug(title: Column | str, limit: int = 40) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, limit), "-+$", "")
    return F.when(s == "", "entry").otherwise(s)


def entry_id(created: Column, title: Column | str, suffix: Column) -> Column:
    return F.concat_ws("-", F.date_format(created, "yyyyMMdd"), slug(title), suffix)


def normalize_tags(tags: Column | str) -> Column:
    """Trimmed lower-case tags, or null where a tag is malformed, repeated, or there are more than eight."""
    t = F.transform(_col(tags), lambda x: F.lower(F.trim(x)))
    fine = F.forall(t, lambda x: x.rlike(r"^[a-z0-9][a-z0-9-]{0,31}$")) & (F.size(F.array_distinct(t)) == F.size(t)) & (F.size(t) <= 8)
    return F.when(fine, t)


def format_size(size: Column | str, largest: str = "P") -> Column:
    """Bytes with a binary unit up to `largest`, and one decimal; an exact half goes to the even digit, as printf has it."""
    b = _col(size)
    exact = b.cast("double").cast("bigint")
    out = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for k, unit in enumerate("KMGTP", 1):
        low = F.lit(1024**k - 1)
        tail = exact.bitwiseAND(low) * 10
        digit, rest = F.shiftright(tail, 10 * k), tail.bitwiseAND(low) * 2
        up = (rest > 1024**k) | ((rest == 1024**k) & (digit % 2 == 1))
        tenths = F.shiftright(exact, 10 * k) * 10 + digit + up.cast("int")
        scaled = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}iB"))
        if unit == largest:
            return out.otherwise(scaled)
        out = out.when(b < 1024 ** (k + 1), scaled)
    raise ValueError("largest must be one of K, M, G, T and P")


def sanitize_remote(url: Column | str) -> Column:
    """Http addresses without user and password."""
    return F.regexp_replace(_col(url), r"^(https?://)[^/@]*@", "$1")


def integrity_checksum(value: Column | str) -> Column:
    """Strongest digest of a subresource integrity list, as algorithm:hex."""
    items = F.split(F.trim(_col(value)), r"\s+")

    def of(algorithm: str) -> Column:
        return F.get(F.filter(items, lambda x: F.startswith(x, F.lit(f"{algorithm}-"))), F.lit(0))

    picked = F.coalesce(of("sha512"), of("sha384"), of("sha256"))
    raw = F.unbase64(F.regexp_replace(picked, r"^sha\d+-", ""))
    return F.when(picked.isNotNull(), F.concat(F.regexp_extract(picked, r"^(sha\d+)-", 1), F.lit(":"), F.lower(F.hex(raw))))


def go_directive(content: Column | str, name: str) -> Column:
    """Value of the go or toolchain line of a module file."""
    return F.nullif(F.regexp_extract(_col(content), rf"(?m)^\s*{name}\s+(\S+)", 1), F.lit(""))


def status_meaning(collection: Column | str, status: Column | str) -> Column:
    """P14. The sentences shown for each state."""
    c, s = _col(collection), _col(status)
    return (
        F.when(c == "templates", "Authoring template; replace its metadata and prompts before adoption")
        .when(s.isin("draft", "proposed"), "Not accepted; proposed intent does not authorize implementation")
        .when(s.isin("retired", "rejected", "superseded"), "Historical record; retain its reasoning and consult current guidance")
        .when((s == "accepted") & (c == "requirements"), "Agreed intent; acceptance does not establish implementation")
        .when(s == "accepted", "Accepted decision; implementation must be verified in source")
        .otherwise("Project documentation; verify implementation against current source")
    )


def paths_overlap(a: Column, b: Column) -> Column:
    """equal, or one is an ancestor directory of the other; `.` overlaps everything."""
    return (a == ".") | (b == ".") | (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def ancestors(path: Column | str) -> Column:
    """The path and each of its parent directories."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def portable_path(path: Column | str) -> Column:
    """relative, forward slashes, no empty, dot or parent segments, no control characters."""
    p = _col(path)
    return (p != "") & ~p.rlike(r"[\\\x00-\x1f:]") & ~F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))


def sensitive_name(path: Column | str) -> Column:
    """file names that suggest credentials."""
    name = F.lower(F.element_at(F.split(_col(path), "/"), -1))
    return name.rlike(r"^\.env(\..*)?$|^id_(rsa|dsa|ecdsa|ed25519)|\.(pem|key|p12|pfx)$")


def generated_go(content: Column | str) -> Column:
    """The generated-code marker stands on a line before the package clause."""
    header = F.substring_index(F.concat(F.lit("\n"), _col(content)), "\npackage ", 1)
    return header.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$")


def runtime_of_client(name: Column | str) -> Column:
    """Runtime by the client's name; the first that fits."""
    n = F.lower(_col(name))
    out = F.when(F.contains(n, F.lit("claude")), "claude")
    for runtime in ("codex", "copilot", "crush", "antigravity"):
        out = out.when(F.contains(n, F.lit(runtime)), runtime)
    return out.when(n == "human", "human").otherwise("unknown")


def fence_for(text: Column | str, least: int = 3) -> Column:
    """A run of backticks longer than any in the text."""
    runs = F.transform(F.regexp_extract_all(_col(text), F.lit("(`+)")), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def pin_schema_url(content: Column | str, url: str) -> Column:
    """The first schema line of a header points at `url`."""
    return F.regexp_replace(_col(content), r"(?s)\A(.*?yaml-language-server: \$schema=)\S+", "$1" + url)


def valid_id(value: Column | str) -> Column:
    """entry identifiers."""
    v = _col(value)
    return v.rlike(r"^[0-9]{8}-[a-z0-9][a-z0-9-]*-[0-9a-f]{4}$") & (F.length(v) <= 64)


def valid_title(value: Column | str) -> Column:
    """1 to 200 characters without control characters."""
    v = F.trim(_col(value))
    return F.length(v).between(1, 200) & ~v.rlike(r"[\x00-\x1f\x7f]")


def merge_refs(recorded: Column, update: Column) -> Column:
    """A non-empty update wins."""
    return F.coalesce(F.nullif(update, F.lit("")), recorded)


def parse_since(value: Column | str) -> Column:
    """RFC 3339 time; empty means no filter."""
    return F.try_to_timestamp(F.nullif(_col(value), F.lit("")))


def escape_glob(path: Column | str) -> Column:
    """Ignore-file escaping of pattern characters and leading marks."""
    return F.regexp_replace(_col(path), r"([*?\[\]\\!# ])", r"\\$1")
