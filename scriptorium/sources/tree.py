"""Scans of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import paths, text

MAX_FILE_BYTES = 5 << 20

# What is never scanned, and what is indexed by name.
EXCLUDED_DIRECTORIES = (".git", "vendor", "node_modules", ".idea", ".vscode", "dist", "build", "bin", ".build", ".tools", ".task", ".venv", "__pycache__")
EXCLUDED_FILES = ("go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock")
INDEXED_NAMES = ("Makefile", "Dockerfile", ".gitignore", ".env", ".env.example", ".indexignore")
INDEXED_EXTENSIONS = (
    "go", "md", "markdown", "txt", "rst", "adoc", "yaml", "yml", "mod", "proto", "sql", "json", "toml", "env", "sh", "ini", "js", "jsx", "ts", "tsx", "py", "rs", "java",
    "c", "h", "cpp", "cs", "rb", "php",
)


def _passed_over(spark: SparkSession, root: str, max_bytes: int) -> list[tuple[str, int, bytearray]]:
    """Empty files, and indexed files whose names begin with a dot: Spark's readers pass over them, so the driver lists and reads these few."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    found, todo = [], [at]
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in EXCLUDED_DIRECTORIES and not s.isSymlink():
                    todo.append(s.getPath())
            elif s.getLen() == 0 and not name.startswith("."):
                found.append((s.getPath().toString().removeprefix(base), 0, bytearray()))
            elif name.startswith(".") and name in INDEXED_NAMES and s.getLen() <= max_bytes:
                stream = fs.open(s.getPath())
                data = jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
                stream.close()
                found.append((s.getPath().toString().removeprefix(base), s.getLen(), bytearray(data)))
    return found


def listing(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size, content) of regular files below root; the size limit reaches the scan before any content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    shown = raw.select(F.substring(plain, F.length(base) + 2, F.lit(1 << 20)).alias("path"), F.col("length").alias("size"), "content")
    return shown.unionByName(spark.createDataFrame(_passed_over(spark, root, max_bytes), "path string, size bigint, content binary"))


def some(spark: SparkSession, root: str, names: list[str], max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """As listing, for the named files alone: nothing else of the tree is listed or read. Names that are no files are left out."""
    jvm = spark.sparkContext._jvm
    base = root.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    plain, odd = [], []
    for n in sorted(set(names)):
        at = jvm.org.apache.hadoop.fs.Path(f"{base}/{n}")
        if not fs.exists(at) or not fs.getFileStatus(at).isFile() or fs.getFileStatus(at).getLen() > max_bytes:
            continue
        if fs.getFileStatus(at).getLen() and not at.getName().startswith((".", "_")):
            plain.append(f"{base}/{n}")
            continue
        stream = fs.open(at)
        odd.append((n, fs.getFileStatus(at).getLen(), bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
    out = spark.createDataFrame(odd, "path string, size bigint, content binary")
    if not plain:
        return out
    raw = spark.read.format("binaryFile").load(plain)
    length = F.length(F.regexp_replace(F.lit(base), r"^[a-z]+:/*", "/"))
    shown = F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), length + 2, F.lit(1 << 20))
    return out.unionByName(raw.select(shown.alias("path"), F.col("length").alias("size"), "content"))


def wanted(path: str = "path", extra_extensions: tuple[str, ...] = (), extra_directories: tuple[str, ...] = ()):
    """Allowed by extension or name, not a lock file unless its extension is asked for, and in no excluded directory (by name or path)."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    ext = text.extension(p)
    asked = ext.isin(*[e.lstrip(".").lower() for e in extra_extensions]) if extra_extensions else F.lit(False)
    named = ext.isin(*INDEXED_EXTENSIONS) | name.isin(*INDEXED_NAMES)
    up = F.slice(text.ancestors(p), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    folders = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    barred = F.exists(folders, lambda d: d.isin(*EXCLUDED_DIRECTORIES, *extra_directories)) | (F.exists(up, lambda d: d.isin(*extra_directories)) if extra_directories else F.lit(False))
    return (asked | (named & ~name.isin(*EXCLUDED_FILES))) & ~barred


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore",), root_names: tuple[str, ...] = (".indexignore",), most: int = 10_000) -> paths.IgnoreRules:
    """The ignore files of a listing, parents first; root_names count in the root only. There are at most `most` of them."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(name.isin(*names) | F.col("path").isin(*root_names)).select("path", F.col("content").cast("string").alias("text")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} ignore files")
    rules = paths.IgnoreRules()
    for r in sorted(found, key=lambda r: (r["path"].count("/"), r["path"] in root_names, r["path"])):
        rules.add(r["path"].rpartition("/")[0], r["text"] or "")
    return rules


def without_ignored(files: DataFrame, rules: paths.IgnoreRules) -> DataFrame:
    """The files that no rule leaves out.

    Each folder that files lie in, and each file, meets the rules of the
    folders above it; of those that fit, the last decides. A file goes if that
    leaves out the file or any folder on its way, so nothing comes back from
    below. Only paths are shuffled, folders once each.
    """
    if not rules.rules:
        return files
    spark = files.sparkSession
    table = spark.createDataFrame(rules.rows(), "ordinal int, domain string, negated boolean, only_dirs boolean, pattern string")
    each = files.select("path").distinct().select("path", F.explode(text.ancestors("path")).alias("part"))
    parts = each.select("part", (F.col("part") != F.col("path")).alias("is_dir")).distinct()
    # The domains above a part: its folders, and the root.
    above = F.concat(F.array(F.lit("")), F.filter(text.ancestors("part"), lambda a: a != F.col("part")))
    met = parts.withColumn("domain", F.explode(above)).join(table, "domain").where(F.col("is_dir") | ~F.col("only_dirs"))
    below = F.expr("substring(part, if(domain = '', 1, length(domain) + 2))")
    fit = met.withColumn("below", below).where(F.expr("below rlike pattern"))
    out = fit.groupBy("part", "is_dir").agg(F.max_by("negated", "ordinal").alias("kept")).where("not kept").select("part", "is_dir")
    gone = each.withColumn("is_dir", F.col("part") != F.col("path")).join(out, ["part", "is_dir"]).select("path").distinct()
    return files.join(gone, "path", "left_anti")


def scan(spark: SparkSession, root: str, extra_extensions: tuple[str, ...] = (), extra_directories: tuple[str, ...] = (), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, size, hash, kind, language, content) of the files to index: text in UTF-8 without NUL bytes, not ignored, not generated Go."""
    files = listing(spark, root, max_bytes)
    rules = ignore_rules(listing(spark, root))
    files = without_ignored(files.where(wanted("path", extra_extensions, extra_directories)), rules)
    files = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    texts = files.select("path", "size", F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content")).where(~F.contains("content", F.lit("\x00")))
    texts = texts.where((text.extension("path") != "go") | ~text.generated_go("content"))
    return texts.select("path", "size", "hash", text.file_kind("path").alias("k"), "content").select("path", "size", "hash", "k.kind", "k.language", "content")


def scan_markdown(spark: SparkSession, root: str, directory: str = "docs", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Markdown files below one directory, by the same rules."""
    prefix = "" if directory in ("", ".") else directory.rstrip("/") + "/"
    return scan(spark, root, max_bytes=max_bytes).where(F.startswith("path", F.lit(prefix)) & text.extension("path").isin("md", "markdown"))
