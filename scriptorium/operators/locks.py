"""Pinned files: lock against live files, change sets, inventories, collisions and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text


def check(lock: DataFrame, live: DataFrame) -> DataFrame:
    """(path, state): ok, missing or differs, for every locked path."""
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("hash"), "differs").otherwise("ok")
    return lock.select("path", "hash").join(live.select("path", F.col("hash").alias("now")), "path", "left").select("path", state.alias("state"))


def changes(fetched: DataFrame, owned: DataFrame) -> DataFrame:
    """(path, op): create, update, keep, or remove (owned but not fetched)."""
    op = F.when(F.col("new").isNull(), "remove").when(F.col("old").isNull(), "create").when(F.col("new") != F.col("old"), "update").otherwise("keep")
    return fetched.select("path", F.col("hash").alias("new")).join(owned.select("path", F.col("hash").alias("old")), "path", "full_outer").select("path", op.alias("op"))


def conflicts(plan: DataFrame) -> DataFrame:
    """F20 for (path, live, owned, incoming hashes): owned files changed by hand, and files in the way that nobody owns."""
    live, owned, incoming = F.col("live"), F.col("owned"), F.col("incoming")
    kind = (
        F.when(live.isNull() | live.eqNullSafe(incoming), None)
        .when(owned.isNull(), "unowned_target")
        .when(live != owned, "locally_modified")
    )
    return plan.withColumn("conflict", kind).where("conflict is not null")


def matches(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Dependency ids in only one of manifest and lock."""
    m, k = manifest.select("id").distinct().withColumn("in_manifest", F.lit(True)), lock.select("id").distinct().withColumn("in_lock", F.lit(True))
    return m.join(k, "id", "full_outer").where("in_manifest is null or in_lock is null").select("id", F.when(F.col("in_lock").isNull(), "not_locked").otherwise("not_declared").alias("problem"))


def uncovered(lock_files: DataFrame, mappings: DataFrame) -> DataFrame:
    """Locked paths outside every mapping of their dependency: a file mapping fits exactly, a directory mapping its descendants."""
    own = lock_files.withColumn("_up", F.explode(text.ancestors("path")))
    covered = own.join(mappings.select("id", F.col("to").alias("_up"), "directory"), ["id", "_up"]).where(F.col("directory") | (F.col("_up") == F.col("path")))
    return lock_files.join(covered.select("id", "path").distinct(), ["id", "path"], "left_anti")


def collisions(paths: DataFrame) -> DataFrame:
    """(path, problem): equal but for case, or a file that is also another's directory."""
    folded = paths.select("path").distinct().withColumn("fold", F.lower("path"))
    same = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("all")).where("n > 1").select(F.explode("all").alias("path"), F.lit("case_duplicate").alias("problem"))
    up = folded.select("fold", F.explode(text.ancestors("fold")).alias("dir")).where("dir <> fold").select("dir").distinct()
    parent = folded.join(up, folded["fold"] == up["dir"], "left_semi").select("path", F.lit("file_is_directory").alias("problem"))
    return same.unionByName(parent)


def ownership_overlap(targets: DataFrame) -> DataFrame:
    """(owner, path, other, other_path) of targets of different owners that overlap, case apart; by equality on ancestors."""
    a = targets.select("owner", "path", F.explode(text.ancestors(F.lower("path"))).alias("key"))
    b = targets.select(F.col("owner").alias("other"), F.col("path").alias("other_path"), F.lower("path").alias("key"))
    pairs = a.join(b, "key").where("owner <> other")
    low = F.struct("owner", "path") < F.struct(F.col("other").alias("owner"), F.col("other_path").alias("path"))
    ends = F.when(low, F.struct("owner", "path", "other", "other_path")).otherwise(F.struct(F.col("other").alias("owner"), F.col("other_path").alias("path"), F.col("owner").alias("other"), F.col("path").alias("other_path")))
    return pairs.select(ends.alias("p")).select("p.*").distinct()


def digests(rows: DataFrame, group: str) -> DataFrame:
    """(group, digest): a digest of each group's rows that does not depend on their order.

    Row hashes are combined in sorted order, first those that begin alike,
    then the parts, so no task holds more than a 4096th of a group's hashes.
    """
    own = sorted(c for c in rows.columns if c != group)
    each = rows.select(group, F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    parts = each.groupBy(group, F.substring("h", 1, 3).alias("k")).agg(joined("h").alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "")
    return parts.groupBy(group).agg(F.sha2(whole, 256).alias("digest"))


def digest(rows: DataFrame) -> DataFrame:
    """The digest of all rows."""
    return digests(rows.withColumn("_all", F.lit(1)), "_all").select("digest")


def validate_tree(files: DataFrame, most_files: int = 10_000, most_bytes: int = 256 << 20) -> DataFrame:
    """One row of counts, with whether the tree stays in its limits."""
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return out.withColumn("fits", (F.col("files") <= most_files) & (F.col("bytes") <= most_bytes))


def select_directory(files: DataFrame, source: str, target: str, most: int = 1000) -> DataFrame:
    """The files below `source`, rebased to `target`; more than `most` is an error."""
    prefix = "" if source in ("", ".") else source.rstrip("/") + "/"
    out = files.where(F.startswith("path", F.lit(prefix))).withColumn("target", F.concat(F.lit(target.rstrip("/") + "/"), F.substring(F.col("path"), len(prefix) + 1, 1 << 20)))
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files below {source!r}")
    return out


def resolved_type() -> Column:
    """F19 over (revision, commit, url, version, integrity, sha256): the source type that a locked identity belongs to, or null."""
    empty = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs]).isNull()
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    digest_ok = F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$")
    return (
        F.when(has("revision"), F.when(F.col("revision").rlike("^[1-9][0-9]*$") & empty("commit", "url", "version", "integrity", "sha256"), "confluence"))
        .when(has("commit"), F.when(F.col("commit").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$") & empty("url", "version", "integrity", "sha256"), "git"))
        .when(has("url") | has("version") | has("integrity"), F.when(F.col("version").rlike(r"^\d+\.\d+\.\d+([-+][0-9A-Za-z.+-]+)?$") & digest_ok & text.integrity_checksum("integrity").isNotNull() & F.col("url").rlike("^https?://[^/@]+/"), "npm"))
        .when(digest_ok, "http")
    )


def source_problems(sources: DataFrame) -> DataFrame:
    """F18 over (id, type, url, ref, sha256, package, version, page): (id, problem), a row for each broken rule."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    allowed = {"git": ("url", "ref"), "http": ("url", "sha256"), "npm": ("package", "version"), "confluence": ("url", "page")}
    needed = {"git": ("url", "ref"), "http": ("url",), "npm": ("package", "version"), "confluence": ("url", "page")}
    rules = [F.when(~F.col("type").isin(*allowed), F.lit("unknown type"))]
    for kind in allowed:
        for c in ("url", "ref", "sha256", "package", "version", "page"):
            if c not in allowed[kind]:
                rules.append(F.when((F.col("type") == kind) & has(c), F.lit(f"{c} does not belong to {kind}")))
            elif c in needed[kind]:
                rules.append(F.when((F.col("type") == kind) & ~has(c), F.lit(f"{c} is required for {kind}")))
    rules.append(F.when(has("sha256") & ~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit("sha256 must be 64 lower-case hex digits")))
    return sources.select("id", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
