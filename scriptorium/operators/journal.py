"""Task journal: filters, search, retention and state, over entry and event tables.

entries: (id, title, status, tags, created_at, updated_at, expires_at,
runtime, session, refs); events: (id, at, event, summary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days that finished entries are kept, and after which an open one is stale.
RETENTION_DAYS = {"done": 30, "abandoned": 7}
STALE_DAYS = 14


def expired(now: Column) -> Column:
    """F9."""
    return (F.col("status") != "open") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)


def kept() -> Column:
    """finished without an expiry."""
    return (F.col("status") != "open") & F.col("expires_at").isNull()


def stale(now: Column) -> Column:
    """F11."""
    return (F.col("status") == "open") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(STALE_DAYS)))


def list_entries(entries: DataFrame, status: str = "", since: Column | None = None, tags: tuple[str, ...] = (), only_kept: bool = False) -> DataFrame:
    """Entries that pass every filter, last updated first."""
    if status:
        entries = entries.where(F.col("status") == status)
    if since is not None:
        entries = entries.where(F.col("updated_at") >= since)
    if only_kept:
        entries = entries.where(kept())
    if tags:
        entries = entries.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    return entries.orderBy(F.desc("updated_at"), F.asc("id"))


def search(entries: DataFrame, notes: DataFrame, query: str, limit: int = 0, most_lines: int = 3) -> DataFrame:
    """F8, T5: (id, updated_at, lines): the query, in any case, in title, id, tags or a line of the notes; comment lines do not count."""
    q = F.lit(query.strip().lower())
    every = F.transform(F.split(F.coalesce("notes", F.lit("")), "\n"), lambda x: F.trim(x))
    lines = F.slice(F.filter(every, lambda x: ~F.startswith(x, F.lit("<!--")) & F.contains(F.lower(x), q)), 1, most_lines)
    found = entries.join(notes, "id", "left").withColumn("lines", lines)
    hit = (F.size("lines") > 0) | F.contains(F.lower("title"), q) | F.contains(F.col("id"), q) | F.exists("tags", lambda t: F.contains(t, q))
    out = found.where(hit).orderBy(F.desc("updated_at"), F.asc("id")).select("id", "updated_at", "lines")
    return out.limit(limit) if limit else out


def gc(entries: DataFrame, sizes: DataFrame, now: Column) -> DataFrame:
    """Expired entries with their sizes (files: id, size)."""
    total = sizes.groupBy("id").agg(F.sum("size").alias("size"))
    return entries.where(expired(now)).join(total, "id", "left").select("id", "expires_at", F.coalesce("size", F.lit(0)).alias("size"))


def gc_report(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def state(events: DataFrame) -> DataFrame:
    """(id, status, created_at, updated_at, expires_at) folded from the event log.

    new opens, note opens again, done and abandoned finish, keep clears the
    expiry. The last event of a moment wins by name, so the fold is stable.
    """
    order = F.struct("at", "event")
    status = F.when(F.col("event").isin("new", "note"), "open").when(F.col("event").isin("done", "abandoned"), F.col("event"))
    last = F.max_by(F.struct(status.alias("status"), "at"), F.when(status.isNotNull(), order))
    keep = F.max(F.when(F.col("event") == "keep", F.col("at")))
    out = events.groupBy("id").agg(last.alias("l"), keep.alias("keep"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    days = F.when(F.col("l.status") == "done", RETENTION_DAYS["done"]).when(F.col("l.status") == "abandoned", RETENTION_DAYS["abandoned"])
    until = F.when((F.col("l.status") != "open") & (F.col("keep").isNull() | (F.col("keep") < F.col("l.at"))), F.col("l.at") + F.make_dt_interval(days))
    return out.select("id", F.coalesce("l.status", F.lit("open")).alias("status"), "created_at", "updated_at", until.alias("expires_at"))


def show(entries: DataFrame, notes: DataFrame, events: DataFrame, files: DataFrame, since: Column | None = None) -> DataFrame:
    """Entries with notes, their events from `since` on in order, and their files."""
    if since is not None:
        events = events.where(F.col("at") >= since)
    log = events.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "event", "summary"))).alias("events"))
    held = files.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("path", "size"))).alias("files"))
    return entries.join(notes, "id", "left").join(log, "id", "left").join(held, "id", "left")


def stray(listing: DataFrame, allowed: DataFrame) -> DataFrame:
    """Listed names that are neither allowed nor hidden."""
    return listing.where(~F.startswith("name", F.lit("."))).join(allowed.select("name"), "name", "left_anti")


def index_of(entries: DataFrame) -> DataFrame:
    """K3: the columns of the index file, in its order."""
    return entries.select("id", "title", "status", "tags", "created_at", "updated_at", "expires_at", "runtime").orderBy(F.desc("updated_at"), F.asc("id"))


def index_differs(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows in one of the stored and the rendered index; empty if they agree."""
    now = index_of(entries)
    return stored.exceptAll(now).withColumn("side", F.lit("stored")).unionByName(now.exceptAll(stored).withColumn("side", F.lit("rendered")))


def overall(checks: DataFrame) -> DataFrame:
    """The worst status; skipped checks do not raise it."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.coalesce(F.max(rank), F.lit(0)) + 1)
    return checks.agg(worst.alias("status"), F.count("*").alias("checks"))


def limit_evidence(evidence: Column, most: int = 10) -> Column:
    """The first `most`, then how many more."""
    more = F.size(evidence) - most
    return F.when(more > 0, F.concat(F.slice(evidence, 1, most), F.array(F.format_string("and %d more", more)))).otherwise(evidence)


def event_ordinals(events: DataFrame) -> DataFrame:
    """Place of each event in its entry's log."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at", "event")))
