"""The public API: one object for search, documents, impact, context, journal, locks and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import convert, paths, text
from scriptorium.operators import catalog, chunks, context, diff, journal, locks, search
from scriptorium.plans.index import Index
from scriptorium.plans.session import ship
from scriptorium.plans.vendoring import Vendoring
from scriptorium.plans.writes import JournalWriter
from scriptorium.sources import catalog as catalog_source
from scriptorium.sources import journal as journal_source
from scriptorium.sources import manifests, tree
from scriptorium.streaming.refresher import Refresher


class Journal:
    """The read side of the journal, and retention reports."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def valid(self) -> DataFrame:
        return journal_source.entries(self.spark, self.root).where("problem is null")

    def list(self, **filters) -> DataFrame:
        return journal.list_entries(self.valid(), **filters)

    def show(self, entry: str, since=None) -> DataFrame:
        args = (journal_source.notes(self.spark, self.root), journal_source.events(self.spark, self.root), journal_source.files(self.spark, self.root))
        return journal.show(self.valid().where(F.col("id") == entry), *args, since=since)

    def search(self, query: str, limit: int = 0) -> DataFrame:
        return journal.search(self.valid(), journal_source.notes(self.spark, self.root), query, limit)

    def gc(self, now) -> DataFrame:
        """Expired entries and their sizes; nothing is removed."""
        return journal.gc(self.valid(), journal_source.files(self.spark, self.root).select("id", "size"), now)


class Engine:
    def __init__(self, spark: SparkSession, index: str, project: str | None = None, documentation: str = "docs"):
        self.spark, self.index, self.project, self.documentation = spark, Index(spark, index), project, documentation
        ship(spark)
        convert.register(spark)

    def build(self, root: str | None = None, **selection) -> dict:
        return self.index.build(root or self.project, **selection)

    def refresh(self) -> dict:
        """R3."""
        return self.index.build()

    def freshness(self) -> tuple[str, DataFrame]:
        return self.index.freshness()

    def search(self, query: str, check_stale: bool = True, **options) -> tuple[DataFrame, dict]:
        """The page, with `stale` for each hit, and its totals; info["refresh"] asks for a refresh if a hit is stale."""
        snap = self.index.snapshot()
        page, info = search.page(snap.postings, snap.chunks, search.Query(query, **options), snap.lengths)
        info["generation"] = snap.generation
        if check_stale:
            # At most 100 rows; brought here so that the answer is what was checked, once.
            page = self.spark.createDataFrame(page.collect(), page.schema)
            live = tree.some(self.spark, snap.root, [r["path"] for r in page.select("path").collect()]).select("path", "size", F.sha2("content", 256).alias("hash"))
            marked = diff.mark_stale(page, snap.manifest, live).orderBy(F.desc("score"), F.asc("chunk_id"))
            rows = marked.collect()
            page = self.spark.createDataFrame(rows, marked.schema)
            info["refresh"] = any(r["stale"] for r in rows)
        return page, info

    def best(self, query: str, **options) -> DataFrame:
        """(chunk_id, score, relaxed) of the page alone, over the posting blocks that can hold it."""
        snap = self.index.snapshot()
        return search.top(snap.postings, snap.blocks, snap.chunks, snap.lengths, search.Query(query, **options))

    def read_lines(self, path: str, start: int = 1, count: int = 200) -> DataFrame:
        """M2: from the live file."""
        snap = self.index.snapshot()
        files = tree.some(self.spark, snap.root, [paths.clean(path)]).select("path", F.col("content").cast("string").alias("content"))
        return chunks.read_lines(files, start, count)

    def list_files(self, **options) -> DataFrame:
        return search.list_files(self.index.snapshot().manifest, **options)

    def stats(self) -> DataFrame:
        return diff.index_stats(self.index.snapshot().manifest)

    def _markdown(self) -> DataFrame:
        root = self.project or self.index.snapshot().root
        return tree.scan_markdown(self.spark, root, self.documentation)

    def catalog(self) -> dict[str, DataFrame]:
        return catalog_source.load(self._markdown(), f"{self.documentation}/README.md")

    def get_document(self, id: str, start: int = 1, count: int = 200) -> DataFrame:
        """M5: metadata, status meaning and lines of the one document with this id."""
        found = self.catalog()["documents"].where(F.col("id") == id)
        if found.limit(2).count() != 1:
            raise LookupError(f"no single document has the id {id!r}")
        lines = chunks.read_lines(self._markdown().select("path", "content"), start, count)
        return found.join(lines, "path").withColumn("status_meaning", text.status_meaning("collection", "status"))

    def _changed(self, changed: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths.normalize_paths(changed)], "path string")

    def impact(self, changed: list[str]) -> DataFrame:
        c = self.catalog()
        return catalog.impact(c["documents"], c["links"], self._changed(changed))

    def context(self, changed: list[str], max_bytes: int = context.DEFAULT_BUDGET) -> DataFrame:
        """M7: the entrypoint, handbook guidance, the named files and affected documents, in a byte budget."""
        c = self.catalog()
        asked, docs = self._changed(changed), c["documents"]
        files = self._markdown().select("path", "content")
        # The first 16 named files alone are read.
        some = paths.normalize_paths(changed)[:16]
        named = tree.some(self.spark, self.project or self.index.snapshot().root, some).select("path", F.col("content").cast("string").alias("content"))
        none = F.array().cast("array<string>")
        row = lambda df, p: df.select("path", F.lit(p).alias("priority"), F.lit(1).alias("start_line"), "content", none.alias("evidence"))
        hit = catalog.impact(docs, c["links"], asked).join(files, "path")
        linked = hit.select("path", F.when(F.col("reason") == "related_document", 4).otherwise(3).alias("priority"), F.lit(1).alias("start_line"), "content", F.coalesce("changed", "trail").alias("evidence"))
        guidance = files.join(docs.where("collection = 'handbook'").select("path"), "path", "left_semi")
        rows = row(files.where(F.col("path") == f"{self.documentation}/README.md"), 0).unionByName(row(guidance, 1)).unionByName(row(named, 2)).unionByName(linked)
        picked = context.candidates(rows.withColumn("request", F.lit(0)))
        return context.assemble(picked, max_bytes).drop("request")

    def journal(self, root: str) -> Journal:
        return Journal(self.spark, root)

    def journal_writer(self, root: str, runtime: str = "", session: str = "") -> JournalWriter:
        """M9: new, note, done, attach, gc."""
        return JournalWriter(self.spark, root, self.project, runtime, session)

    def refresher(self, **limits) -> Refresher:
        """Refreshes the index now and on request, until stopped."""
        return Refresher(self.spark, self.refresh, **limits)

    def vendoring(self, records: str, mirror: str) -> Vendoring:
        """Dry run, check, sync and update from a mirror."""
        return Vendoring(self.spark, self.project or self.index.snapshot().root, records, mirror)

    def lock_check(self, lock_text: str) -> DataFrame:
        """M11."""
        held = manifests.lock(self.spark, lock_text)["files"]
        # Owned files alone are read; a lock is a small file.
        owned = [r["path"] for r in held.select("path").distinct().collect()]
        live = tree.some(self.spark, self.project or self.index.snapshot().root, owned, 64 << 20).select("path", F.sha2("content", 256).alias("hash"))
        return locks.check(held, live)

    def doctor(self, journal_root: str | None = None, now=None) -> DataFrame:
        """(check, status): index freshness, expired and stale journal entries, invalid entries."""
        rows = []
        try:
            rows.append(("index", "pass" if self.freshness()[0] == "fresh" else "warn"))
        except FileNotFoundError:
            rows.append(("index", "warn"))
        if journal_root:
            now = F.current_timestamp() if now is None else now
            all_ = journal_source.entries(self.spark, journal_root)
            rows.append(("entries", "pass" if all_.where("problem is not null").isEmpty() else "fail"))
            good = all_.where("problem is null")
            rows.append(("expired", "pass" if good.where(journal.expired(now)).isEmpty() else "warn"))
            rows.append(("stale", "pass" if good.where(journal.stale(now)).isEmpty() else "warn"))
        return self.spark.createDataFrame(rows, "check string, status string")
