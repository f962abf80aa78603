"""A log-structured index: immutable segments, numbered commits, leases.

A build reads the current commit, chunks only changed files and writes one
segment with their chunks, postings and posting blocks, and a list of the
(segment, path) pairs that it replaces or drops. A commit names the segments
and those lists; commit n + 1 is put only if absent, so of two builders that
started from the same commit one wins and the other starts again. Segments of
one size class are merged once there are FANOUT of them, so a row is rewritten
a logarithmic number of times, and merged segments leave their dropped rows
behind.

Readers resolve a commit once. The last `keep` commits stay; a reader that needs
one for longer holds a lease, a file with an expiry that it can renew. A commit
is retired by moving its file away; what it names goes only if no lease on it
is found after that, and a reader that leases a commit looks for its file after
that, so neither can miss the other.

The location lies on a file system that driver and executors share and that
refuses to replace on rename or link (HDFS, or a local or mounted disk).
"""

from __future__ import annotations

import functools
import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import chunks, diff, search
from scriptorium.sources import tree

VERSION = 6
#: Segments of one size class that are merged; classes grow by this factor.
FANOUT = 4
#: The smallest size class, in chunks.
SMALL = 1000

MANIFEST = "path string, hash string, size bigint, chunks int, lines int, kind string, language string"


class Storage:
    """Small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"
        if self.local:
            # Without checksum files beside each file, which go stale if anyone else writes it.
            self.fs = self.fs.getRaw()

    def _local(self, path):
        return self.jvm.java.io.File(self.fs.makeQualified(path).toUri().getPath()).toPath()

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        try:
            stream = self.fs.open(self._at(name))
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _beside(self, name: str, content: str) -> str:
        folder, _, last = name.rpartition("/")
        mid = f"{folder}/.{last}.{uuid.uuid4().hex}" if folder else f".{last}.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(mid), True)
        out.write(bytearray(content.encode()))
        out.close()
        return mid

    def put_moved(self, mid, to) -> bool:
        """Whether the file `mid` took the free name `to`; it is gone from its own name in either case."""
        try:
            if not self.local:
                return not self.fs.exists(to) and self.fs.rename(mid, to)
            # A local rename replaces; a hard link does not.
            try:
                self.jvm.java.nio.file.Files.createLink(self._local(to), self._local(mid))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            return True
        finally:
            self.fs.delete(mid, True)

    def put_if_absent(self, name: str, content: str) -> bool:
        """Whether this call made the file; it appears whole, and once."""
        return self.put_moved(self._at(self._beside(name, content)), self._at(name))

    def replace(self, name: str, content: str) -> None:
        """Write beside, then rename over."""
        mid, to = self._at(self._beside(name, content)), self._at(name)
        gateway, jvm = self.spark.sparkContext._gateway, self.jvm
        if self.local:
            options = gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(self._local(mid), self._local(to), options)
            return
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        to = self.fs.makeQualified(to)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(mid), to, options)

    def move(self, name: str, to: str) -> bool:
        self.fs.mkdirs(self._at(to).getParent())
        return self.fs.exists(self._at(name)) and self.fs.rename(self._at(name), self._at(to))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def list(self, name: str = "") -> list[str]:
        p = self._at(name) if name else self._path(self.root)
        names = [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return sorted(n for n in names if not n.startswith("."))


class Snapshot:
    """One commit, resolved once; its tables are those of its segments without what later ones replaced."""

    def __init__(self, spark: SparkSession, storage: Storage, generation: int, info: dict):
        if info.get("version") != VERSION:
            raise ValueError(f"index format {info.get('version')} is not {VERSION}; rebuild the index")
        self.spark, self.storage, self.generation, self.info = spark, storage, generation, info
        self.root, self.selection, self.segments, self.deletes = info["root"], info["selection"], info["segments"], info["deletes"]
        self.lease: str | None = None

    def renew(self, seconds: float = 600) -> None:
        """Hold the commit for so long from now on."""
        self.lease = self.lease or f"leases/{self.generation}-{uuid.uuid4().hex}.json"
        self.storage.replace(self.lease, json.dumps({"until": time.time() + seconds}))

    def release(self) -> None:
        if self.lease:
            self.storage.drop(self.lease)
            self.lease = None

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @functools.cached_property
    def dropped(self) -> DataFrame:
        """(segment, path) pairs that are no longer part of the index."""
        if not self.deletes:
            return self.spark.createDataFrame([], "segment string, path string")
        return self.spark.read.schema("segment string, path string").parquet(*[f"{self.storage.root}/deletes/{d['id']}" for d in self.deletes])

    def table(self, name: str) -> DataFrame:
        """Rows of all segments with their `segment`, live ones only."""
        touched = {s for d in self.deletes for s in d["segments"]}
        parts = {True: [], False: []}
        for s in self.segments:
            df = self.spark.read.parquet(f"{self.storage.root}/segments/{s['id']}/{name}")
            parts[s["id"] in touched].append(df.withColumn("segment", F.lit(s["id"])))
        union = lambda dfs: functools.reduce(lambda a, b: a.unionByName(b), dfs)
        live = [union(parts[False])] if parts[False] else []
        if parts[True]:
            held = union(parts[True])
            live.append(held if "path" not in held.columns else held.join(self.dropped, ["segment", "path"], "left_anti").select(*held.columns))
        return union(live)

    @property
    def manifest(self) -> DataFrame:
        return self.table("files").select(*[f.split()[0] for f in MANIFEST.split(", ")])

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def blocks(self) -> DataFrame:
        """Bounds of posting blocks. Dropped files still count in them, which keeps them bounds."""
        return self.table("blocks")

    @property
    def lengths(self) -> DataFrame:
        return self.table("lengths")


class Index:
    def __init__(self, spark: SparkSession, location: str, keep: int = 2):
        self.spark, self.storage, self.keep = spark, Storage(spark, location), keep

    @staticmethod
    def _name(generation: int) -> str:
        return f"commits/{generation:020d}.json"

    def generations(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.storage.list("commits")]

    def snapshot(self, hold: float | None = None, generation: int | None = None) -> Snapshot:
        """The newest commit, or that one; leased for `hold` seconds."""
        while True:
            there = self.generations()
            if not there:
                old = self.storage.read("CURRENT")
                if old is not None:
                    raise ValueError(f"index format {json.loads(old).get('version')} is not {VERSION}; rebuild the index")
                raise FileNotFoundError("no index; build one first")
            n = there[-1] if generation is None else generation
            content = self.storage.read(self._name(n))
            if content is not None:
                snap = Snapshot(self.spark, self.storage, n, json.loads(content))
                if hold is None:
                    return snap
                snap.renew(hold)
                if self.storage.exists(self._name(n)):
                    return snap
                snap.release()  # retired meanwhile
            if generation is not None:
                raise FileNotFoundError(f"generation {n} is gone")

    def current(self) -> Snapshot | None:
        try:
            return self.snapshot()
        except FileNotFoundError:
            return None

    def _segment(self, made: DataFrame, light: DataFrame) -> dict:
        """K1: write a segment of these chunks and the files (path, hash, size, kind, language) that they are of."""
        name = f"seg-{uuid.uuid4().hex}"
        at = f"{self.storage.root}/segments/{name}"
        made.write.partitionBy("kind").parquet(f"{at}/chunks")
        # An empty segment has no folders of kinds to tell the schema by.
        held = self.spark.read.schema(made.schema).option("basePath", f"{at}/chunks").parquet(f"{at}/chunks")
        # Postings are clustered by term, so a query's terms prune row groups.
        search.blocked(search.postings(held)).repartitionByRange("term").sortWithinPartitions("term", "field", "block").write.parquet(f"{at}/postings")
        stored = self.spark.read.parquet(f"{at}/postings")
        search.blocks(stored).repartitionByRange("term").sortWithinPartitions("term", "field", "block").write.parquet(f"{at}/blocks")
        search.lengths(held).write.parquet(f"{at}/lengths")
        sizes = held.groupBy("path").agg(F.count("*").cast("int").alias("chunks"), F.max("end_line").cast("int").alias("lines"))
        listed = light.join(sizes, "path", "left").select("path", "hash", "size", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("lines", F.lit(0)).alias("lines"), "kind", "language")
        listed.write.parquet(f"{at}/files")
        n = self.spark.read.parquet(f"{at}/files").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()
        return {"id": name, "files": n["files"], "chunks": n["chunks"]}

    def _commit(self, old: Snapshot | None, info: dict) -> int:
        """The new generation. Its number tells that nothing was published since `old`."""
        generation = old.generation + 1 if old else 1
        if not self.storage.put_if_absent(self._name(generation), json.dumps({"version": VERSION, **info})):
            raise RuntimeError("another build was published meanwhile; build again")
        return generation

    def build(self, root: str | None = None, extra_extensions: tuple[str, ...] = (), extra_directories: tuple[str, ...] = ()) -> dict:
        """Scan, compare by hash, write one segment of what changed, publish. Without a root, the recorded one and its selection are refreshed.

        Nothing is published if neither files nor selection changed.
        """
        old = self.current()
        if root is None:
            if old is None:
                raise FileNotFoundError("nothing recorded to refresh")
            root, selection = old.root, old.selection
        else:
            if old is not None and old.root != root:
                raise ValueError("the index belongs to another root")
            selection = {"extensions": sorted(extra_extensions), "directories": sorted(extra_directories)}
        files = tree.scan(self.spark, root, tuple(selection["extensions"]), tuple(selection["directories"]))
        light = files.select("path", "hash", "size", "kind", "language")
        before = old.table("files") if old else self.spark.createDataFrame([], MANIFEST + ", segment string")
        states = diff.build_diff(light, before).cache()
        made = []
        try:
            counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
            report = {s: counts.get(s, 0) for s in ("indexed", "unchanged", "deleted")}
            if old and not report["indexed"] and not report["deleted"] and selection == old.selection:
                return {**report, "generation": old.generation, "published": False}
            segments, deletes = list(old.segments) if old else [], list(old.deletes) if old else []
            if report["indexed"] or not old:
                changed = states.where("state = 'indexed'").select("path")
                segment = self._segment(chunks.chunk_files(files.join(changed, "path", "left_semi")), light.join(changed, "path", "left_semi"))
                made.append(f"segments/{segment['id']}")
                segments.append(segment)
            if old and report["indexed"] + report["deleted"]:
                gone = before.join(states.where("state <> 'unchanged'").select("path"), "path", "left_semi").select("segment", "path")
                name = f"del-{uuid.uuid4().hex}"
                made.append(f"deletes/{name}")
                gone.write.parquet(f"{self.storage.root}/deletes/{name}")
                touched = [r[0] for r in self.spark.read.parquet(f"{self.storage.root}/deletes/{name}").select("segment").distinct().collect()]
                if touched:
                    deletes.append({"id": name, "segments": sorted(touched)})
            generation = self._commit(old, {"root": root, "selection": selection, "segments": segments, "deletes": deletes})
        except BaseException:
            for name in made:
                self.storage.drop(name)
            raise
        finally:
            states.unpersist()
        self.compact()
        self.vacuum()
        return {**report, "generation": generation, "published": True}

    def compact(self) -> int | None:
        """Merge the segments of a size class that has FANOUT of them; the new generation, or None if there is nothing to merge or another commit came first."""
        snap = self.snapshot()
        classes: dict[int, list[dict]] = {}
        for s in snap.segments:
            classes.setdefault(max(0, math.ceil(math.log(max(s["chunks"], 1) / SMALL, FANOUT))), []).append(s)
        full = next((found for _, found in sorted(classes.items()) if len(found) >= FANOUT), None)
        if full is None:
            return None
        ids = {s["id"] for s in full}
        part = Snapshot(self.spark, self.storage, snap.generation, {**snap.info, "segments": full})
        merged = self._segment(part.chunks.drop("segment"), part.table("files").drop("segment", "chunks", "lines"))
        rest = [s for s in snap.segments if s["id"] not in ids]
        # Lists that name merged segments only have done their work.
        deletes = [{**d, "segments": left} for d in snap.deletes if (left := sorted(set(d["segments"]) - ids))]
        try:
            return self._commit(snap, {"root": snap.root, "selection": snap.selection, "segments": [*rest, merged], "deletes": deletes})
        except RuntimeError:
            self.storage.drop(f"segments/{merged['id']}")
            return None

    def _leased(self) -> set[int]:
        held, now = set(), time.time()
        for name in self.storage.list("leases"):
            content = self.storage.read(f"leases/{name}")
            if content is None:
                continue
            if json.loads(content)["until"] > now:
                held.add(int(name.split("-")[0]))
            else:
                self.storage.drop(f"leases/{name}")
        return held

    def vacuum(self) -> int:
        """Retire commits that are neither among the last `keep` nor leased, and drop what no other names; how many segments went."""
        leased = self._leased()
        for n in self.generations()[: -self.keep]:
            if n not in leased:
                self.storage.move(self._name(n), f"retired/{n:020d}.json")
        # A lease that came before its commit was retired is found now.
        leased = self._leased()
        stay, go = [self.storage.read(self._name(n)) for n in self.generations()], {}
        for name in self.storage.list("retired"):
            content = self.storage.read(f"retired/{name}")
            if content is not None:
                if int(name.removesuffix(".json")) in leased:
                    stay.append(content)
                else:
                    go[name] = json.loads(content)
        named = lambda infos: {f"{kind}/{x['id']}" for info in infos for kind in ("segments", "deletes") for x in info[kind]}
        # Only what retired commits name: a segment that a build is just writing is named by none.
        lost = named(go.values()) - named(json.loads(c) for c in stay if c is not None)
        for name in sorted(lost):
            self.storage.drop(name)
        for name in go:
            self.storage.drop(f"retired/{name}")
        return sum(name.startswith("segments/") for name in lost)

    def freshness(self) -> tuple[str, DataFrame]:
        """Status, and the changed paths by state."""
        snap = self.snapshot()
        files = tree.scan(self.spark, snap.root, tuple(snap.selection["extensions"]), tuple(snap.selection["directories"]))
        # Paths only: no content is read. A file that is now ignored or empty is still there.
        there = tree.listing(self.spark, snap.root, 1 << 62).select("path")
        changes = diff.freshness(files.select("path", "hash"), snap.manifest, there)
        return diff.freshness_status(changes), changes
