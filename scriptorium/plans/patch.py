"""K6, K7: file changes as a batch with a write-ahead record and recovery.

A batch is planned from a table of wanted files against the files that are
there, whose hashes are its snapshot. The plan is written with its contents,
then the originals of all files that it touches, once for each content, and
only if every snapshot still holds are files replaced, each at once, by the
tasks that hold them. The state (backing_up, applying, complete, undone) is put
before what it allows. What a task has done shows in the hash of the file, so a
batch that was cut off anywhere can be finished or taken back by running it
again: files that already have their new content are left.

Tasks read and write the root through pyarrow's file systems, so it may be
anything that all machines mount or that pyarrow opens by URI.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.plans.index import Storage
from scriptorium.plans.session import ship


class Changed(RuntimeError):
    """A file is not as it was when the batch was planned."""


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _current(files, at: str) -> bytes | None:
    """Content, or None if there is no file. Links and special files are refused."""
    from pyarrow import fs

    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        if isinstance(files, fs.LocalFileSystem) and os.path.islink(at):
            raise ValueError(f"{at} must be a regular file")
        return None
    if info.type != fs.FileType.File or isinstance(files, fs.LocalFileSystem) and os.path.islink(at):
        raise ValueError(f"{at} must be a regular file")
    with files.open_input_stream(at) as f:
        return f.read()


def _hash(content: bytes | None) -> str | None:
    return None if content is None else hashlib.sha256(content).hexdigest()


def _mapper(root: str, row: Callable, schema: dict[str, pa.DataType]) -> Callable:
    """A mapInArrow function: row(files, base, input row) for each row; inputs are one file each, so batches stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([row(files, base.rstrip("/"), batch.slice(at, 1).to_pylist()[0])], schema=pa.schema(schema))

    return run


def _look(files, base: str, r: dict) -> dict:
    content = _current(files, f"{base}/{r['path']}")
    return {"path": r["path"], "live": _hash(content), "original": content}


def _put(files, base: str, r: dict) -> dict:
    """Bring one file from `before` to `after`; r["content"] is what `after` is the hash of."""
    at = f"{base}/{r['path']}"
    live = _hash(_current(files, at))
    done = live == r["after"]
    if not done and live == r["before"]:
        if r["after"] is None:
            files.delete_file(at)
        else:
            files.create_dir(at.rpartition("/")[0], recursive=True)
            mid = f"{at.rpartition('/')[0]}/.{at.rpartition('/')[2]}.{uuid.uuid4().hex}"
            with files.open_output_stream(mid) as f:
                f.write(r["content"])
            files.move(mid, at)
        done = True
    return {"path": r["path"], "done": done}


_LIVE = {"path": pa.string(), "live": pa.string(), "original": pa.binary()}


class Patch:
    def __init__(self, spark: SparkSession, root: str, records: str):
        ship(spark)
        self.spark, self.root, self.records = spark, root.rstrip("/"), Storage(spark, records)

    def live(self, paths: DataFrame) -> DataFrame:
        """(path, live, original): hash and content of the files at these paths, nulls where there are none."""
        return paths.select("path").mapInArrow(_mapper(self.root, _look, _LIVE), "path string, live string, original binary")

    def plan(self, wanted: DataFrame) -> str:
        """Record a batch of (path, content, remove, force) and return its name.

        content is the file wanted; a row with neither content nor remove is
        an input, whose snapshot is watched and that is not changed. A path
        may be scheduled once. Files that are already as wanted are inputs
        too, unless forced.
        """
        # The contents are read once: what is planned is what was looked at.
        name = f"updates/{uuid.uuid4().hex}"
        rows = wanted.select("path", F.col("content").cast("binary").alias("content"), F.coalesce("remove", F.lit(False)).alias("remove"), F.coalesce("force", F.lit(False)).alias("force"))
        at = f"{self.records.root}/{name}"
        rows.write.parquet(f"{at}/wanted")
        rows = self.spark.read.parquet(f"{at}/wanted")
        bad = rows.groupBy("path").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~text.portable_path("path")).orderBy("path").limit(1).collect()
        if bad:
            self.records.drop(name)
            raise ValueError(f"output {bad[0]['path']} is scheduled more than once" if bad[0]["n"] > 1 else f"output must be inside the root: {bad[0]['path']}")
        self.live(rows).write.parquet(f"{at}/snapshot")
        seen = self.spark.read.parquet(f"{at}/snapshot").select("path", F.col("live").alias("before"))
        after = F.when(F.col("remove"), F.lit(None)).when(F.col("content").isNotNull(), F.sha2("content", 256)).otherwise(F.col("before"))
        both = rows.join(seen, "path").withColumn("after", after)
        same = F.col("after").eqNullSafe(F.col("before"))
        operation = F.when(~F.col("remove") & F.col("content").isNull(), "input").when(same & ~(F.col("force") & ~F.col("remove")), "input")
        operation = operation.when(F.col("remove"), "remove").when(F.col("before").isNull(), "create").otherwise("update")
        both.select("path", operation.alias("operation"), "before", "after", "content").write.parquet(f"{at}/plan")
        return name

    def changes(self, name: str) -> DataFrame:
        """K8: (path, operation, before, after) of what the batch changes."""
        return self._plan(name).where("operation <> 'input'").select("path", "operation", "before", "after")

    def _plan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.records.root}/{name}/plan")

    def status(self, name: str) -> str | None:
        content = self.records.read(f"{name}/status.json")
        return json.loads(content)["status"] if content else None

    def _enter(self, name: str, status: str) -> None:
        self.records.replace(f"{name}/status.json", json.dumps({"version": 1, "status": status}))

    def _moved(self, name: str) -> list[str]:
        plan = self._plan(name)
        seen = self.live(plan).join(plan, "path")
        return [r["path"] for r in seen.where(~F.col("live").eqNullSafe(F.col("before"))).select("path").orderBy("path").limit(10).collect()]

    def validate(self, name: str) -> None:
        """Refuse if any file of the batch, changed or only read, is not as planned."""
        if moved := self._moved(name):
            raise Changed(f"changed while preparing file changes: {', '.join(moved)}; plan again")

    def apply(self, name: str) -> dict:
        """Validate, back up, validate again, change files; {"applied", "status"}."""
        self.validate(name)
        if not self.records.put_if_absent(f"{name}/status.json", json.dumps({"version": 1, "status": "backing_up"})):
            raise RuntimeError(f"{name} was begun before; recover it")
        plan = self._plan(name)
        if plan.where("operation <> 'input'").isEmpty():
            self._enter(name, "complete")
            return {"applied": 0, "status": "complete"}
        old = plan.where("operation <> 'input' AND before IS NOT NULL").select("path", "before")
        # One copy of each content; a file that changed under the copy fails the next look.
        copies = self.live(old).join(old, "path").where("live = before").groupBy(F.col("live").alias("hash")).agg(F.first("original").alias("content"))
        copies.write.parquet(f"{self.records.root}/{name}/objects")
        self.validate(name)
        self._enter(name, "applying")
        return self._finish(name)

    def _run(self, rows: DataFrame) -> tuple[int, str]:
        out = rows.mapInArrow(_mapper(self.root, _put, {"path": pa.string(), "done": pa.bool_()}), "path string, done boolean")
        # One job: rows are changed once, what they say is summed up.
        got = out.agg(F.count_if("done").alias("n"), F.count_if(~F.col("done")).alias("left"), F.min(F.when(~F.col("done"), F.col("path"))).alias("one")).first()
        return got["n"], f"{got['one']} and {got['left'] - 1} more" if got["left"] else ""

    def _finish(self, name: str) -> dict:
        n, left = self._run(self._plan(name).where("operation <> 'input'").select("path", "before", "after", "content"))
        if left:
            raise Changed(f"changed while files were replaced: {left}; recover {name}")
        self._sweep(name, "remove")
        self._enter(name, "complete")
        return {"applied": n, "status": "complete"}

    def _undo(self, name: str) -> dict:
        plan = self._plan(name).where("operation <> 'input'").select("path", F.col("after").alias("before"), F.col("before").alias("after"))
        held = self.spark.read.parquet(f"{self.records.root}/{name}/objects")
        n, left = self._run(plan.join(held.select(F.col("hash").alias("after"), "content"), "after", "left").select("path", "before", "after", "content"))
        if left:
            raise Changed(f"changed since by others: {left}")
        self._sweep(name, "create")
        self._enter(name, "undone")
        return {"applied": n, "status": "undone"}

    def _sweep(self, name: str, operation: str) -> None:
        """Remove folders that the operation left empty, up to the root."""
        base = Storage(self.spark, self.root)
        folders = self._plan(name).where(F.col("operation") == operation).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("f")).where("f <> ''").distinct()
        for r in folders.toLocalIterator():
            at = r["f"]
            # A plain delete refuses folders that hold something.
            while at and base.exists(at) and not base.fs.listStatus(base._at(at)):
                base.fs.delete(base._at(at), False)
                at = at.rpartition("/")[0]

    def recover(self, name: str, undo: bool = False) -> str:
        """Bring a batch that was cut off to an end: nothing has changed before `applying`; then it is finished, or taken back. The new status."""
        status = self.status(name)
        if status in (None, "backing_up"):
            self.records.drop(name)
            return "discarded"
        if undo and status in ("applying", "complete"):
            return self._undo(name)["status"]
        return self._finish(name)["status"] if status == "applying" else status
