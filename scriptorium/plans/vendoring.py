"""Fetched trees against what a project owns: dry run, check, sync and update.

Manifest and lock are tables. A dependency's artefact comes from a mirror, by
what the lock pins (sync) or resolved anew (update); its files are chosen by
mappings (id, from, to, directory), compared with the owned files (id, path,
hash) of the lock and with the files that are there, and changed as one batch.
Nothing is fetched twice: what a run fetched is written beside its batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import locks
from scriptorium.plans.patch import Patch
from scriptorium.sources import mirrors

#: Files that one directory mapping may take.
MOST = 1000


class Refused(RuntimeError):
    """The run would overwrite or lose something that is not its own."""


def mapped(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, path, hash, content): fetched files (id, path, content) at their places, by equality on the folders above them."""
    up = files.withColumn("_from", F.explode(F.concat(F.array(F.lit(".")), text.ancestors("path"))))
    m = mappings.select("id", F.regexp_replace("from", "/+$", "").alias("_from"), F.regexp_replace("to", "/+$", "").alias("_to"), "directory")
    hit = up.join(m, ["id", "_from"]).where(F.col("directory") | (F.col("_from") == F.col("path")))
    below = F.when(F.col("_from") == ".", F.col("path")).otherwise(F.expr("substring(path, length(_from) + 2)"))
    to = F.when(~F.col("directory"), F.col("_to")).when(F.col("_to") == ".", below).otherwise(F.concat_ws("/", "_to", below))
    return hit.select("id", "_from", "_to", "directory", to.alias("path"), F.sha2("content", 256).alias("hash"), "content")


class Vendoring:
    def __init__(self, spark: SparkSession, root: str, records: str, mirror: str):
        self.spark, self.mirror, self.patch = spark, mirror, Patch(spark, root, records)

    def check(self, owned: DataFrame) -> DataFrame:
        """(path, state) of every owned file."""
        live = self.patch.live(owned).select("path", F.col("live").alias("hash")).where("hash is not null")
        return locks.check(owned, live)

    def _incoming(self, artifacts: list[dict], mappings: DataFrame) -> DataFrame:
        at = f"{self.patch.records.root}/fetched/{uuid.uuid4().hex}"
        got = mirrors.fetch(self.spark, self.mirror, artifacts)
        got.write.parquet(f"{at}/files")
        got = self.spark.read.parquet(f"{at}/files")
        placed = mapped(got, mappings)
        missing = mappings.join(placed.select("id", F.col("_from").alias("from")).distinct(), ["id", "from"], "left_anti").orderBy("id", "from").limit(1).collect()
        if missing:
            raise Refused(f"{missing[0]['id']} has nothing at {missing[0]['from']!r}")
        big = placed.where("directory").groupBy("id", "_from", "_to").count().where(F.col("count") > MOST).limit(1).collect()
        if big:
            raise Refused(f"{big[0]['id']} has more than {MOST} files below {big[0]['_from']!r}")
        clash = locks.collisions(placed.select("path")).orderBy("path").limit(1).collect()
        twice = placed.groupBy("path").count().where("count > 1").orderBy("path").limit(1).collect()
        if clash or twice:
            raise Refused(f"two files for {(clash or twice)[0]['path']!r}")
        pins = got.groupBy("id").agg(F.max("resolved").alias("resolved"), F.max("sha256").alias("sha256"))
        placed.join(pins, "id").select("id", "path", "hash", "content", "resolved", "sha256").write.parquet(f"{at}/placed")
        return self.spark.read.parquet(f"{at}/placed")

    def plan(self, artifacts: list[dict], mappings: DataFrame, owned: DataFrame, force: bool = False) -> dict:
        """Dry run: {"changes": (path, op), "batch": name of the planned batch, "lock": (id, resolved, sha256, path, hash)}.

        F20: files of the project that are in the way, or were changed by hand
        since the lock, refuse the run unless forced.
        """
        new = self._incoming(artifacts, mappings)
        mine = owned.select("path", "hash").dropDuplicates(["path"])
        both = new.select("path", F.col("hash").alias("incoming"), "content").join(mine.withColumnRenamed("hash", "owned"), "path", "full_outer")
        seen = both.join(self.patch.live(both).select("path", "live"), "path")
        bad = [] if force else locks.conflicts(seen.select("path", "live", "owned", "incoming")).orderBy("path").limit(10).collect()
        if bad:
            raise Refused("; ".join(f"{r['path']}: {r['conflict']}" for r in bad))
        wanted = both.select("path", "content", F.col("incoming").isNull().alias("remove"), F.lit(False).alias("force"))
        changes = locks.changes(new.select("path", "hash"), mine)
        return {"changes": changes, "batch": self.patch.plan(wanted), "lock": new.select("id", "resolved", "sha256", "path", "hash")}

    def sync(self, artifacts: list[dict], mappings: DataFrame, owned: DataFrame, pins: dict[str, dict], force: bool = False) -> dict:
        """Bring the project to what the lock pins; every artefact needs a pin."""
        missing = sorted(a["id"] for a in artifacts if a["id"] not in pins)
        if missing:
            raise Refused(f"not locked: {', '.join(missing)}; update first")
        return self._run([{**a, "locked": pins[a["id"]]} for a in artifacts], mappings, owned, force)

    def update(self, artifacts: list[dict], mappings: DataFrame, owned: DataFrame, force: bool = False) -> dict:
        """Resolve refs and tags anew, and bring the project to that."""
        return self._run(artifacts, mappings, owned, force)

    def _run(self, artifacts: list[dict], mappings: DataFrame, owned: DataFrame, force: bool) -> dict:
        out = self.plan(artifacts, mappings, owned, force)
        return {**out, **self.patch.apply(out["batch"])}
