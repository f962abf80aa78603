"""Streaming twins: refreshing an index as files arrive, and folding the journal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refresh(stream: DataFrame, checkpoint: str, build: Callable[[], object], once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Run `build` for each batch of arrivals; batches are at least `every` apart, and arrivals in between are one batch.

    once: take what is there and stop. R4: stop() and awaitTermination() of the query.
    """

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()


def upsert(stream: DataFrame, checkpoint: str, target: str, once: bool = True) -> StreamingQuery:
    """Keep at `target` the hash of the highest version of each path, whichever batch it came in; ties go to the greater hash.

    Each batch writes a directory of its own, named by its number; the one before the last is removed.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("path", "version", "hash")
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{target}/{number - 1}").select("path", "version", "hash"))
        rows.groupBy("path").agg(F.max(F.struct("version", "hash")).alias("last")).select("path", "last.hash", "last.version").write.mode("overwrite").parquet(f"{target}/{number}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{number - 2}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="10 seconds").start()


def watch(spark: SparkSession, directory: str, schema: str, glob: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(directory)


STATE = "status string, at timestamp, expires_at timestamp"


def journal_state(events: DataFrame, retention: dict[str, int]) -> DataFrame:
    """R6 on a stream of (id, at, event): the state of each touched entry, emitted at each batch (update mode)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, at, expires = state.get if state.exists else ("open", None, None)
        rows = pd.concat(list(batches)).sort_values(["at", "event"])
        for r in rows.itertuples(index=False):
            if r.event in ("new", "note"):
                status, expires = "open", None
            elif r.event in retention:
                status, expires = r.event, r.at + pd.Timedelta(days=retention[r.event])
            elif r.event == "keep":
                expires = None
            at = r.at
        state.update((status, at, expires))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "at": [at], "expires_at": pd.Series([expires], dtype="datetime64[ns]")})

    kind = dict(events.dtypes)["id"]
    return events.groupBy("id").applyInPandasWithState(step, f"id {kind}, {STATE}", STATE, "update", "NoTimeout")
