"""Point-in-time join: for each question (key, time), the strongest version of its key whose interval holds that time.

A version of a key holds from `start` to before `end`. Both sides are
partitioned by key and time chunk. Chunks are at least as wide as the
intervals in them, so a version lies in two chunks at most and is clamped to
each; widths grow by eights from `width`, and a question is asked once for
each width that occurs (nearly always one; never more than 21). In a task,
the chunks that came together are laid end to end on one time line, and
DuckDB runs one sort-based inequality join over start and end, then arg_max by
priority. Tasks work in slices of bounded size: what is kept is a slice of
versions and the distinct times that one chunk is asked about; the winners of
slices and widths are merged by Spark.

Before that, Spark keeps the strongest of the versions that agree in key,
start and end, and each (key, time) once, both summed up before the shuffle;
so a key or a moment that a third of the rows share is no load. In a slice a
version that a stronger one covers from the same start or to the same end is
left out, so the number of pairs stays in proportion.

Cases: a null key, start, end or time matches nothing, nor does an interval
that is empty; priorities compare field by field, nulls lowest; versions that
agree in all of the priority are told apart by the payload, and those that
agree in that too are one; questions are answered row by row, repeats
included, with nulls where nothing matches; empty tables give no rows or only
nulls; columns of any names pass through, internal names avoid them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, fresh, prepare

#: Rows of a slice.
SLICE = 40_000
#: Chunk widths are `width` times powers of this.
_LADDER = 8
_ROOM = 1 << 62

#: Strongest first, a version stays only if it reaches further than all stronger ones with its start, and starts before all stronger ones with its end.
_WINNERS = """
WITH wide AS (SELECT * FROM (SELECT *, max(hi) OVER (PARTITION BY lo ORDER BY priority DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM versions) WHERE far IS NULL OR hi > far),
early AS (SELECT lo, hi, priority FROM (SELECT *, min(lo) OVER (PARTITION BY hi ORDER BY priority DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM wide) WHERE near IS NULL OR lo < near)
SELECT asks.ask, arg_max(early.priority, early.priority) AS version FROM asks JOIN early ON early.lo <= asks.at AND asks.at < early.hi GROUP BY asks.ask
"""


class _Line:
    """The chunks of a task, end to end. Groups arrive in order, in each the questions before the versions, those weakest first."""

    def __init__(self) -> None:
        import duckdb

        # A slice fits in memory by far; nothing is written beside the task.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET nested_loop_join_threshold = 0; SET merge_join_threshold = 0")
        self.asks: list[tuple[pa.Table, np.ndarray]] = []
        self.versions: list[tuple[pa.Table, np.ndarray, np.ndarray]] = []
        self.held, self.kept = [0, 0], 0
        self.group = None
        self.offset = self.end = 0

    def _place(self, batch: pa.Table) -> np.ndarray:
        """The offset of each row's chunk on the line."""
        group = list(zip(*(batch[c].to_pylist() for c in ("key", "level", "chunk")), strict=True))
        width = batch["width"].to_numpy()
        offsets = np.empty(len(group), np.int64)
        for i, g in enumerate(group):
            if g != self.group:
                self.group, self.offset = g, self.end
                self.end += int(width[i])
            offsets[i] = self.offset
        return offsets

    def take(self, batch: pa.Table) -> Iterator[pa.Table]:
        width = int(np.max(batch["width"].to_numpy()))
        if self.end and self.end + len(batch) * width > _ROOM:
            yield from self.flush()
        step = max(1, min(len(batch), (_ROOM - self.end) // width))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            if at:
                yield from self.flush()
            offsets = self._place(part)
            is_version = part["kind"].to_numpy() == 1
            for kind, rows in ((0, ~is_version), (1, is_version)):
                if rows.any():
                    chosen, off = part.filter(pa.array(rows)), offsets[rows]
                    lo = chosen["lo"].to_numpy() + off
                    if kind:
                        self.versions.append((chosen, lo, chosen["hi"].to_numpy() + off))
                    else:
                        self.asks.append((chosen.select(["key", "time"]), lo))
                    self.held[kind] += len(chosen)
        if self.held[1] >= SLICE or self.held[0] >= max(SLICE, 2 * self.kept):
            yield from self.flush()

    def flush(self) -> Iterator[pa.Table]:
        """Winners among what is held. The last chunk's questions stay, its versions may go on."""
        if self.asks:
            table, at = pa.concat_tables([t for t, _ in self.asks]).combine_chunks(), np.concatenate([x for _, x in self.asks])
            if self.versions:
                held = pa.concat_tables([t for t, _, _ in self.versions]).combine_chunks()
                lo, hi = (np.concatenate([v[k] for v in self.versions]) for k in (1, 2))
                self.db.register("versions", pa.table({"lo": lo, "hi": hi, "priority": np.arange(len(lo))}))
                self.db.register("asks", pa.table({"ask": np.arange(len(at)), "at": at}))
                won = self.db.sql(_WINNERS).to_arrow_table()
                if won.num_rows:
                    yield table.take(won["ask"].combine_chunks()).append_column("won", held["won"].take(won["version"].combine_chunks()))
            last = at >= self.offset
            self.asks = [(table.filter(pa.array(last)), at[last] - self.offset)]
            self.held[0] = self.kept = int(last.sum())
        self.versions, self.held[1] = [], 0
        self.end -= self.offset
        self.offset = 0


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = _Line()
    for batch in batches:
        if batch.num_rows:
            for table in line.take(pa.Table.from_batches([batch])):
                yield from table.to_batches()
    for table in line.flush():
        yield from table.to_batches()


def point_in_time(asks: DataFrame, versions: DataFrame, key: str, time: str, start: str, end: str, priority: list[str], payload: list[str], width: int = 1024) -> DataFrame:
    """asks with the payload of the strongest version of `key` with start <= time < end, nulls where there is none.

    `key` is a column of both tables; times are whole numbers (unix_micros of a
    timestamp). `width` is best chosen as what most intervals stay below.
    Payload columns must have other names than those of asks.
    """
    spark = asks.sparkSession
    prepare(spark)
    won = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(priority)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(payload)])
    lean = versions.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), won.alias("won"))
    # Widths as powers of the ladder: the first that no interval in it exceeds.
    level = F.greatest(F.lit(0), F.ceil(F.log((F.col("end") - F.col("start")) / F.lit(float(width))) / F.log(F.lit(float(_LADDER))) - 1e-9)).cast("int")
    best = cut(lean.groupBy("key", "start", "end").agg(F.max("won").alias("won")).withColumn("level", level))
    levels = sorted(r["level"] for r in best.select("level").distinct().collect())  # 21 at most
    widths = F.create_map(*[F.lit(x) for n in levels or [0] for x in (n, min(width * _LADDER**n, _ROOM))])
    inside = best.withColumn("width", widths[F.col("level")].cast("long"))
    # Division that rounds down, below zero as well.
    chunk = lambda at: F.expr(f"({at}) div width - CAST(({at}) % width < 0 AS INT)")
    inside = inside.withColumn("chunk", F.explode(F.sequence(chunk("start"), chunk("`end` - 1"))))
    from_ = F.col("chunk") * F.col("width")
    inside = inside.select("key", "level", "chunk", "width", F.lit(1).alias("kind"), F.greatest(F.col("start") - from_, F.lit(0).cast("long")).alias("lo"), F.least(F.col("end") - from_, F.col("width")).alias("hi"), F.lit(None).cast("long").alias("time"), "won")
    asked = asks.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("long").alias("time")).distinct()
    asked = asked.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels or [0]]))).withColumn("width", widths[F.col("level")].cast("long")).withColumn("chunk", chunk("time"))
    asked = asked.select("key", "level", "chunk", "width", F.lit(0).alias("kind"), (F.col("time") - F.col("chunk") * F.col("width")).alias("lo"), F.lit(None).cast("long").alias("hi"), "time", F.lit(None).cast(inside.schema["won"].dataType).alias("won"))
    dealt = asked.unionByName(inside).repartition("key", "level", "chunk").sortWithinPartitions("key", "level", "chunk", "kind", "won")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    found = dealt.mapInArrow(_winners, f"key {kinds['key']}, time long, won {kinds['won']}").groupBy("key", "time").agg(F.max("won").alias("won"))
    k, t, w = fresh(asks, "_key", "_time", "_won")
    found = found.select(F.col("key").alias(k), F.col("time").alias(t), F.col("won").alias(w))
    met = asks.join(found.hint("merge"), (asks[key] == F.col(k)) & (asks[time].cast("long") == F.col(t)), "left")
    return met.select(*[asks[c] for c in asks.columns], *[F.col(w)[f"v{i}"].alias(c) for i, c in enumerate(payload)])
