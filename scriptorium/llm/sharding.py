"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows are numbered globally in the order of (id, size, crc32), the row number
is permuted over [0, n), and position p goes to shard p mod k, slot p div k.
Shard and slot of any row are computable from its number alone, and so is the
row at any slot (`unpermute`). Shards differ by one row at most.

The Feistel network works on pairs (L, R) of Z_a x Z_b with a = ceil(sqrt n),
b = ceil(n / a), so its domain a * b exceeds n by less than a; values >= n
walk on along their cycle until they fall below n.

Only id, size and checksum are shuffled, never the text. The numbering is cut
in the shared checkpoint folder, so a lost executor cannot renumber rows.

Cases: a null text has no bytes; null ids come first; rows that agree in id,
size and checksum are interchangeable and get neighbouring numbers; texts of
any length are measured whole, where they are read; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

ROUNDS = 6
_WALK = 64


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, n: int, seed: int, back: bool = False) -> Column:
    a, b = _sides(n)
    state = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).alias("r"))
    # An aggregate over the round numbers keeps the expression linear in the rounds.
    turns = F.array(*[F.lit(t) for t in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def step(s: Column, t: Column) -> Column:
        sign = -1 if back else 1
        left = F.pmod(s["l"] + sign * (F.shiftrightunsigned(F.xxhash64(s["r"], t, F.lit(seed)), 1) % a), F.lit(a).cast("long"))
        right = F.pmod(s["r"] + sign * (F.shiftrightunsigned(F.xxhash64(s["l"], t, F.lit(seed)), 1) % b), F.lit(b).cast("long"))
        even = t % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    out = F.aggregate(turns, state, step)
    return out["l"] * b + out["r"]


def permute(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """Image of x under the permutation of [0, n) (its preimage with back)."""
    once = _network(x, n, seed, back)
    outside = _sides(n)[0] * _sides(n)[1] - n
    if outside:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, _WALK))), once, lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, back)))
        # At most `outside` steps are ever needed; beyond _WALK the odds are n ** -(_WALK / 2), and such a row stops the job.
        once = walked if outside <= _WALK else F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    return once


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with a gapless global `row_number` from 0 in the given order, and their count."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition number in the upper 31 bits, place in the lower 33.
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["_n"]
    if not offsets:
        return placed.withColumn("row_number", F.lit(0).cast("long")).drop("_at"), 0
    # One row for each partition, so this table is as small as the scheduler's own.
    known = rows.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(known), "_part")
    return numbered.withColumn("row_number", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_offset"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 2024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_column), F.lit(""))
    light = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered, total = number_rows(light, ["doc_id", "size", "text_crc32"])
    place = numbered.withColumn("_p", permute(F.col("row_number"), max(total, 1), seed))
    return place.select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))


def unpermute(positions: DataFrame, column: str, total: int, seed: int = 2024) -> DataFrame:
    """positions with `row_number`: which row stands at that place of the shuffle."""
    return positions.withColumn("row_number", permute(F.col(column).cast("long"), total, seed, back=True))
