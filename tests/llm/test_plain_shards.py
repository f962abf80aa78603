"""Sharding against a plain Feistel network with cycle walking."""

import math
import random
import struct
import zlib

import xxhash

from scriptorium.llm import sharding


def _hash(*values):
    """A 64-bit value and then 32-bit ones, each hashed with the hash before as its seed."""
    h = 42
    for v, form in zip(values, ("<q", "<i", "<i"), strict=True):
        h = xxhash.xxh64_intdigest(struct.pack(form, v), h)
    return h >> 1


def _place(x, n, seed):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for t in range(6):
            if t % 2 == 0:
                left = (left + _hash(right, t, seed) % a) % a
            else:
                right = (right + _hash(left, t, seed) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_plain_network(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 331):
        rows = [(rng.choice([None, *range(200)]), rng.choice([None, "", "a", "é" * rng.randrange(9), "x" * 5])) for _ in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot")
        light = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
        light.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want = sorted((*r, i, _place(i, n, 2024) % 40, _place(i, n, 2024) // 40) for i, r in enumerate((str(d), s, c) for d, s, c in light))
        got = sorted((str(r.doc_id), r.size, r.text_crc32, r.row_number, r.shard, r.slot) for r in sharding.shard(docs).collect())
        assert got == want
    assert sharding.shard(docs.limit(0)).collect() == []
