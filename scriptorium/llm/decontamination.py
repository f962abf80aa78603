"""Benchmark decontamination: size-partitioned MinHash containment search.

Each benchmark item is a set of w-word shingles; an item's sketch is its
k = floor((1 - t) * n) + 1 smallest of n shingle hashes. A document that holds
a share t of the shingles misses at most floor((1 - t) * n) of them, so it
holds one of the sketch: a bottom-k MinHash search that loses no item at any
document length. Items are partitioned by size (powers of two). A partition's
largest sketch hash is its cutoff: of a document, only the hashes below the
cutoff, its own sketch for items of that size, are looked up. Sketches of
large items reach a fifth of the hash range, so long items cost a fifth of a
document; only the partitions of short items look at most of it. Candidates
are then verified by exact containment of the shingles, compared as words.

Items with equal words are one item, which is verified once. `search` reports
each of them, or with expand=False the smallest item_id alone, with the number
of copies (`item_classes` names them): so copies multiply no rows.

The index of a benchmark of up to block_bytes is broadcast and the documents
are read once. A larger benchmark goes through the driver in blocks of that
size, one at a time: first a bitmap of fixed size takes the sketch hashes of
all blocks, one pass over the documents keeps those that hit it, and only
these are searched block by block.

Words are lower-cased runs of letters and digits, so punctuation and line
breaks inside a passage do not hide it. An item of fewer than w words is one
shingle of all its words. Cases: items or documents that are null or have no
words match nothing; documents of any length are read whole; repeated rows are
reported each, whatever the size of blocks; an empty benchmark or table gives no rows; extra columns are
ignored by `search` and passed through by `remove_contaminated`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare, release
from .textblock import NON_ALNUM, U64, Block, encoded, lowered, mix, slices

_STEP = U64(0xA24BAED4963EE407)
SCHEMA = "doc_id bigint, item_id bigint, n_shingles int, n_found int, containment double, item_copies int"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def words_of(text: bytes) -> list[bytes]:
    return re.findall(rb"[a-z0-9\x80-\xff]+", lowered(text).lower())


def shingles_of(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def _rows(texts: list[bytes], widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width: hash of every shingle, and the text it is in."""
    block = Block([lowered(t) for t in texts], fold=True)
    ws, we = block.spans(NON_ALNUM)
    h = block.hashes(block.prefix(), ws, we)
    of = np.repeat(np.arange(block.n, dtype=np.int32), np.diff(block.per_text(ws)))
    for width in widths:
        n = len(h) - width + 1
        if n <= 0:
            continue
        total = np.zeros(n, U64)
        for k in range(width):
            total = total * _STEP + h[k : k + n]
        inside = of[: n] == of[width - 1 :] if width > 1 else np.ones(n, bool)
        yield width, mix(total)[inside], of[:n][inside]


class Index:
    """Sketches of a block of items, by size: sorted arrays of hashes and the items that each stands for."""

    def __init__(self, items: list[tuple[int, bytes, int]], width: int, threshold: float):
        self.threshold, self.sets, self.ids, self.copies, self.widths = threshold, [], [], [], []
        for item, text, copies in sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            words = words_of(text)
            self.ids.append(item)
            self.copies.append(copies)
            self.sets.append(shingles_of(words, width))
            self.widths.append(min(width, len(words)))
        held: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i, found in enumerate(self.sets):
            h = np.unique(np.concatenate([x for _, x, _ in _rows([b" ".join(s) for s in found], [self.widths[i]])]))
            held[self.widths[i], len(found).bit_length()].append((h[: int((1 - threshold) * len(found) + 1e-9) + 1], i))
        #: (shingle width, cutoff, filter, hashes, owners) of each partition.
        self.parts = []
        for (w, _), sketches in sorted(held.items()):
            hashes = np.concatenate([h for h, _ in sketches])
            owner = np.repeat([i for _, i in sketches], [len(h) for h, _ in sketches])
            order = np.argsort(hashes, kind="stable")
            filter_ = np.zeros(1 << 20, bool)
            filter_[(hashes >> U64(44)).astype(np.int64)] = True
            self.parts.append((w, hashes.max(), filter_, hashes[order], owner[order]))

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, shingles found) of every match."""
        candidates: dict[int, set[int]] = defaultdict(set)
        for width, all_h, all_of in _rows(texts, sorted(set(self.widths))):
            for w, cutoff, filter_, hashes, owner in self.parts:
                if w != width:
                    continue
                at = np.flatnonzero((all_h <= cutoff) & filter_[(all_h >> U64(44)).astype(np.int64)])
                h, of = all_h[at], all_of[at]
                lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for j in np.flatnonzero(hi > lo):
                    candidates[int(of[j])].update(owner[lo[j] : hi[j]].tolist())
        for d in sorted(candidates):
            words = words_of(texts[d])
            have: dict[int, set] = {}
            for i in sorted(candidates[d]):
                width = self.widths[i]
                if width not in have:
                    have[width] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
                found = len(self.sets[i] & have[width])
                if found >= self.threshold * len(self.sets[i]) - 1e-9:
                    yield d, i, len(self.sets[i]), found


def _worded(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(item_id, words): the words of every item, space-joined; items without words are left out."""

    def run(batches):
        for batch in batches:
            words = [b" ".join(words_of(t)) for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["item_id", "words"])

    prepare(benchmark.sparkSession)
    return benchmark.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(text_column).alias("text")).mapInArrow(run, "item_id bigint, words binary").where("length(words) > 0")


def distinct_items(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, words, copies): one item for all of equal words, the smallest id. Made before blocks are cut, so results do not depend on those."""
    rows = _worded(benchmark, item_column, text_column)
    return cut(rows.groupBy(F.sha2("words", 256).alias("key")).agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"), F.count("*").cast("int").alias("copies")).select("item_id", "words", "copies"))


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Distinct items in blocks of at most block_bytes of text (one item at least), streamed from the table."""
    held, size = [], 0
    for row in items.toLocalIterator():
        text = bytes(row["words"])
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text, row["copies"]))
        size += len(text)
    if held:
        yield held


class Sieve:
    """A bitmap of the sketch hashes of all blocks, of fixed size."""

    def __init__(self, bits: int = 27):
        self.bits, self.widths, self.seen = bits, set(), np.zeros(1 << bits >> 3, np.uint8)

    def add(self, index: Index) -> None:
        for w, _, _, hashes, _ in index.parts:
            self.widths.add(w)
            at = hashes >> U64(64 - self.bits)
            np.bitwise_or.at(self.seen, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))

    def hits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for _, h, of in _rows(texts, sorted(self.widths)):
            at = h >> U64(64 - self.bits)
            out[of[self.seen[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & np.uint8(1) > 0]] = True
        return out


def _keep(docs: DataFrame, text_column: str, chosen) -> DataFrame:
    """The rows, with all columns, of which chosen(shared)(texts) is true; chosen is a broadcast and what to ask of it."""
    shared, ask = chosen
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(at))
            for a, b in slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(ask(shared.value, texts[a:b])))

    return docs.mapInArrow(run, docs.schema)


def _indexes(items: DataFrame, width: int, threshold: float, block_bytes: int) -> Iterator[Index]:
    return (Index(block, width, threshold) for block in blocks_of(items, block_bytes))


def _clean(index: Index, texts: list[bytes]) -> np.ndarray:
    out = np.ones(len(texts), bool)
    out[[d for d, *_ in index.search(texts)]] = False
    return out


def _found(light: DataFrame, shared) -> DataFrame:
    def run(batches):
        index = shared.value
        for batch in batches:
            texts = encoded(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(texts):
                got = [(ids[a + d], index.ids[i], n, k, k / n, index.copies[i]) for d, i, n, k in index.search(texts[a:b])]
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], _COLUMNS)

    return light.mapInArrow(run, SCHEMA)


def search(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", expand: bool = True) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, item_copies) of every document and item with containment >= threshold."""
    prepare(docs.sparkSession)
    light = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast
    items = distinct_items(benchmark, item_column, item_text_column)
    indexes = lambda: _indexes(items, width, threshold, block_bytes)
    first = list(islice(indexes(), 2))
    if not first:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    if len(first) < 2:
        out = _found(light, spread(first[0]))
    else:
        suspects, out = _suspects(light, "text", indexes())[0], None
        for index in indexes():
            shared = spread(index)
            part = cut(_found(suspects, shared))
            shared.destroy()
            out = part if out is None else out.unionByName(part)
    if not expand:
        return out
    classes = item_classes(benchmark, item_column, item_text_column).withColumnRenamed("item_id", "_every")
    return out.join(classes, out["item_id"].eqNullSafe(classes["class_id"])).select("doc_id", F.col("_every").alias("item_id"), *_COLUMNS[2:])


def _suspects(docs: DataFrame, text_column: str, indexes: Iterator[Index]) -> tuple[DataFrame, DataFrame]:
    """The documents that hit the sketch of some item, written once, and all others."""
    sieve = Sieve()
    for index in indexes:
        sieve.add(index)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    return cut(_keep(docs, text_column, (shared, Sieve.hits))), _keep(docs, text_column, (shared, lambda s, texts: ~s.hits(texts)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents, with their columns, that contain no benchmark item."""
    prepare(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast
    items = distinct_items(benchmark)
    indexes = lambda: _indexes(items, width, threshold, block_bytes)
    first = list(islice(indexes(), 2))
    if len(first) < 2:
        return _keep(docs, "text", (spread(first[0]), _clean)) if first else docs
    left, others = _suspects(docs, "text", indexes())
    for index in indexes():
        shared = spread(index)
        after = cut(_keep(left, "text", (shared, _clean)))
        shared.destroy()
        release(left)
        left = after
    return others.unionByName(left)


def item_classes(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, class_id): items of equal words and the smallest item_id among them; items without words are left out."""
    keyed = cut(_worded(benchmark, item_column, text_column).select("item_id", F.sha2("words", 256).alias("words")))
    return keyed.join(keyed.groupBy("words").agg(F.min("item_id").alias("class_id")), "words").select("item_id", "class_id")
