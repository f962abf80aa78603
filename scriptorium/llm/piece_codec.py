"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text gets a leading space, spaces become the meta symbol, and symbols are
merged best score first (leftmost on ties). With dropout p every candidate
merge (a span of two neighbouring symbols) is skipped when its keyed hash of
(seed, chunk, draw, span) falls below p, whichever way the agenda comes to
it; so a seed fixes the segmentation, and other seeds give others. p = 0 is
the plain encoding. Each occurrence of a chunk (a run of spaces and what
follows it) has its own draw, a hash of (seed, doc_id, ordinal).

No piece has a space after another character, so chunks are independent.
Distinct chunks of a block are merged once without dropout; an occurrence
whose draw skips none of those merges has that segmentation, and all others
are merged by themselves. Chunks of up to 256 characters are merged side by
side in numpy, longer ones from a heap, so that a text without a space costs
n log n. Characters outside the vocabulary, and the meta symbol itself when it
stands in a text, become byte pieces. Decoding therefore returns every text
exactly.

Cases: null encodes like the empty text, to no pieces; decoding gives the
empty text. Texts of any length are encoded whole. Ties of score go to the
leftmost pair. An empty table gives no rows. Repeated rows with one doc_id encode alike. A null doc_id counts
as zero. Extra columns are ignored by encode and carried by none.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textblock import BYTE_CODE, U64, _power, encoded, gather, mix, slices

_META = "▁"
_NONE = np.int64(1) << np.int64(60)
#: Chunks of more characters than this have a heap as their agenda; shorter ones are merged side by side.
_LONG = 256
_ALL = (1 << 64) - 1


def _mixed(h: int) -> int:
    """textblock.mix of one number."""
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & _ALL
    return h ^ h >> 29


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Codec:
    """Lookup tables of one SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
        if any(_META in p.lstrip(_META) for p in plain):
            raise ValueError("a piece has a space after another character; chunks would not be independent")
        rank = np.zeros(size, np.int64)
        rank[sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))] = np.arange(len(plain))
        self.rank = rank
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in plain and p[k:] in plain:
                    pairs[plain[p[:k]] * size + plain[p[k:]]] = i
        self.size, self.pairs = size, pairs
        # Open addressing, an eighth full at most; the last slots take what is pushed beyond the end.
        self.shift = U64(64 - max(4, (8 * len(pairs)).bit_length()))
        keys, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.keys, self.merged = np.full((1 << 64 - int(self.shift)) + 64, -2, np.int64), np.full((1 << 64 - int(self.shift)) + 64, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -2]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] += 1
        self.merged[at] = merged
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[0x20] = self.char[ord(_META)]
        self.char[ord(_META)] = -1
        out = [bytes([int(pieces[i][3:5], 16)]) if sp.is_byte(i) else b"" if special[i] else pieces[i].replace(_META, " ").encode() for i in range(size)]
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(U64) * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        key = np.where((left < 0) | (right < 0), np.int64(-1), left * self.size + right)
        at = self._slot(key)
        seen = self.keys[at]
        more = np.flatnonzero((seen != key) & (seen != -2))
        while len(more):
            at[more] += 1
            seen = self.keys[at[more]]
            more = more[(seen != key[more]) & (seen != -2)]
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def _long(self, symbol: list[int], salt: int, limit: int) -> tuple[list[int], list[int], list[int]]:
        """One long chunk, merged from a heap: (places that stay, their pieces, spans of the merges)."""
        n, size, pairs, rank = len(symbol), self.size, self.pairs, self.rank
        end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap: list[tuple[int, int, int, int, int]] = []
        spans = []

        def offer(a: int) -> None:
            b = end[a]
            if b >= n or symbol[a] < 0 or symbol[b] < 0:
                return
            made = pairs.get(symbol[a] * size + symbol[b])
            if made is not None and not (limit and _mixed(_mixed(salt + (a << 42) + (b << 21) + end[b] & _ALL)) < limit):
                heapq.heappush(heap, (int(rank[made]), a, b, end[b], made))

        for a in range(n):
            offer(a)
        while heap:
            _, a, b, c, made = heapq.heappop(heap)
            # A pair whose sides have changed since is out of date.
            if not live[a] or end[a] != b or end[b] != c:
                continue
            spans.append((a << 42) + (b << 21) + c & _ALL)
            symbol[a], end[a], live[b] = made, c, 0
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        stay = [a for a in range(n) if live[a]]
        return stay, [symbol[a] for a in stay], spans

    def segment(self, data: np.ndarray, offset: np.ndarray, salt: np.ndarray, dropout: float, made_of: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of chunks (byte ranges of data), one after another, and the offset of each. made_of takes (chunk, span) of every merge, the span as the skip hash has it."""
        head = (data & 0xC0) != 0x80
        at = np.flatnonzero(head)
        n, chunks = len(at), len(offset) - 1
        first = np.searchsorted(at, offset)
        b = [np.concatenate((data, np.zeros(3, np.uint8)))[at + k].astype(np.int64) for k in range(4)]
        code = np.select(
            [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
            [b[0], (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F],
            (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F,
        )
        symbol = np.append(self.char[np.minimum(code, 0x10FFFF)].astype(np.int64), -1)
        of = np.repeat(np.arange(chunks), np.diff(first))
        place = np.arange(n) - first[of]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[first[1:] - 1] = n
        before[first[:-1]] = n
        end = np.append(place + 1, 0)
        limit = U64(min(int(dropout * 2.0**64), 2**64 - 1))
        live = np.ones(n, bool)

        def value(left: np.ndarray) -> np.ndarray:
            """Agenda key of the pair that starts at left: rank, then place; _NONE if there is no merge or it is dropped."""
            right = after[left]
            made = self.join(symbol[left], symbol[right])
            key = self.rank[made] << 24 | place[left]
            if dropout > 0:
                h = salt[of[left]] + (place[left].astype(U64) << U64(42)) + (end[left].astype(U64) << U64(21)) + end[right].astype(U64)
                made = np.where(mix(mix(h)) < limit, -1, made)
            return np.where(made < 0, _NONE, key)

        sizes = np.diff(first)
        for k in np.flatnonzero(sizes > _LONG).tolist():
            lo, hi = int(first[k]), int(first[k + 1])
            stay, made, spans = self._long(symbol[lo:hi].tolist(), int(salt[k]), int(limit) if dropout > 0 else 0)
            live[lo:hi] = False
            live[lo + np.array(stay)] = True
            symbol[lo + np.array(stay)] = made
            if made_of is not None:
                made_of.append((np.full(len(spans), k), np.array(spans, U64)))
        todo = np.flatnonzero(sizes <= _LONG)
        agenda = np.full(n, _NONE)
        short = np.flatnonzero(np.repeat(sizes <= _LONG, sizes))
        agenda[short] = value(short)
        while len(todo):
            width = first[todo + 1] - first[todo]
            edge = np.concatenate(([0], np.cumsum(width)[:-1]))
            spread = np.repeat(first[todo] - edge, width) + np.arange(width.sum())
            best = np.minimum.reduceat(agenda[spread], edge)
            more = best < _NONE
            todo = todo[more]
            if not len(todo):
                break
            # A chunk keeps its slots; several merges are made before the agenda of the rest is gathered anew.
            left = first[todo] + (best[more] & 0xFFFFFF)
            right = after[left]
            far = after[right]
            if made_of is not None:
                made_of.append((todo, (place[left].astype(U64) << U64(42)) + (end[left].astype(U64) << U64(21)) + end[right].astype(U64)))
            symbol[left] = self.join(symbol[left], symbol[right])
            end[left] = end[right]
            live[right] = False
            agenda[right] = _NONE
            after[left] = far
            inner = far < n
            before[far[inner]] = left[inner]
            agenda[left] = value(left)
            ahead = before[left]
            ahead = ahead[ahead < n]
            agenda[ahead] = value(ahead)
        keep = np.flatnonzero(live)
        ids = symbol[keep]
        raw = ids < 0
        width = np.ones(len(keep), np.int64)
        span = np.append(at, len(data))
        width[raw] = span[keep[raw] + 1] - span[keep[raw]]
        out_at = np.concatenate(([0], np.cumsum(width)))
        out = np.empty(out_at[-1], np.int32)
        out[out_at[:-1][~raw]] = ids[~raw]
        where, _ = gather(np.arange(len(out)), out_at[:-1][raw], out_at[1:][raw])
        bytes_of, _ = gather(data, span[keep[raw]], span[keep[raw] + 1])
        out[where] = self.byte_id[bytes_of]
        return out, out_at[np.searchsorted(keep, first)]

    def encode(self, texts: list[bytes], ids: np.ndarray, dropout: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after another, and the offset of each text."""
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        start = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = data == 32
        fresh = space.copy()
        fresh[1:] &= ~space[:-1]
        fresh[start[:-1][sizes > 0]] = True
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(data))
        up, down = _power(len(data) + 1)
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODE[data] * up[:-1], out=prefix[1:])
        h = mix((prefix[stop] - prefix[begin]) * down[begin])
        first = np.searchsorted(begin, start)
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        chunk, offset = gather(data, begin[at], stop[at])
        merges: list = []
        made, made_at = self.segment(chunk, offset, np.zeros(len(at), U64), 0.0, merges if dropout > 0 else None)
        if merges:
            of = np.repeat(np.arange(len(texts)), np.diff(first))
            ordinal = (np.arange(len(begin)) - first[of]).astype(U64)
            draw = mix(mix(ids.astype(np.int64).view(U64)[of] * U64(0x9E3779B97F4A7C15) + U64(seed)) + ordinal)
            salt = mix(h + (draw + U64(1)) * U64(0xC2B2AE3D27D4EB4F)) + mix(np.array([seed], np.int64).view(U64))
            # An occurrence that drops no merge of the plain segmentation has that one; the others are merged one by one.
            owner, span = (np.concatenate(x) for x in zip(*merges))
            order = np.argsort(owner, kind="stable")
            edge = np.searchsorted(owner[order], np.arange(len(at) + 1))
            spans, span_at = gather(span[order], edge[which], edge[which + 1])
            who = np.repeat(np.arange(len(which)), np.diff(span_at))
            limit = U64(min(int(dropout * 2.0**64), 2**64 - 1))
            hit = np.unique(who[mix(mix(salt[who] + spans)) < limit])
            if len(hit):
                chunk, offset = gather(data, begin[hit], stop[hit])
                more, more_at = self.segment(chunk, offset, salt[hit], dropout)
                which = which.copy()
                which[hit] = len(at) + np.arange(len(hit))
                made_at = np.concatenate((made_at, made_at[-1] + more_at[1:]))
                made = np.concatenate((made, more))
        out, out_at = gather(made, made_at[which], made_at[which + 1])
        return out, out_at[first]

    def decode(self, ids: np.ndarray, offset: np.ndarray) -> list[bytes]:
        """The texts of the piece ids."""
        data, at = gather(self.bytes, self.offset[ids], self.offset[ids + 1])
        raw, edge = data.tobytes(), at[offset].tolist()
        return [raw[a + 1 : b] for a, b in zip(edge, edge[1:])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


_LIMIT = 1 << 20


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, lossless): the pieces of every whole text; lossless tells that decoding gave the text again."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, _LIMIT):
                c = codec(model_path)
                ids, offset = c.encode(texts[a:b], keys[a:b], dropout, seed)
                same = [x == y for x, y in zip(c.decode(ids, offset), texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(ids)), pa.array(same)], ["doc_id", "ids", "lossless"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, lossless boolean")


def decode(pieces: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    prepare(pieces.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            offset = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            texts = codec(model_path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts])], ["doc_id", "text"])

    return pieces.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, lossless): as encode, with the pieces (little-endian 32-bit ids) reduced to a digest."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(texts, _LIMIT):
                c = codec(model_path)
                ids, offset = c.encode(texts[a:b], keys[a:b], dropout, seed)
                same = [x == y for x, y in zip(c.decode(ids, offset), texts[a:b])]
                sha = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(offset[:-1], offset[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offset)), pa.array(sha), pa.array(same)], ["doc_id", "n_pieces", "ids_sha256", "lossless"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_pieces bigint, ids_sha256 string, lossless boolean")
