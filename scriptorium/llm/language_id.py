"""Language identification of words in code-switched text: a linear-chain CRF.

Each word's states are the learned languages. Emissions are affix, character
n-gram and whole-word (lexicon) features, hashed into weight tables; learned
transitions join neighbouring words. Forward-backward gives every word's
posterior; a document's language is the one with the largest mean posterior,
and that mean is its score. The chain over a block of words is evaluated by
blocks of transfer matrices, exactly, with a restart at each document.

Training maximises the chain likelihood on code-switched sequences, stitched
from word runs of a bounded sample of labelled documents.

Cases: null, empty or letterless texts give `und` and score 0. With no
labelled row every text is `und`. Repeated rows score alike; extra columns are
ignored. Numbers and symbols are separators and carry no label. Texts of any
length are read whole, in blocks of bounded size; of languages with equal mean
posterior the first in order is taken; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textblock import NON_LETTER, U64, Block, encoded, gather, lowered, slices, sums

ORDERS = (1, 2, 3, 4)
_BITS = 16
_RUN = 128


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    words: np.ndarray
    change: np.ndarray
    begin: np.ndarray


def _indices(texts: list[bytes]):
    """Features of the distinct words of the texts, which of them each word is, and the first word of each text.

    The features are a hash for each window of each n-gram order, with the
    windows of each word, and a hash of the whole word.
    """
    block = Block([lowered(t) for t in texts], fold=True)
    ws, we = block.spans(NON_LETTER)
    _, at, which = np.unique(block.hashes(block.prefix(), ws, we), return_index=True, return_inverse=True)
    data, offset = gather(block.data, ws[at] - 1, we[at])
    data[offset[:-1]] = 32
    data = np.append(data, np.uint8(32))
    start, end = offset[:-1] + 1, offset[1:]
    prefix = block.prefix(data)
    grams = []
    for n in ORDERS:
        windows = np.arange(len(data) - n + 1) if len(data) >= n else np.zeros(0, np.int64)
        h = (block.hashes(prefix, windows, windows + n) >> U64(64 - _BITS)).astype(np.int32)
        lo, hi = (start, end) if n == 1 else (start - 1, end + 2 - n)
        lo = np.minimum(lo, len(h))
        grams.append((h, lo, np.maximum(np.minimum(hi, len(h)), lo)))
    word = (block.hashes(prefix, start, end) >> U64(64 - _BITS)).astype(np.int32)
    return grams, word, which, block.per_text(ws)


def _emissions(model: Model, grams, word) -> np.ndarray:
    """Of the distinct words."""
    out = model.words[word].astype(np.float64)
    for k, (h, lo, hi) in enumerate(grams):
        for j in range(out.shape[1]):
            total = np.concatenate(([0.0], np.cumsum(model.grams[k, j][h], dtype=np.float64)))
            out[:, j] += total[hi] - total[lo]
    return out


def posteriors(unary: np.ndarray, change: np.ndarray, begin: np.ndarray, restart: np.ndarray, pairs: bool = False):
    """Forward-backward over concatenated chains; restart marks each chain's first word. Returns the posteriors, and the expected transitions if asked."""
    n, size = unary.shape
    real = np.float64 if pairs else np.float32
    e = (np.exp(unary - unary.max(1, keepdims=True)) + 1e-6).astype(real)
    move, init = np.exp(change - change.max()).astype(real), np.exp(begin - begin.max()).astype(real)
    blocks = -(-n // _RUN)
    pad = blocks * _RUN - n
    e = np.ascontiguousarray(np.concatenate((e, np.ones((pad, size), real))).reshape(blocks, _RUN, size).transpose(1, 0, 2))
    r = np.concatenate((restart, np.ones(pad, bool))).reshape(blocks, _RUN)
    again = [np.flatnonzero(r[:, t]) for t in range(_RUN)]
    x = np.broadcast_to(np.eye(size, dtype=real), (blocks, size, size)).copy()
    for t in range(_RUN):
        step = (x.reshape(-1, size) @ move).reshape(x.shape)
        if len(i := again[t]):
            step[i] = x[i].sum(2, keepdims=True) * init
        x = step * e[t][:, None, :]
        if t % 4 == 3:
            x /= x.reshape(blocks, -1).sum(1)[:, None, None]
    ahead, behind = np.empty((blocks, size)), np.empty((blocks, size))
    v = np.full(size, 1 / size)
    for b in range(blocks):
        ahead[b] = v
        v = v @ x[b]
        v /= v.sum()
    v = np.full(size, 1 / size)
    for b in range(blocks - 1, -1, -1):
        behind[b] = v
        v = x[b] @ v
        v /= v.sum()
    alpha = np.empty((_RUN, blocks, size), real)
    a = ahead.astype(real)
    for t in range(_RUN):
        step = a @ move
        if len(i := again[t]):
            step[i] = a[i].sum(1, keepdims=True) * init
        a = step * e[t]
        a /= a.sum(1)[:, None]
        alpha[t] = a
    post = np.empty((_RUN, blocks, size), real)
    back = np.empty((blocks, _RUN, size)) if pairs else None
    b = behind.astype(real)
    for t in range(_RUN - 1, -1, -1):
        post[t] = alpha[t] * b
        eb = e[t] * b
        if pairs:
            back[:, t] = eb
        b = eb @ move.T
        if len(i := again[t]):
            b[i] = (eb[i] * init).sum(1, keepdims=True)
        b /= b.sum(1)[:, None]
    post /= post.sum(2, keepdims=True)
    post = post.transpose(1, 0, 2).reshape(-1, size)[:n]
    if not pairs:
        return post, None
    left = alpha.transpose(1, 0, 2).reshape(-1, size)[: n - 1]
    right = back.reshape(-1, size)[1:n]
    joint = left[:, :, None] * move * right[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return post, joint[~restart[1:]].sum(0)


def train(texts: list[str], gold: list[str], sequence_words: int = 200, words_per_language: int = 25000, steps: int = 30, seed: int = 1) -> Model:
    """Fit on code-switched sequences made of word runs of the texts."""
    languages = sorted(set(gold))
    size = len(languages)
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, list[str]]] = []
    for k, language in enumerate(languages):
        left = words_per_language
        own = [t for t, g in zip(texts, gold) if g == language]
        for i in rng.permutation(len(own)):
            words, at = own[i].split(), 0
            while at < len(words) and left > 0:
                n = int(rng.integers(3, 40))
                runs.append((k, words[at : at + n]))
                at += n
                left -= n
    order = rng.permutation(len(runs))
    # Neighbouring runs mostly stay in one language, as in real code-switching.
    order = sorted(order, key=lambda i: (i % max(1, len(runs) // 12), runs[i][0], rng.random()))
    pieces, labels = [], []
    for i in order:
        pieces.append((" ".join(runs[i][1])).encode())
        labels.append(runs[i][0])
    grams, word, which, first = _indices(pieces)
    y = np.repeat(np.array(labels, np.int64), np.diff(first))
    n = len(y)
    restart = np.zeros(n, bool)
    restart[::sequence_words] = True
    model = Model(languages, np.zeros((len(ORDERS), size, 1 << _BITS), np.float32), np.zeros((1 << _BITS, size), np.float32), np.zeros((size, size)), np.zeros(size))
    if n < 2 or size < 2:
        return model
    flat = []
    for h, lo, hi in grams:
        length = hi - lo
        own = np.repeat(np.arange(len(word)), length)
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        flat.append((own, h[where]))
    target = np.eye(size)[y]
    seen = np.zeros((size, size))
    inner = np.flatnonzero(~restart[1:])
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    parts = [model.grams, model.words, model.change, model.begin]
    squares = [np.zeros(p.shape, np.float32) for p in parts]
    for _ in range(steps):
        post, joint = posteriors(_emissions(model, grams, word)[which], model.change, model.begin, restart, pairs=True)
        each = target - post
        d = np.stack([np.bincount(which, each[:, j], len(word)) for j in range(size)], 1)
        slope_grams = np.stack([np.stack([np.bincount(h, d[own, j], 1 << _BITS) for j in range(size)]) for own, h in flat])
        slope_words = np.stack([np.bincount(word, d[:, j], 1 << _BITS) for j in range(size)], 1)
        slopes = [slope_grams - 0.05 * parts[0], slope_words - 0.3 * parts[1], seen - joint - 0.1 * parts[2], each[restart].sum(0) - 0.1 * parts[3]]
        for p, g, s in zip(parts, slopes, squares):
            s += (g * g).astype(s.dtype)
            p += (0.3 * g / (np.sqrt(s) + 1.0)).astype(p.dtype)
    return model


def fit(docs: DataFrame, keep=None, rows_per_language: int = 200, max_languages: int = 64, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """Fit on at most rows_per_language labelled documents of each language, chosen by a hash of the id."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).where("lang is not null and text is not null and _id is not null")
    if keep is not None:
        rows = docs.where(keep).select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).where("lang is not null and text is not null and _id is not null")
    known = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages + 1).collect()]
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    texts, gold = [], []
    light = rows.select("_id", "lang")
    chosen = None
    for language in sorted(known):
        part = light.where(F.col("lang") == language).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_language)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is not None:
        picked = rows.join(F.broadcast(chosen.select("_id").distinct()), "_id", "left_semi").limit(4 * rows_per_language * len(known))
        got = picked.toPandas().sort_values(["_id", "text"], kind="stable")
        texts, gold = got["text"].tolist(), got["lang"].tolist()
    return train(texts, gold)


def label_words(model: Model, texts: list[bytes]):
    """Posteriors of every word of every text, and the first word of each text."""
    grams, word, which, first = _indices(texts)
    if not len(which) or not model.languages:
        return np.zeros((len(which), len(model.languages))), first
    restart = np.zeros(len(which), bool)
    restart[first[:-1][first[:-1] < len(which)]] = True
    post, _ = posteriors(_emissions(model, grams, word).astype(np.float32)[which], model.change, model.begin, restart)
    return post, first


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every whole text; a switch is a change of the most likely language between words."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts, 2 << 20):
                own, m = texts[a:b], shared.value
                post, first = label_words(m, own)
                words = np.diff(first)
                mean = sums(post, first) / np.maximum(words, 1)[:, None]
                best = mean.argmax(1) if len(m.languages) else np.zeros(len(own), int)
                top = post.argmax(1) if post.size else np.zeros(len(post), int)
                turn = np.zeros(len(top))
                turn[1:] = top[1:] != top[:-1]
                turn[first[:-1][first[:-1] < len(top)]] = 0
                known = [bool(w) and bool(m.languages) and (mean[i].sum() > 0) and _has_letter(own[i]) for i, w in enumerate(words)]
                names = [m.languages[best[i]] if k else "und" for i, k in enumerate(known)]
                value = [float(min(1.0, mean[i, best[i]])) if k else 0.0 for i, k in enumerate(known)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names), pa.array(value), pa.array(words.astype(np.int64)), pa.array(sums(turn, first).astype(np.int64))], ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_words bigint, n_switches bigint")
