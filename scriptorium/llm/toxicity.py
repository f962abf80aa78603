"""Multiple-instance toxicity: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. Sentence s is offending with probability
p_s = sigmoid(b + sum of word weights); the document is toxic with probability
1 - (1 - leak) * prod(1 - p_s). The leak is a cause outside the sentences; it
takes up label noise, and the bias b is held near -9, so that long clean documents
do not drift upwards.
Only document labels are needed; p_s then locates the offending sentences.

Cases: a null or empty text has no sentences and scores the leak. Repeated
rows score alike. Without any labelled row the model is the prior (leak 0.01,
no weights). Extra columns are ignored. Texts of any length are read whole; of
an id that is labelled twice the greater label counts; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textblock import NON_LETTER, U64, Block, encoded, lowered, slices, sums

_BITS = 20
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True

SCHEMA = "doc_id bigint, score double, offending array<struct<start:int,end:int,score:double>>"


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float


def _sentences(block: Block):
    """Sentence starts and ends, first sentence of each text, word buckets, first word of each sentence."""
    ss, se = block.spans(_STOPS)
    ws, we = block.spans(NON_LETTER)
    h = block.hashes(block.prefix(), ws, we) >> U64(64 - _BITS)
    return ss, se, block.per_text(ss), h.astype(np.int64), np.append(np.searchsorted(ws, ss), len(ws))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep=None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """At most `rows` labelled documents, chosen by a hash of the id: (text, label)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    return found.join(F.broadcast(chosen), "_id").orderBy("_id").limit(2 * rows).select("text", F.col("_label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_rows: int = 6000, min_documents: int = 12, evidence: float = 4.0, penalty: float = 0.05, steps: int = 100) -> Model:
    """Fit on a bounded sample: at most max_rows labelled rows (keep narrows them) are brought to the driver.

    A word gets a weight if it is in min_documents documents at least and its
    toxic ones exceed their expected number by `evidence` standard errors;
    weights start at the log odds and are then fitted through the noisy-or.
    """
    got = sample(docs, labels, label, max_rows, keep).toPandas()
    weights = np.zeros(1 << _BITS, np.float32)
    if got.empty:
        return Model(weights, -8.0, 0.01)
    texts = [lowered((t or "").encode()) for t in got["text"]]
    y = got["label"].to_numpy() > 0
    words, bounds, firsts, sentences = [], [0], [], 0
    for a, b in slices(texts):
        _, _, first, h, edge = _sentences(Block(texts[a:b], fold=True))
        words.append(h[edge[0] :] if len(edge) > 1 else h[:0])
        bounds.extend((edge[1:] - edge[0] + bounds[-1]).tolist())
        firsts.append(first[:-1] + sentences)
        sentences += int(first[-1])
    word, edge, first = np.concatenate(words), np.array(bounds), np.append(np.concatenate(firsts), sentences)
    in_doc = np.repeat(np.arange(len(texts)), np.diff(edge[first]))
    seen = np.unique(in_doc * np.int64(1 << _BITS) + word)
    first_seen = np.searchsorted(seen >> _BITS, np.arange(len(texts) + 1))
    seen &= (1 << _BITS) - 1
    df = np.bincount(seen, minlength=1 << _BITS)
    bad = np.bincount(seen, np.repeat(y, np.diff(first_seen)), 1 << _BITS)
    vocabulary = np.flatnonzero((df >= min_documents) & (bad - df * y.mean() >= evidence * np.sqrt(np.maximum(df * y.mean(), 1e-9))))
    column = np.full(1 << _BITS, -1)
    column[vocabulary] = np.arange(len(vocabulary))
    at = column[word]
    of = np.repeat(np.arange(sentences), np.diff(edge))[at >= 0]
    at = at[at >= 0]
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    x = np.zeros(len(vocabulary) + 2)
    good = (df - bad)[vocabulary]
    x[:-2] = np.log((bad[vocabulary] + 0.5) / (good + 0.5) * (1 - y.mean() + 1e-6) / (y.mean() + 1e-6))
    x[-2:] = -9.0, np.log(0.07 / 0.93)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        z = np.bincount(of, x[at], sentences) + x[-2]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 12)))
        leak = 1 / (1 + np.exp(-x[-1]))
        log_q = np.bincount(doc_of, np.log1p(-p), len(texts)) + np.log1p(-leak)
        q = np.exp(log_q)
        pull = np.where(y, q / np.maximum(1 - q, 1e-9), -1.0)
        dz = pull[doc_of] * p
        g = np.concatenate((np.bincount(at, dz[of], len(vocabulary)) - penalty * x[:-2], [dz.sum() - 200 * (x[-2] + 9)], [(pull * leak).sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[vocabulary] = x[:-2]
    return Model(weights, float(x[-2]), float(1 / (1 + np.exp(-x[-1]))))


def score_texts(model: Model, texts: list[bytes], locate: float = 0.5) -> tuple[np.ndarray, list]:
    """Document scores, and (start, end, score) in code points of the sentences that score at least `locate`."""
    low = [lowered(t) for t in texts]
    block = Block(low, fold=True)
    ss, se, first, word, edge = _sentences(block)
    z = sums(model.weights[word], edge) + model.bias
    p = 1 / (1 + np.exp(-np.clip(z, -30, 12)))
    score = 1 - np.exp(sums(np.log1p(-p), first)) * (1 - model.leak)
    spans: list = [[] for _ in texts]
    for s in np.flatnonzero(p >= locate):
        d = int(np.searchsorted(first, s, "right")) - 1
        raw, base = low[d], block.start[d]
        at = len(raw[: ss[s] - base].decode("utf-8", "ignore"))
        spans[d].append({"start": at, "end": at + len(raw[ss[s] - base : se[s] - base].decode("utf-8", "ignore")), "score": float(p[s])})
    return np.clip(score, 0, 1), spans


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", locate: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): score of every whole text, and its offending sentences."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                value, spans = score_texts(shared.value, texts[a:b], locate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(value), pa.array(spans, _SPANS)], ["doc_id", "score", "offending"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
