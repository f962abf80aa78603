"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: each round visits every feature in turn and fits a shallow
tree (two splits) on the binned residuals of that feature alone; its leaf
values are added to the feature's lookup table. Then the strongest pairs of
features get two-dimensional tables in the same way. Scoring adds up one bin
of each table and applies the logistic function: no tree is walked.

Cases: a null or empty text has all features zero and gets the score of such
texts. Repeated rows score alike. With no labelled rows, or one class only,
the tables are empty and the score is the smoothed share of label 1. Extra
columns are ignored. Texts of any length are read whole; of splits with equal
gain the first is taken; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .textblock import NON_LETTER, WHITE, Block, encoded, slices, sums

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_per_word", "bar_per_word", "bang_per_word",
    "distinct_share", "repeat_share", "log_lines", "words_per_line", "stop_share", "wide_share", "letterless_share", "log_longest_word",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _class("0123456789"), "symbol": _class("#*$%&<>@^~_=+/\\{}[]"), "bar": _class("|"),
    "bang": _class("!?"), "line": _class("\n"), "stop": _class(".,;:"), "wide": np.arange(256) >= 192, "letter": ~NON_LETTER,
}
_BIT = {k: i for i, k in enumerate(_CLASSES)}
_FLAGS = sum(v.astype(np.uint16) << _BIT[k] for k, v in _CLASSES.items()).astype(np.uint16)


def features_of(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    block = Block(texts)
    ws, we = block.spans(WHITE)
    first = block.per_text(ws)
    words = np.diff(first).astype(float)
    flags = _FLAGS[block.data]
    count = {}
    for k, i in _BIT.items():
        total = np.concatenate(([0], np.cumsum((flags >> i) & 1, dtype=np.int32)))
        count[k] = (total[block.end] - total[block.start]).astype(float)
        if k == "letter":
            letterless = (total[we] == total[ws]).astype(float)
    h = block.hashes(block.prefix(), ws, we)
    of = np.repeat(np.arange(block.n), np.diff(first))
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    longest = np.zeros(block.n)
    np.maximum.at(longest, of, we - ws)
    size, some, letters = (block.end - block.start).astype(float), np.maximum(words, 1), np.maximum(count["letter"], 1)
    lines = count["line"] + (size > 0)
    return np.column_stack((
        np.log1p(size), np.log1p(words), (size - count["line"]) / some, count["upper"] / letters, count["digit"] / np.maximum(size, 1), count["symbol"] / some, count["bar"] / some, count["bang"] / some,
        sums(fresh.astype(float), first) / some, sums(again, first) / some, np.log1p(lines), words / np.maximum(lines, 1), count["stop"] / some, count["wide"] / letters, sums(letterless, first) / some, np.log1p(longest),
    ))


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def _leaves(g: np.ndarray, h: np.ndarray, splits: int) -> np.ndarray:
    """Step function over bins with at most `splits` cuts that lowers the loss most, cut by cut."""
    cuts = [0, len(g)]
    value = lambda a, b: -g[a:b].sum() / (h[a:b].sum() + 1.0)
    for _ in range(splits):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a > 1:
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                if gain.max() > best:
                    best, at = gain.max(), a + 1 + int(gain.argmax())
        if at is None:
            break
        cuts = sorted({*cuts, at})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = value(a, b)
    return out


def _block_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Depth-two tree over a grid: one cut on either axis, then one on the other axis in each half."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, a.shape[0]):
            got, gain = np.zeros_like(a), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                row, hess = a[part].sum(0), b[part].sum(0)
                leaf = _leaves(row, hess, 1)
                got[part], gain = leaf, gain + float(-(leaf * row).sum())
            if gain > best:
                best, out = gain, got.T if flip else got
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 48, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 12) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [], [])
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.zeros(0)
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)

    def slope():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slope()
            size = len(model.tables[j])
            step = rate * _leaves(np.bincount(b, g, size), np.bincount(b, h, size), 2)
            model.tables[j] += step
            z += step[b]
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, pair_bins + 1)[1:-1])) for j in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(grid)]

    def cells(i, j, values):
        shape = (len(grid[i]) + 1, len(grid[j]) + 1)
        return np.bincount(low[i] * shape[1] + low[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            a, b = cells(i, j, g), cells(i, j, h)
            gains.append((float((a**2 / (b + 1)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j, grid[i], grid[j], np.zeros((len(grid[i]) + 1, len(grid[j]) + 1))))
    for _ in range(pair_rounds):
        for i, j, _, _, values in model.pairs:
            g, h = slope()
            step = rate * _block_leaves(cells(i, j, g), cells(i, j, h))
            values += step
            z += step[low[i], low[j]]
    return model


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model.base)
    for j, (cuts, values) in enumerate(zip(model.edges, model.tables)):
        z += values[np.searchsorted(cuts, x[:, j], "right")]
    for i, j, a, b, values in model.pairs:
        z += values[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
    return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, max_rows: int = 20000, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most max_rows labelled rows, chosen by a hash of the id; only their features reach the driver."""
    prepare(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "_id")

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(0))
            for a, b in slices(texts):
                x = pa.array(list(features_of(texts[a:b])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([x, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], ["x", "label", "_id"])

    rows = found.select("text", "label", F.col("_id").cast("bigint").alias("_id")).mapInArrow(run, "x array<double>, label double, _id bigint").toPandas().sort_values("_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return train(x, (rows["label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(predict(shared.value, features_of(texts[a:b])))], ["doc_id", "score"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, score double")


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents, all their columns, that score at least threshold. Scored in one pass, with no join."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(at))
            for a, b in slices(texts):
                good = predict(shared.value, features_of(texts[a:b])) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
