"""Spelling variants against all pairs, on planted words and odd rows."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from scriptorium.llm import queries, spelling


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _plain(counts, factor=10):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(near), form if form and counts[form] >= factor * n else None)
    rows = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (n, k, form, counts[form] if form else None, root)
    return rows


def _got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_all_pairs(spark):
    rng = random.Random(3)
    letters = "abcdeéÀßz"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(60)}
    for w in list(words):
        for _ in range(8):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    counts = {w: rng.choice([2, 3, 20, 31, 250, 2500]) for w in words if len(w) >= 7}
    got = _got(spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == _plain(counts)
    assert any(form and root != form for _, _, form, _, root in got.values())


def test_hot_bucket(spark):
    """Words of one key: the same letters behind one prefix."""
    words = {f"stuvwxyz{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    counts = {w: 2 + 40 * w.endswith("aa") for w in words}
    assert _got(spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long"))) == _plain(counts)


def test_query_on_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    stem = ["recommendation", "Überlegenheit", "ÀÉcoutations", "lighthouse", "thunder"]
    rows = []
    for d in range(300):
        rows.append((d, " ".join(rng.choice(stem) if rng.random() < 0.9 else rng.choice(stem).replace("t", rng.choice(["", "tt", "d"]), 1) for _ in range(12)) + "×3 x"))
    rows += [(7, rows[7][1]), (7, None), (None, "lighthouse lighthouse"), (8, ""), (9, "thunder " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for d, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += len(run) >= 7
            run = ""
    want = _plain({w: n for w, n in counts.items() if n >= 2})
    got = _got(queries.op11_spelling(spark, str(tmp_path)))
    assert got == want and any(v[2] for v in want.values())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.count_words(none)).collect() == []
