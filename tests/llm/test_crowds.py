"""Near copies inside crowds: lines and documents that share a long lead with many others."""

import random

import pytest

from scriptorium.llm import line_dedup, simhash


def _word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))


def _changed(rng, text, letters):
    out = list(text)
    for i in rng.sample([i for i, c in enumerate(out) if c != " "], letters):
        out[i] = "0"
    return "".join(out)


@pytest.mark.parametrize("pairs", [150])
def test_lines_with_one_lead(spark, pairs):
    rng = random.Random(pairs)
    lead = " ".join(_word(rng) for _ in range(13))
    rows = []
    for _ in range(pairs):
        tail = " ".join(_word(rng) for _ in range(7))
        rows += [(len(rows), f"{lead} {tail}"), (len(rows) + 1, f"{lead} {_changed(rng, tail, 4)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup(docs, sketch=True).collect()}
    assert got == set(range(0, 2 * pairs, 2))


def test_lines_without_a_common_run(spark):
    """Every fifth character behind the lead differs, so no run of eight is shared there; and a crowd of more than a block."""
    rng = random.Random(5)
    lead = " ".join(_word(rng) for _ in range(13))
    rows = []
    for _ in range(150):
        tail = " ".join(_word(rng) for _ in range(7))
        rows += [(len(rows), f"{lead} {tail}"), (len(rows) + 1, f"{lead} " + "".join("0" if i % 5 == 2 and c != " " else c for i, c in enumerate(tail)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup(docs, sketch=True).collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("pairs", [150])
def test_documents_with_one_lead(spark, pairs):
    rng = random.Random(pairs)
    lead = [_word(rng) for _ in range(90)]
    rows = []
    for _ in range(pairs):
        tail = [_word(rng) for _ in range(30)]
        copy = [*tail[:8], "other", *tail[9:20], "words", *tail[21:]]
        rows += [(len(rows), " ".join(lead + tail)), (len(rows) + 1, " ".join(lead + copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one(docs, size=5, similarity=0.8).collect()} == set(range(0, 2 * pairs, 2))


def test_documents_that_share_a_crowd_alone(spark):
    """Every document is alike to the two without much of their own, and to no other; all they share is what the crowd has."""
    rng = random.Random(9)
    lead = [_word(rng) for _ in range(89)]
    rows = [(k, " ".join(lead + [_word(rng) for _ in range(2 if k in (70, 90) else 15)])) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(docs, size=5, similarity=0.8).collect()] == [0]


def test_crowded_documents_against_all_pairs(spark):
    """Sets over a few shingles that nearly all have: pairs of other components, as all pairs have them."""
    rng = random.Random(4)
    sets = [set(rng.sample(range(40), rng.randint(18, 38))) | ({1000 + k} if k % 3 else set()) for k in range(240)]
    df = {}
    for x in sets:
        for h in x:
            df[h] = df.get(h, 0) + 1
    rows = []
    for k, x in enumerate(sets):
        prefix = sorted(x, key=lambda h: (df[h], h))[: int(0.2 * len(x) + 1e-9) + 1]
        rows += [(h, k, len(x), at + 1, df[h]) for at, h in enumerate(prefix) if df[h] > 1]
    root = [5 if k % 4 == 0 else k for k in range(240)]
    first = spark.createDataFrame(rows, "hash long, spot long, n int, place int, df long")
    roots = spark.createDataFrame([(k, r) for k, r in enumerate(root) if r != k or k == 5], "node long, root long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash._crowded(first, roots, 0.8).collect()}
    want = {(i, j) for i in range(240) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]}
    want = {(j, i) for i, j in want}
    assert len(want) > 20 and want <= got


def test_items_do_not_depend_on_blocks(spark):
    """Equal items are one class with its number of copies, in one block or many."""
    from scriptorium.llm import decontamination

    rng = random.Random(6)
    items = [" ".join(_word(rng) for _ in range(12)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(items)] + [(100 + i, t.upper() if i % 2 else t) for i, t in enumerate(items[:9])] + [(200, ""), (201, None), (None, items[3])]
    docs = spark.createDataFrame([(i, f"{_word(rng)} {t} {_word(rng)}") for i, t in enumerate(items[:20])] + [(50, None), (51, "")], "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    for expand in (False, True):
        got = [sorted(map(tuple, decontamination.search(docs, bench, block_bytes=n, expand=expand).collect()), key=str) for n in (250, 2000, 8 << 20)]
        assert got[0] == got[1] == got[2]
        assert {r[5] for r in got[0] if r[0] < 9} == {2, 3} and len(got[0]) == (20 if not expand else 30)
    left = [sorted(r.doc_id for r in decontamination.remove_contaminated(docs, bench, block_bytes=n).collect()) for n in (250, 8 << 20)]
    assert left == [[50, 51], [50, 51]]


def _crowd(spark, lines):
    """The tables that `_crowded` takes, of lines (h1, root, least, keys, text)."""
    all_of = spark.createDataFrame([(k, h, 100) for h, _, _, keys, _ in lines for k in keys], "key long, h1 long, n long")
    roots = spark.createDataFrame([(h, r) for h, r, _, _, _ in lines], "node long, root long")
    sets = spark.createDataFrame([(h, keys, least, len(t)) for h, _, least, keys, t in lines], "h1 long, keys array<long>, least int, chars int")
    return all_of, roots, sets, spark.createDataFrame([(h, t, len(t)) for h, _, _, _, t in lines], "h1 long, line string, chars int")


def test_crowd_rows_grow_with_lines(spark):
    """A near copy group of 12 keys a line and a few others: a few rows for each line and key, whatever the group's size."""
    made = []
    for n in (300, 1200):
        lines = [(h, h if h % 10 == 0 else 1, 2, list(range(12)), "x" * 100) for h in range(n)]
        left, right, _ = line_dedup._crowd_rows(*_crowd(spark, lines)[:3], 0.8)
        made.append((left.count(), right.count()))
        assert made[-1][1] == 11 * n and made[-1][0] <= 11 * (n // 10) * 10
    assert made[1][1] == 4 * made[0][1]


def test_crowd_against_all_pairs(spark):
    """All pairs of other components that share enough keys: short lines one, also with a line that needs two; lengths at the edge, moved texts."""
    from .test_whole_lines import near

    rng = random.Random(8)
    base = [" ".join(_word(rng) for _ in range(12)) for _ in range(3)]
    lines = []
    for h in range(90):
        text = base[h % 3]
        for _ in range(rng.choice((3, 12, 17, 19, 21, 24))):
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(("", "é", "ab")) + text[i + 1 :]
        cut = rng.choice((0, 0, 10, 19, 20))
        text = rng.choice((text, text[cut:], text[: len(text) - cut], text[cut:] + "q" * cut))
        lines.append((h - 40, 5 if h % 7 == 0 else h - 40, rng.choice((1, 2, 2, 2)), rng.sample(range(6), rng.choice((1, 2, 3, 6))), text))
    want = set()
    for i, (a, ra, la, ka, x) in enumerate(lines):
        for b, rb, lb, kb, y in lines[i + 1 :]:
            if ra != rb and len(set(ka) & set(kb)) >= min(la, lb) and near(x, y):
                want.add((a, b))
    assert len(want) > 30
    assert {(r.a, r.b) for r in line_dedup._crowded(*_crowd(spark, lines), 0.8).collect()} == want


def test_crowd_in_rounds(spark, monkeypatch):
    """What is compared does not depend on how many rounds it takes."""
    rng = random.Random(11)
    base = " ".join(_word(rng) for _ in range(12))
    lines = [(h, h, 2, list(range(4)), _changed(rng, base, rng.choice((3, 6, 9)))) for h in range(150)]
    want = {(r.a, r.b) for r in line_dedup._crowded(*_crowd(spark, lines), 0.8).collect()}
    monkeypatch.setattr(line_dedup, "_ROUND", 1)
    cuts = []
    monkeypatch.setattr(line_dedup, "sweep", cuts.append)
    assert {(r.a, r.b) for r in line_dedup._crowded(*_crowd(spark, lines), 0.8).collect()} == want
    assert len(cuts) > 2 and len(want) > 1000


def test_pairs_of_one_key_are_not_written(spark):
    """Of lines that share keys in buckets of up to 64, only pairs of other components, of like length and with enough common keys are made."""
    rng = random.Random(12)
    lines = [(h, rng.choice((1, 2, h)), [rng.randrange(40), *rng.sample(range(100, 140), rng.choice((0, 1, 2, 3)))], rng.choice((1, 2, 2, 2)), rng.choice((50, 60, 70))) for h in range(600)]
    sets = spark.createDataFrame([(h, r, sorted(set(keys)), least, chars) for h, r, keys, least, chars in lines], "h1 long, root long, keys array<long>, least int, chars int")
    of = {}
    for h, r, keys, _, _ in lines:
        for k in keys:
            of.setdefault(k, set()).add(h)
    few = {k for k, x in of.items() if 2 < len(x) <= 64}
    want = set()
    for i, (a, ra, ka, la, na) in enumerate(lines):
        for b, rb, kb, lb, nb in lines[i + 1 :]:
            if ra != rb and set(ka) & set(kb) & few and len(set(ka) & set(kb)) >= min(la, lb) and abs(na - nb) <= int(max(na, nb) * 0.2 + 1e-9):
                want.add((a, b))
    assert len(few) > 10 and len(want) > 100
    assert {(r.a, r.b) for r in line_dedup._few_pairs(sets, 0.8).collect()} == want
