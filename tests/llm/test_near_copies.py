"""SimHash linking, components and line dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from scriptorium.llm import line_dedup, queries, simhash
from scriptorium.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    want = {i: plain_fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    links = [(a, b) for a, b in itertools.combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 2]
    group = groups_of(links, want)
    got = queries.op3_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{want[i]:016x}", group[i]) for i in want}


def test_spark_hash_agrees(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("crowd", [2, 8, 32])
def test_crowded_variants(spark, crowd):
    rng = random.Random(crowd)
    fps = {0, -1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(50):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    links = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2) if i < j]
    found = simhash.edges(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    assert groups_of([(r.a, r.b) for r in found], fps) == groups_of(links, fps)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "w " * 50000), (8, "same text here now"), (8, "same text here now"), (9, "same  text\there now")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.link(docs).collect())
    assert [g[1] for g in got] == [plain_fingerprint(t) for _, t in rows]
    comp = {g[0]: g[2] for g in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[5] == 4 and comp[9] == 8
    kept = simhash.keep_one(docs, size=3)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]
    assert simhash.link(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def plain_line_groups(rows, min_words=5):
    """Brute force over all pairs of distinct lines: SimHash within three bits and edit similarity of 0.8."""
    seen: dict[tuple, list] = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            words = tuple(w for w in re.split("[\\x20\\x09-\\x0D]+", line.lower()) if w)
            if len(words) >= min_words:
                seen.setdefault(words, set()).add((doc, n))

    def fp(words):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(words)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    prints = {w: fp(w) for w in seen}
    links = []
    for a, b in itertools.combinations(seen, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = " ".join(a), " ".join(b)
            if distance(x, y) <= (1 - 0.8) * max(len(x), len(y)) + 1e-9:
                links.append((a, b))
    group = groups_of(links, seen)
    first: dict = {}
    for w, places in seen.items():
        first[group[w]] = min(first.get(group[w], min(places)), min(places))
    return {(d, n): first[group[w]] == (d, n) for w, places in seen.items() for d, n in places}, len(links)


def line_fixture():
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 60))) for _ in range(12)]
    rows = []
    for d in range(90):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice((0, 0, 1, 1, 2, 8))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines.append(rng.choice((" ", "  ")).join(w) if rng.random() < 0.9 else " ".join(w).upper())
        lines.append(rng.choice(("", "too short", "also short line")))
        rows.append((d, "\n".join(lines)))
    return rows


def test_lines_against_brute_force(spark):
    rows = line_fixture()
    stays, links = plain_line_groups(rows)
    assert links > 50
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, mask string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, drop_emptied=False).collect()}
    for d, t in rows:
        assert got[d] == "\n".join(x for n, x in enumerate(t.split("\n")) if stays.get((d, n), True)), d
    kept = {r.doc_id for r in line_dedup.dedup(docs).collect()}
    for d, t in rows:
        full = [stays[d, n] for n in range(len(t.split("\n"))) if (d, n) in stays]
        assert (d in kept) == (all(full) or any(full)), d


def test_line_fingerprints(spark):
    """Counters of all widths against the plain majority: short lines, exact ties, and lines counted in parts."""
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (5, 6, 33, 511, 512, 513, 1500)] + ["a b a b a b", "x " * 900]
    got = {r.l: r.fp & (1 << 64) - 1 for r in line_dedup.line_table(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()}
    for n, line in enumerate(lines):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(line.split())]
        assert got[n] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), n


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_blocks_lose_no_pair(spark, blocks):
    rng = random.Random(blocks)
    rows = []
    for i in range(0, 120, 2):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), i % 4):
            y ^= 1 << b
        rows += [(i, x), (i + 1, y)]
    fps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    keys = {}
    for r in line_dedup.blocks_of(fps, blocks).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert all(keys[i] & keys[i + 1] for i in range(0, 120, 2))


def test_lines_by_shuffle(spark):
    """The same without broadcasts."""
    docs = spark.createDataFrame(line_fixture(), "doc_id long, text string")
    a = line_dedup.dedup(docs, broadcast_rows=500_000).collect()
    b = line_dedup.dedup(docs, broadcast_rows=-1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_line_cases(spark):
    long = "q w e r t " * 2000
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (4, "A  b c\td e f g\nkeep this one line here"), (5, long), (6, long + "\nand one more line there"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "x"), (9, "x y\nx y\nx y")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, line_no int, id int")
    got = sorted((str(r.doc_id), r.text or "") for r in line_dedup.dedup(docs).collect())
    assert got == sorted([("1", ""), ("2", ""), ("3", "a b c d e f g"), ("4", "keep this one line here"), ("5", long), ("6", "and one more line there"), ("None", "x"), ("9", "x y\nx y\nx y")])
    assert line_dedup.dedup(docs.limit(0)).columns == docs.columns


def test_line_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    stays, _ = plain_line_groups([(d, t) for d, t in rows if len(t) < 1500])
    docs = spark.createDataFrame([(d, t) for d, t in rows if len(t) < 1500], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, drop_emptied=False).collect()}
    assert got == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if stays.get((d, n), True)) for d, t in rows if len(t) < 1500}
    whole = queries.op10_line_dedup(spark, sf).collect()
    assert len(whole) == len(rows) and all(len(r.text_sha256) == len(hashlib.sha256().hexdigest()) for r in whole)
