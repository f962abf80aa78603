"""The point-in-time join against the plain definition."""

import hashlib
import random

import pyarrow as pa
import pytest

from scriptorium.llm import feature_join, queries


def _plain(asks, versions):
    out = []
    for k, t in asks:
        fit = [v for v in versions if k is not None and t is not None and v[0] == k and v[1] is not None and v[2] is not None and v[1] <= t < v[2]]
        best = max(fit, key=lambda v: tuple((x is not None, x) for x in v[3:]), default=None)
        out.append((k, t, best[3] if best else None, best[4] if best else None))
    return sorted(out, key=repr)


def _run(spark, asks, versions, **options):
    a = spark.createDataFrame(asks, "key string, won long")
    v = spark.createDataFrame(versions, "key string, start long, end long, p long, name string")
    out = feature_join.point_in_time(a, v, "key", "won", "start", "end", ["p", "name"], ["p", "name"], **options)
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 16, 1024])
def test_against_definition(spark, width):
    rng = random.Random(width)
    versions = []
    for i in range(400):
        start = rng.randrange(-200, 1000)
        versions.append((rng.choice(["a", "a", "b", None]), start, start + rng.choice([0, 1, 5, 40, 700, 20000]), rng.choice([None, 1, 2, 3, i]), f"v{i % 50}"))
    versions += [versions[0], ("a", None, 5, 1, "x"), ("b", 3, None, 1, "y"), ("c", 10, 5, 1, "z"), ("a", -(1 << 61), 1 << 61, 0, "ever")]
    asks = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-250, 1300, 7)])) for _ in range(300)] + [("a", 5)] * 30
    assert _run(spark, asks, versions, width=width) == _plain(asks, versions)


def test_slices(monkeypatch):
    """Small slices, chunks that span batches: partial winners merge to the same result."""
    rng = random.Random(2)
    rows, want = [], {}
    for key in "xyz":
        for chunk in (-1, 0, 3):
            asks = sorted(rng.sample(range(16), 9))
            versions = [(lo := rng.randrange(16), rng.randrange(lo + 1, 17)) for _ in range(40)]
            rows += [(key, 0, chunk, 16, 0, t, None, chunk * 16 + t, None) for t in asks]
            rows += [(key, 0, chunk, 16, 1, lo, hi, None, {"p0": i}) for i, (lo, hi) in enumerate(versions)]
            for t in asks:
                fit = [i for i, (lo, hi) in enumerate(versions) if lo <= t < hi]
                if fit:
                    want[key, chunk * 16 + t] = max(fit)
    schema = pa.schema([("key", pa.string()), ("level", pa.int32()), ("chunk", pa.int64()), ("width", pa.int64()), ("kind", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("time", pa.int64()), ("won", pa.struct([("p0", pa.int64())]))])
    for slice_, step in ((5, 3), (7, 50), (100000, 11)):
        monkeypatch.setattr(feature_join, "SLICE", slice_)
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + step]], schema=schema) for i in range(0, len(rows), step)]
        got = {}
        for b in feature_join._winners(iter(batches)):
            for r in b.to_pylist():
                got[r["key"], r["time"]] = max(got.get((r["key"], r["time"]), -1), r["won"]["p0"])
        assert got == want


def test_query(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, None if i % 50 == 0 else f"s{0 if i % 3 else i % 7}", i % 90, "en") for i in range(3000)] + [(3, "s0", 5, "de"), (None, "s0", 1, "fr")]
    labels = [(rng.randrange(3300),) for _ in range(500)] + [(None,), (6,), (6,)]
    spark.createDataFrame(docs, "doc_id long, source string, n_chars long, lang string").selectExpr("*", "'x' AS key", "1 AS won").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long").selectExpr("*", "'x' AS time").write.parquet(str(tmp_path / "labels.parquet"))
    part = lambda i, k: int(hashlib.sha256(str(i).encode()).hexdigest()[8 * k : 8 * k + 8], 16)
    source, want = {}, []
    for i, s, *_ in docs:
        source[i] = min((x for x in (source.get(i), s) if x), default=None)
    for (i,) in labels:
        t, best = (None if i is None else part(i, 3) % 200000), None
        for j, s, n, lang in docs if i is not None and source.get(i) else ():
            if j is None:
                continue
            e = part(j, 0) % 200000
            if s == source[i] and e <= t and e - 60 + part(j, 1) % 1200 <= t < e + part(j, 2) % 900:
                best = max(best or (), (e, e - 60 + part(j, 1) % 1200, j, n, lang))
        age = t - best[0] if best else None
        status = "none" if not best else "stale" if age > 20 else "fresh"
        want.append((i, t, best[2] if best else None, age, status, *(best[3:] if status == "fresh" else (None, None))))
    got = [tuple(r) for r in queries.op12_feature_join(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[4] for r in want} >= {"none", "stale"}


def test_empty(spark):
    assert _run(spark, [], [("a", 1, 2, 3, "n")]) == []
    assert _run(spark, [("a", 1)], []) == [("a", 1, None, None)]
