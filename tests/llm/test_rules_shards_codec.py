"""Quality rules, sharding, piece codec, decontamination, personal data and the pipeline."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scriptorium.llm import decontamination, oracle, personal_data, piece_codec, quality_rules, queries, sharding

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g h a b c d e f g h"), (5, "x\nx\n \ny"), (6, "w " * 30000), (7, "é😀|#"), (8, "dup"), (8, "dup"), (None, "no id")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in ODD], "doc_id long, text string, n_words int, shard string")


def plain_metrics(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    w = word.findall(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if word.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((str(r.doc_id), *plain_metrics(r.text)) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs).collect())
    assert got == want
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_rules_are_one_projection(spark, sf):
    plan = queries.op7_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = c.sql(oracle.QUALITY_RULES)
    got = queries.op7_quality_rules(spark, sf)
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_rule_table(odd):
    rules = (quality_rules.Rule("one", "n_words", low=1), quality_rules.Rule("few", "n_symbols", high=0))
    got = {(r.doc_id, tuple(r.failed)) for r in quality_rules.judge(odd, rules).collect()}
    assert (1, ("one",)) in got and (7, ("few",)) in got and (4, ()) in got
    assert quality_rules.judge(odd, ()).where("kept").count() == len(ODD)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 36, 37, 101, 1000])
def test_permutation(spark, n):
    x = spark.range(n).select("id", sharding.permute(F.col("id"), n, 5).alias("p"))
    rows = x.withColumn("back", sharding.permute(F.col("p"), n, 5, back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    out = sharding.shard(docs, 7).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts)
    assert sorted(r.slot * 7 + r.shard for r in out) == list(range(len(texts)))
    order = sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32))
    assert [r.row_number for r in sorted(out, key=lambda r: r.row_number)] == list(range(len(out))) and [r.doc_id for r in sorted(out, key=lambda r: r.row_number)] == [r.doc_id for r in order]
    again = {(r.row_number, r.shard, r.slot) for r in sharding.shard(docs.repartition(5), 7).collect()}
    assert again == {(r.row_number, r.shard, r.slot) for r in out}, "the file layout does not matter"
    where = sharding.unpermute(spark.createDataFrame([(r.slot * 7 + r.shard, r.row_number) for r in out], "p long, want long"), "p", len(out))
    assert where.where("row_number <> want").isEmpty()
    assert sharding.shard(docs.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard(docs.limit(3), 40).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        sharding.shard(docs, 0)


def test_shard_query(spark, sf):
    rows = queries.op2_sharding(spark, sf).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in rows} == {"rows"}


TEXTS = ["", " ", "  a  b ", "hello world hello", "▁x ▁▁ y", "日本語😀\t\r\n\x00", "é" * 50, "a" * 5000, "\n\n x"]


def plain_bpe(codec, text, skip):
    """One text by the textbook: merge the best pair that is not skipped, leftmost on ties, until none is left."""
    size = codec.size
    pairs = dict(zip(codec.keys.tolist(), codec.merged.tolist()))
    out = []
    for chunk in re.findall(r" +[^ ]*", " " + text) if text else []:
        seq = [(i, i + 1, int(codec.char[ord(c)]), c) for i, c in enumerate(chunk)]
        while True:
            best = None
            for k in range(len(seq) - 1):
                a, b = seq[k], seq[k + 1]
                made = pairs.get(a[2] * size + b[2]) if a[2] >= 0 and b[2] >= 0 else None
                if made is not None and not skip(chunk, a[0], a[1], b[1]):
                    key = (int(codec.rank[made]), a[0])
                    if best is None or key < best[0]:
                        best = (key, k, made)
            if best is None:
                break
            _, k, made = best
            seq[k : k + 2] = [(seq[k][0], seq[k + 1][1], made, seq[k][3] + seq[k + 1][3])]
        for _, _, piece, c in seq:
            out += [piece] if piece >= 0 else [int(codec.byte_id[x]) for x in c.encode()]
    return out


def test_codec_against_library_and_textbook(spark, sf):
    path = piece_codec.default_model()
    codec = piece_codec.codec(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + [t for t in TEXTS if "▁" not in t]
    ids, at = codec.encode([t.encode() for t in texts], np.arange(len(texts)))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [sp.encode(t) for t in texts]
    assert [plain_bpe(codec, t[:300], lambda *_: False) for t in texts[:6] + TEXTS[:4]] == [sp.encode(t[:300]) for t in texts[:6] + TEXTS[:4]]


def test_dropout(spark, sf):
    codec = piece_codec.codec(piece_codec.default_model())
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [t.encode() for t in TEXTS]
    keys = np.arange(len(texts))
    runs = {}
    for p, seed in ((0.0, 1), (0.1, 1), (0.1, 2), (0.5, 1), (1.0, 1)):
        ids, at = codec.encode(texts, keys, p, seed)
        assert codec.decode(ids, at) == texts
        runs[p, seed] = ids.tolist()
    assert codec.encode(texts, keys, 0.1, 1)[0].tolist() == runs[0.1, 1] != runs[0.1, 2]
    assert len(runs[0.0, 1]) < len(runs[0.1, 1]) < len(runs[0.5, 1]) < len(runs[1.0, 1])
    assert len(runs[1.0, 1]) == sum(len(piece_codec_chars(t.decode(), codec)) for t in texts)
    one, where = codec.encode([b"interesting " * 400], np.array([3]), 0.3, 9)
    assert len({tuple(x) for x in np.split(one, np.flatnonzero(np.isin(one, codec.char[32])))}) > 1, "occurrences vary"
    del where


def piece_codec_chars(text, codec):
    return [x for c in (" " + text if text else "") for x in ([1] if codec.char[ord(c)] >= 0 else c.encode())]


def test_skips_follow_the_hash(monkeypatch):
    """With dropout the vectorised agenda equals the textbook one under the same skip decisions."""
    codec = piece_codec.codec(piece_codec.default_model())
    mix, u = piece_codec.mix, np.uint64
    chunk = " internationalisation"
    salt = np.array([123456789], np.uint64)
    data = np.frombuffer(chunk.encode(), np.uint8)
    for p in (0.2, 0.6):
        def skip(_, a, m, e, p=p):
            h = salt + (u(a) << u(42)) + (u(m) << u(21)) + u(e)
            return bool(mix(mix(h))[0] < u(int(p * 2.0**64)))

        got, _ = codec.segment(data, np.array([0, len(data)]), salt, p)
        assert got.tolist() == plain_bpe(codec, chunk[1:], skip)


def test_codec_frames(spark, odd):
    path = piece_codec.default_model()
    out = piece_codec.encode(odd, path, 0.1, 7)
    assert out.where("not lossless").isEmpty() and out.count() == len(ODD)
    back = {(r.doc_id, r.text) for r in piece_codec.decode(out, path).collect()}
    assert back == {(i, t or "") for i, t in ODD}
    digests = {(r.doc_id, r.n_pieces, r.ids_sha256) for r in piece_codec.digest(odd, path, 0.1, 7).collect()}
    assert digests == {(r.doc_id, len(r.ids), hashlib.sha256(np.array(r.ids, np.int32).tobytes()).hexdigest()) for r in out.collect()}
    assert piece_codec.encode(odd.limit(0), path).count() == 0


def test_decontamination_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet").toPandas() for n in ("documents", "benchmark"))
    shingles = lambda t: decontamination.shingles_of(decontamination.words_of(t.encode()), 5)
    items = {i: shingles(t) for i, t in zip(bench.item_id, bench.text)}
    want = {(d, i) for d, s in ((d, shingles(t)) for d, t in zip(docs.doc_id, docs.text)) for i, x in items.items() if len(x & s) >= 0.8 * len(x)}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf).collect()}
    assert got == want and len(want) > 10
    few = decontamination.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), block_bytes=2000)
    assert {(r.doc_id, r.item_id) for r in few.collect()} == want, "blocks of items find the same"


def test_decontamination_thresholds(spark):
    item = " ".join(f"w{i}" for i in range(44))  # 40 shingles

    def damaged(k):
        """The first change breaks three shingles, each further one five."""
        w = item.split()
        for i in range(k):
            w[i * 6 + 2] = "zz"
        return "pre fix " + " ".join(w).upper() + ", post."
    rows = [(k, damaged(k)) for k in (0, 0, 1, 2, 3)] + [(10, item.replace(" ", "\n!")), (11, None), (12, ""), (13, "a Short-Item here"), (14, "short one")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, containment int")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "short item")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect())
    assert got == sorted([(0, 1), (0, 2)] * 2 + [(1, 1), (1, 2), (2, 1), (2, 2), (10, 1), (10, 2), (13, 5)])
    clean = decontamination.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 11, 12, 14]
    assert decontamination.search(docs, bench.limit(0)).count() == 0 and decontamination.search(docs.limit(0), bench).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], personal_data.ORDER[s[0]]))


HARD = ["a@b.c@d.e", "x@y", "@a.b", "..@a-.b-c.d.", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300", "0001.002.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111 1111  1111 1111", "+1 (22) 333-4444 55", "+1+22333444455", "é😀 a@b.co", "+123456789 +1(234)", "a@b.c.d@e.f", "4111111111111111@x.y"]


def test_base_spans(spark, sf):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("01 .-+()@ab"), 40)) for _ in range(3000)]
    for t in texts:
        assert personal_data.base_spans(t) == plain_base(t), t


def test_segments():
    model = personal_data.default_model()
    found = gold = extra = 0
    for text, spans in personal_data.examples(150, seed=77):
        got = set()
        for a, b in personal_data.regions(text):
            region = personal_data.Region(text, a, b)
            got |= {(personal_data.TYPES[t], region.spots[i][0], region.spots[j][1]) for i, j, t in model.best(region)}
        gold, found, extra = gold + len(spans), found + len(got & set(spans)), extra + len(got - set(spans))
    assert found / gold > 0.95 and extra / gold < 0.05
    base, spans = personal_data.find('the token = "' + "0a1b2c3d4e" * 4 + '" and (123) 456-7890, version 1.2.3 of 12345', model)
    assert base == [] and [s[0] for s in spans] == ["secret", "phone"]
    assert personal_data.find("", model) == ([], []) and personal_data.find("plain words only", model) == ([], [])


def test_personal_data_query(spark, sf, odd):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_personal_data(spark, sf).collect():
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in personal_data.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}
    got = personal_data.scan(odd).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""} and personal_data.scan(odd.limit(0)).count() == 0
