"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints
differ in at most two bits, one of the segments differs in at most one, so the
two share one of the 64 variants "segment s with bit i wiped out". Variants are
joined by equality and each candidate is verified on the whole fingerprint.

Distinct fingerprints are linked, not documents, so exact copies cost nothing.
A variant shared by more than `crowd` fingerprints is not paired up: each of
its fingerprints is dealt to the 65 spots that are itself or one bit away. Two
fingerprints within two bits share a spot, and all that share a spot are
within two bits of each other, so a star to the spot's smallest is exact, and
a crowd costs 65 rows a member.

Cases: texts without words (null, empty, white space) have fingerprint zero
and link like any other; texts shorter than a shingle are one shingle; texts of
any length are read whole. Repeated rows share a fingerprint; of equal smallest
ids any row stands for them. An empty table gives no rows. Extra columns are
ignored by `link` and passed through by `keep_one`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, fresh, hot_join, parallel, prepare, release, sieve, sieve_bit, sieve_slot, sift
from .textblock import LOWER, encoded

_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint over `size`-word shingles of a UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(end[: len(words) - size] + 1).tolist()]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, end[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = np.fromiter((fingerprint(t, size) for t in encoded(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key) for the 64 one-bit deletions; the key holds the segment's other 31 bits and which bit is gone, so it has no collisions."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    key = "shiftleft(cast(i as bigint), 32) | ((case when i < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end) & ~shiftleft(1L, i % 32))"
    return each.select("fp", F.expr(key).alias("key"))


def edges(fps: DataFrame, crowd: int = 32) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints within two bits of each other."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    fps = parallel(fps.select("fp"))
    shared = cut(variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = shared.where("n = 2").select("a", "b").where(near)
    members = cut(variants(fps).join(shared.where("n > 2").select("key", "n"), "key"))
    few = members.where(f"n <= {crowd}")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b").where(near)
    crowded = parallel(members.where(f"n > {crowd}").select("fp").distinct())
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"))
    heads = around.groupBy("spot").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last")
    stars = around.join(heads.select("spot", "a"), "spot").select("a", F.col("fp").alias("b")).where("a <> b")
    out = cut(twos.unionByName(pairs).unionByName(stars).distinct())
    release(shared, members)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every document: component_id is the smallest doc_id that links reach."""
    own = cut(fingerprints(docs, size, id_column, text_column))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    links = edges(fps)
    roots = components(links)
    # Fingerprints without links stand for themselves and are not joined to a root.
    linked = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = cut(fps.join(linked.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    release(links, roots, linked, fps)
    return hot_join(own, of, ["fp"], "n").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the `size`-word shingles of a text, in order; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(max(1, len(words) - size + 1))], np.uint64))


#: Smallest shingle hashes kept of a set, how many of them two sets of Jaccard similarity 0.8 share at least (a binomial of
#: 12 draws with odds 0.8 stays below 4 once in 10,000 times), and the documents of a key that are all compared.
_SKETCH, _COMMON, _CROWD = 12, 4, 64
#: Sets of a crowded shingle are compared in parts of so many.
_BLOCK = 1024


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, rk, fp, n, s1, s2, keys) of (doc_id, rk, text): fingerprint, size and hash of the shingle set, and its smallest hashes."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps, sizes, s1, s2, keys = [], [], [], [], []
            for t in encoded(batch.column(2)):
                found = shingle_hashes(t, size)
                fps.append(fingerprint(t, size))
                sizes.append(len(found))
                digest = xxhash.xxh3_128_digest(found.tobytes())
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(found[:_SKETCH].view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "fp", "n", "s1", "s2", "keys"])

    return docs.select("doc_id", "rk", "text").mapInArrow(run, "doc_id bigint, rk bigint, fp bigint, n int, s1 bigint, s2 bigint, keys array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(spot, hashes) of (spot, text): the whole shingle sets."""

    def run(batches):
        for batch in batches:
            found = [shingle_hashes(t, size).view(np.int64) for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["spot", "hashes"])

    return docs.select("spot", "text").mapInArrow(run, "spot bigint, hashes array<bigint>")


def _prefixes(docs: DataFrame, held: DataFrame, sets: DataFrame, size: int, similarity: float) -> DataFrame:
    """(hash, spot, n, place, df) of the prefixes of sets that can be alike though all the keys they share are crowded.

    Two sets of n and m shingles with a Jaccard similarity of t share t * n of
    the first's, so in any order of all shingles they have one in common among
    the first (1 - t) * n + 1 of each. The order here is by the number of these
    sets that have a shingle, df, rarest first, so the parts that a crowd has in
    common come last; `place` is a shingle's in its set. Only sets with as many
    crowded keys as two have to share take part, with their whole texts.
    """
    crowded = held.where(f"members > {_CROWD}").groupBy("id", "n").agg(F.count("*").alias("shared"))
    crowded = cut(crowded.join(sets.select("id", "keys"), "id").where(F.col("shared") >= F.least(F.lit(_COMMON), F.size("keys"))).select(F.col("id").alias("spot"), "n"))
    found = sieve(crowded, "spot")
    near = sift(docs.select(F.xxhash64("doc_id", "rk").alias("spot"), "text"), found, "spot")
    whole = cut(_sets(near, size).dropDuplicates(["spot"]).join(crowded, "spot"))
    each = whole.select("spot", "n", F.explode("hashes").alias("hash"))
    counts = cut(each.groupBy("hash").agg(F.count("*").alias("df")))
    ranked = hot_join(each, counts.withColumn("rows", F.col("df")), ["hash"], "rows").where("df > 1")
    # A set's own shingles come first and meet nobody; they only use up its prefix.
    single = F.col("n") - F.count("*").over(Window.partitionBy("spot"))
    place = F.row_number().over(Window.partitionBy("spot").orderBy("df", "hash")) + single
    out = cut(ranked.withColumn("place", place).where(F.col("place") <= F.floor((1 - similarity) * F.col("n") + 1e-9) + 1).select("hash", "spot", "n", "place", "df"))
    release(crowded, found, whole, counts)
    return out


def _crowded(first: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, n, b, m) of sets of different components that can be alike and share a crowded shingle of their prefixes.

    Of the sets of a shingle, those outside its largest component are compared
    with all, by classes of size (sets that are alike are at most one class
    apart) and in parts of _BLOCK. Behind the first shingle that two sets share,
    both need enough of theirs left for the similarity, so sets whose own
    shingles come first do not meet. This loses no pair; the comparisons, of
    numbers only, grow with the square of the sets outside.
    """
    rooted = cut(first.where(f"df > {_CROWD}").drop("df").join(roots.withColumnRenamed("node", "spot"), "spot", "left").withColumn("root", F.coalesce("root", "spot")))
    each = rooted.groupBy("hash", "root").agg(F.count("*").alias("rows"))
    mixed = cut(each.groupBy("hash").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "root"))["root"].alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots"))
    width = 1.001 * math.log(1 / similarity) if similarity < 1 else 1.0
    own = cut(hot_join(rooted, mixed, ["hash"], "rows").withColumn("class", F.floor(F.log("n") / width).cast("int")))
    met = cut(own.groupBy("hash", "class").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / _BLOCK).cast("int")))
    on = ["hash", "class", "part"]
    right = hot_join(own, met, ["hash", "class"], "rows").withColumn("part", F.pmod("spot", F.col("parts")).cast("int"))
    near = own.where("root <> main").withColumn("class", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])))
    left = hot_join(near, met, ["hash", "class"], "rows").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left, right = (parallel(df.select(*on, "spot", "n", "place", "root", "main"), *on) for df in (left, right))
    right = right.select(*on, F.col("spot").alias("b"), F.col("n").alias("m"), F.col("place").alias("place_"), F.col("root").alias("root_"))
    enough = f"1 + least(n - place, m - place_) >= {similarity / (1 + similarity)!r} * (n + m) - 1e-9 and least(n, m) >= {similarity!r} * greatest(n, m) - 1e-9"
    # Sets outside the largest component meet from both sides.
    pairs = left.withColumnRenamed("spot", "a").join(right, on).where(f"root <> root_ and (root_ = main or a < b) and {enough}")
    out = cut(pairs.select("a", "n", "b", "m").distinct())
    release(rooted, mixed, own, met)
    return out


def _checked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, fa, fb) of the pairs (a, n, b, m) that share enough keys and whose whole sets pass the similarity, with their fingerprints."""
    fits = f"a <> b and least(n, m) >= {similarity} * greatest(n, m) - 1e-9"
    pairs = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c, k, f: sets.select(F.col("id").alias(c), F.col("keys").alias(k), F.col("fp").alias(f))
    pairs = pairs.join(side("a", "ka", "fa"), "a").join(side("b", "kb", "fb"), "b").where(F.size(F.array_intersect("ka", "kb")) >= F.least(F.lit(_COMMON), F.size("ka"), F.size("kb")))
    pairs = cut(pairs.select("a", "b", "fa", "fb"))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("spot")).distinct())
    found = sieve(wanted, "spot")
    near = sift(docs.select(F.xxhash64("doc_id", "rk").alias("spot"), "text"), found, "spot")
    whole = cut(_sets(near, size).dropDuplicates(["spot"]))
    both = pairs.join(whole.select(F.col("spot").alias("a"), F.col("hashes").alias("x")), "a").join(whole.select(F.col("spot").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
    out = cut(both.where(f"shared >= {similarity} * (size(x) + size(y) - shared) - 1e-9").select("a", "b", "fa", "fb"))
    release(pairs, wanted, found, whole)
    return out


def alike(docs: DataFrame, own: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b) links of fingerprints whose texts have shingle sets with a Jaccard similarity of `similarity` or more.

    own has the sketches of docs. Equal sets are one node. Candidates share one
    of their smallest hashes, and _COMMON of them in all; within a key each set
    is compared with the smallest and the largest id, and in keys of up to
    _CROWD sets with all; sets that share more crowded keys only are found by
    their rarest shingles (`_prefixes`): all that share one of up to _CROWD
    sets, the smallest set of a larger one with all of its, and of what is not
    in one component then, all that can be alike (`_crowded`). The whole sets
    decide; they are built again for the candidates alone, which are found by a
    bitmap of bounded size.
    """
    some = own.where("n > 0")
    sets = cut(some.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "rk")).alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.max("fp").alias("other"), F.any_value("keys").alias("keys")).select(F.xxhash64("at.doc_id", "at.rk").alias("id"), "n", "fp", "other", "keys"))
    # Texts with equal sets can still differ in how often a shingle stands in them, and so in their fingerprints.
    same = some.select("s1", "s2", "fp").distinct()
    same = same.groupBy("s1", "s2").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    key = parallel(sets.select("id", "n", "keys")).select("id", "n", F.explode("keys").alias("key"))
    key = cut(key)
    ends = cut(key.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("id", "n")).alias("low"), F.max(F.struct("id", "n")).alias("high")).where("members > 1").withColumn("rows", F.col("members")))
    held = cut(hot_join(key, ends, ["key"], "rows"))
    tries = [held.select(F.col("id").alias("a"), "n", F.col(f"{e}.id").alias("b"), F.col(f"{e}.n").alias("m")) for e in ("low", "high")]
    few = held.where(f"members between 3 and {_CROWD}").select("key", "id", "n")
    tries.append(few.select("key", F.col("id").alias("a"), "n").join(few.select("key", F.col("id").alias("b"), F.col("n").alias("m")), "key").where("a < b").select("a", "n", "b", "m"))
    first = _prefixes(docs, held, sets, size, similarity)
    rare = first.where(f"df <= {_CROWD}").select("hash", F.col("spot").alias("a"), "n")
    tries.append(rare.join(rare.select("hash", F.col("a").alias("b"), F.col("n").alias("m")), "hash").where("a < b").select("a", "n", "b", "m"))
    large = first.where(f"df > {_CROWD}")
    barest = cut(large.groupBy("hash").agg(F.min(F.struct("n", "spot")).alias("least"), F.count("*").alias("rows")))
    tries.append(hot_join(large.select("hash", F.col("spot").alias("a"), "n"), barest, ["hash"], "rows").select("a", "n", F.col("least.spot").alias("b"), F.col("least.n").alias("m")))
    pairs = cut(tries[0].unionByName(tries[1]).unionByName(tries[2]).unionByName(tries[3]).unionByName(tries[4]).distinct())
    links = [_checked(pairs, docs, sets, size, similarity)]
    release(pairs)
    if not barest.isEmpty():
        roots = components(links[0].select("a", "b"))
        more = _crowded(first, roots, similarity)
        links.append(_checked(more, docs, sets, size, similarity))
        release(roots, more)
    ends_of = [x.select(F.col("fa").alias("a"), F.col("fb").alias("b")) for x in links]
    out = cut((ends_of[0] if len(links) == 1 else ends_of[0].unionByName(ends_of[1])).unionByName(same).where("a <> b").distinct())
    release(sets, key, ends, held, first, barest, *links)
    return out


def keep_one(docs: DataFrame, size: int = 5, similarity: float | None = None) -> DataFrame:
    """One document of each group, with its columns: the smallest in the order of (doc_id, hash of the text).

    Groups are those of `link`; with similarity, also of `alike`. Rows are told
    apart by doc_id and text: rows that agree in both are one document and one
    of them stays; rows that share only the doc_id are different documents. Rows
    with a null doc_id stay. Only rows that may go are shuffled with their texts.
    """
    names = fresh(docs, "_rk", "_spot", "_slot", "_bits", "_gone", "_twice")
    rk, spot, slot, bits, gone, twice = names
    keyed = docs.select("*", F.xxhash64("text").alias(rk), F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias(spot))
    light = keyed.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(rk).alias("rk"), "text")
    own = cut(_sketches(light, size).drop("keys") if similarity is None else _sketches(light, size))
    rows = cut(own.groupBy("doc_id", "rk").agg(F.count("*").alias("copies"), F.min("fp").alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "rk")).alias("first")))
    near = edges(fps.select("fp"))
    links = near if similarity is None else cut(near.unionByName(alike(light, own, size, similarity)))
    roots = components(links)
    joined = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"))
    best = joined.groupBy("root").agg(F.min("first").alias("best"))
    of = cut(fps.join(joined.join(best, "root").select("fp", "best"), "fp", "left").select("fp", "rows", F.coalesce("best", "first").alias("best")))
    marked = hot_join(rows, of, ["fp"], "rows").withColumn("stays", F.struct("doc_id", "rk") == F.col("best"))
    special = cut(marked.where("not stays or copies > 1").select(F.xxhash64("doc_id", "rk").alias(spot), (~F.col("stays")).alias(gone)))
    found = sieve(special, spot)
    release(own, rows, fps, near, links, roots, joined, of)
    flagged = keyed.join(F.broadcast(found.toDF(slot, bits)), sieve_slot(spot) == F.col(slot), "left")
    maybe = F.col("doc_id").isNotNull() & F.coalesce(F.getbit(bits, sieve_bit(spot)) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doubtful = flagged.where(maybe).join(special, spot, "left")
    whole = flagged.where(~maybe).select(*columns).unionByName(doubtful.where(F.col(gone).isNull()).select(*columns))
    return whole.unionByName(doubtful.where(~F.col(gone)).dropDuplicates([spot]).select(*columns))
