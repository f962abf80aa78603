"""Spelling variants: words one edit apart, by bands of letter-parity masks.

A word's mask has one bit for each letter, set if the letter stands in it an
odd number of times. One inserted, deleted or replaced code point flips at
most two bits, so of three bands that share out the bits at least one stays
as it is. Words that are equal in one band and whose lengths differ by one at
most are compared.

A band has a few hundred values, whatever the number of words, so its buckets
are split by a second fact that one edit leaves true as well: two words one
edit apart agree in their first or in their last L // 2 code points, L being
the longer one's length. A key is (L, band, bits of the band, side, those code
points); a word looks under its own length and the next. That drops no pair.
On half a GB of documents (a million words) it leaves 2e8 comparisons of
4e10. Masks that differ in more than two bits are refused, an edit distance
bounded by one decides.

Cases: a null text has no words; a null id counts as empty in the digest that
`perturb` uses; repeated rows count again; a text of any length is split
whole; ties for a word's form go to the smallest in code-point order; an empty
table gives no rows; other columns are ignored. Only words, counts and keys
are shuffled, counts are summed before that. The chain of forms is followed
by doubling: each form is ten times as frequent as its word, so it has at most
19 links, and five rounds follow them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare, release

#: Letters by falling frequency in European prose; dealt round the bands in this order, so that all three tell much apart. Any order is right.
LETTERS = "etaoinhrsdlucmwfygpbvkqxjz"
BANDS = 3
_BITS = 60


def runs(text: Column, least: int) -> Column:
    """Maximal runs of letters with `least` code points or more, upper case as it stands."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))


def lower_ascii(run: Column) -> Column:
    """A-Z lower-cased, accented capitals left."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(run.rlike("[\\u00C0-\\u00DE]"), F.translate(run, upper, upper.lower())).otherwise(F.lower(run))


def perturb(id: Column, run: Column, one_in: int) -> Column:
    """run without one code point if its digest with the id is divisible by one_in."""
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 7, occurrences: int = 2, one_in: int | None = 31) -> DataFrame:
    """(word, n): the words of `least` code points and `occurrences` occurrences, or more."""
    found = docs.select(F.col(id_column).alias("id"), F.explode(runs(F.col(text_column), least)).alias("run"))
    found = found.select("id", lower_ascii(F.col("run")).alias("run"))
    word = perturb(F.col("id"), F.col("run"), one_in) if one_in else F.col("run")
    return found.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def parity_mask(word: Column) -> Column:
    """Bit j: the j-th letter of LETTERS stands in the word an odd number of times; other code points share the bits above."""
    one = F.lit(1).cast("long")
    place = lambda c: F.when(F.lit(LETTERS).contains(c), F.instr(F.lit(LETTERS), c) - 1).otherwise(len(LETTERS) + F.ascii(c) % (_BITS - len(LETTERS)))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", one, place(c).cast("int"))))


def _keys(length: Column) -> Column:
    """The keys of a word under a length, its own or the next: one for each band and side."""
    half = F.floor(length / 2).cast("int")
    out = []
    for band in range(BANDS):
        bits = sum(1 << j for j in range(band, _BITS, BANDS))
        for side, text in enumerate((F.substring("word", F.lit(1), half), F.substring("word", -half, half))):
            out.append(F.xxhash64(length, F.lit(2 * band + side), F.col("mask").bitwiseAND(F.lit(bits).cast("long")), text))
    return F.array(*out)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of the words (word, n) that are one edit apart, once."""
    # Few map tasks read the words, and each word has twelve keys: deal them out first.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masked = words.repartition(parts, "word").select("word", "n", parity_mask(F.col("word")).alias("mask"), F.char_length("word").alias("len"))
    rows = lambda length, side: masked.select(F.explode(_keys(length)).alias("key"), *[F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "mask", "len")])
    long, short = rows(F.col("len"), "a"), rows(F.col("len"), "b").unionByName(rows(F.col("len") + 1, "b"))
    close = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    fit = (F.col("len_a") > F.col("len_b")) | ((F.col("len_a") == F.col("len_b")) & (F.col("word_a") > F.col("word_b")))
    met = long.hint("merge").join(short, (long["key"] == short["key"]) & fit & close & (F.levenshtein("word_a", "word_b", 1) == 1))
    return met.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain."""
    live = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = live.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(live.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(live)
        live = after.select("word", "root")
        live._scriptorium_cut = after._scriptorium_cut
        if after.where("moved").isEmpty():
            return live


def group(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words (word, n).

    form: the most frequent word one edit away, if it is `factor` times as
    frequent as the word; root: where the forms lead.
    """
    prepare(words.sparkSession)
    words = cut(words)
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    form_n = -F.col("best.less")
    taken = form_n >= factor * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, form_n).alias("form_n")))
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
