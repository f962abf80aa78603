"""Quality rules: a threshold table compiled into one Spark projection.

Counts and ratios of a text are column expressions; a rule is a row of the
threshold table (metric, lower bound, upper bound). `compile_rules` turns the
table into one array of the names of the rules that a text fails. There is no
user function, no join and no shuffle: a text is judged where it is read.

Repeated 8-word windows: window hashes are 64-bit; only texts with two equal
window hashes pay for finding the covered words.

Cases: a null text is treated as empty, has no words and fails the word
minimum. Repeated rows get the same verdict. Extra columns are ignored. Texts
of any length are read whole; a value on a bound passes; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common short words of English, German, French and Spanish.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "it", "on", "as", "was", "by"],
    "de": ["der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "ein", "eine", "nicht", "auf", "in"],
    "fr": ["le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "pour", "dans", "en", "par"],
    "es": ["el", "la", "los", "de", "y", "que", "en", "un", "una", "por", "con", "para", "del", "las"],
}


@dataclass(frozen=True)
class Rule:
    """A text fails if metric < low or metric > high (either may be open)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production table.
RULES = (
    Rule("few_words", "n_words", low=20),
    Rule("mean_word_length", "mean_word_length", low=2, high=20),
    Rule("symbols_per_word", "symbol_ratio", high=0.5),
    Rule("repeated_windows", "repeat_ratio", high=0.30),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("adjacent_repeats", "adjacent_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.005),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def metrics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and every metric of each whole text."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    split = base.select(
        "doc_id", _words(F.col("text")).alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
    )
    hashed = split.select(
        "doc_id", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.size(F.filter("words", lambda w: F.translate(F.lower(w), ".,;:!?", "").isin(sorted({w for ws in STOP_WORDS.values() for w in ws})))).cast("long").alias("n_stop_words"),
    )
    at = lambda i, k: F.get("h", i + F.lit(k))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    windowed = hashed.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    windowed = windowed.withColumn("n_adjacent", F.when(F.col("n_words") > 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_words") - 1).cast("int")), lambda i: F.get("h", i) == F.get("h", i - 1)))).otherwise(0).cast("long")).drop("h")
    repeated = windowed.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    # Positions of windows whose hash occurs again, in order; a null array where no window repeats.
    placed = repeated.withColumn("placed", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i, d: F.get("placed", i + F.lit(d))["h"]
    twin = lambda p, i: p["h"].eqNullSafe(near(i, -1)) | p["h"].eqNullSafe(near(i, 1))
    starts = placed.withColumn("starts", F.sort_array(F.transform(F.filter("placed", twin), lambda p: p["i"])))
    step = lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get("starts", i + F.lit(1)) - p), F.lit(WINDOW))
    covered = F.coalesce(F.aggregate(F.transform("starts", step), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    counts = starts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"), "n_stop_words", "n_adjacent")
    some = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "*", (F.col("word_chars") / some).alias("mean_word_length"), (F.col("n_symbols") / some).alias("symbol_ratio"), (F.col("n_repeat_words") / some).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"), ((F.col("n_stop_words") + 1) / some).alias("stop_ratio"), (F.col("n_adjacent") / some).alias("adjacent_ratio"),
    )


def compile_rules(rules=RULES) -> Column:
    """Array of the names of the rules that fail."""
    checks = []
    for r in rules:
        value = F.col(r.metric)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        checks.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def judge(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, all metrics, `failed` (names of failed rules) and `kept`."""
    return metrics(docs, id_column, text_column).withColumn("failed", compile_rules(rules)).withColumn("kept", F.size("failed") == 0)
