"""The opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, feature_join, language_id, line_dedup, page_text, personal_data, piece_codec, quality_model, quality_rules, sharding, simhash, spelling, toxicity
from .oracle import FEATURE_JOIN, QUALITY_RULES, SPELLING
from .runtime import fold, table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every whole text, and the spans that the segment model adds."""
    return personal_data.scan(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: a row's place is decided by its number, and shards differ by one row at most."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id that links reach."""
    return simhash.link(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, keep=fold("doc_id", 3) != 1)
    return language_id.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, keep=fold("doc_id", 4) != 2)
    out = toxicity.score(docs, model)
    return out.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.concat_ws(",", F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("offending"),
    )


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with dropout 0.1 and seed 7, and decoded again."""
    return piece_codec.digest(table(spark, sf_dir, "documents"), piece_codec.default_model(), dropout=0.1, seed=7)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the rule table's verdict."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), F.concat_ws(",", "failed").alias("failed"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and distinct benchmark item that it contains to 0.8 or more."""
    return decontamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), expand=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels, keep=fold("doc_id", 4) != 2)
    return quality_model.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many lines stay (none in an empty text, null without a text), and a digest of the text that they make."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents"), drop_emptied=False, sketch=True)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return out.select("doc_id", F.when(F.col("text") == "", 0).otherwise(lines).alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven code points and two occurrences or more, their near words, forms and roots."""
    return spelling.group(spelling.count_words(table(spark, sf_dir, "documents")), factor=10)


def op12_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per label: the version of its document's source that holds at its time. A repeated doc_id has the smallest of its sources."""
    part = lambda c, k: F.conv(F.substring(F.sha2(F.col(c).cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")
    docs = table(spark, sf_dir, "documents")
    event = docs.select("source", "doc_id", "n_chars", "lang", (part("doc_id", 0) % 200000).alias("event"), part("doc_id", 1).alias("b"), part("doc_id", 2).alias("c"))
    versions = event.select("*", (F.col("event") - 60 + F.col("b") % 1200).alias("arrival"), (F.col("event") + F.col("c") % 900).alias("expiry"))
    versions = versions.select(F.col("source").alias("about"), "event", "arrival", "expiry", F.greatest("event", "arrival").alias("usable"), F.col("doc_id").alias("version_id"), F.col("n_chars").alias("version_chars"), F.col("lang").alias("version_lang"))
    of = docs.groupBy("doc_id").agg(F.min("source").alias("about"))
    asks = table(spark, sf_dir, "labels").select("doc_id", (part("doc_id", 3) % 200000).alias("t")).join(of.hint("merge"), "doc_id", "left")
    found = feature_join.point_in_time(asks, versions, "about", "t", "usable", "expiry", ["event", "arrival", "version_id"], ["version_id", "event", "version_chars", "version_lang"])
    age = F.col("t") - F.col("event")
    status = F.when(F.col("version_id").isNull(), "none").when(age > 20, "stale").otherwise("fresh")
    fresh = status == "fresh"
    return found.select("doc_id", "t", "version_id", age.alias("age"), status.alias("status"), F.when(fresh, F.col("version_chars")).alias("n_chars"), F.when(fresh, F.col("version_lang")).alias("lang"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": op1_personal_data,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_piece_codec": op6_piece_codec,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling": op11_spelling,
    "op12_feature_join": op12_feature_join,
    "op13_page_text": op13_page_text,
}

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": QUALITY_RULES, "op11_spelling": SPELLING, "op12_feature_join": FEATURE_JOIN}
