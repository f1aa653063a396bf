"""Registered queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import bpe, decontam, exact, jaccard, langid, merkle, pii, quality, simhash, substring, toxicity, urlfilter, whitening
from flowgauge.llm.common import bounded_labels, documents_of, fold, learning_labels, stored, table
from flowgauge.llm.oracle import SQL

TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", "n_slots", "n_changed")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(table(spark, sf_dir, "documents"))
    labels = learning_labels(table(spark, sf_dir, "labels"), "toxic", 4, 2)
    learning = docs.where(fold(F.col("doc_id"), 4) != 2)  # no other row has a label there
    model = toxicity.train(learning, stored(labels, "labels"))
    out = docs.select("doc_id", toxicity.judge(F.col("text"), model, docs).alias("found"))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    score = F.col("found.score")
    return out.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.col("found.passages").alias("passages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("n_added")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs.where(~held))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), langid.predict(F.col("text").cast("string"), model, docs).alias("found"))
    return out.select("doc_id", held.alias("held_out"), "found.lang_pred", "found.score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages")).drop("ratio")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, with_decoded=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = bounded_labels(table(spark, sf_dir, "labels"), "quality", 4, 2, quality.LABELS, 10)
    model = quality.train(stats, stored(labels, "labels"))
    score = quality.score(F.col("stats"), model, stats)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    out = stats.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring": op2_substring,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language": op7_language,
    "op8_url_filter": op8_url_filter,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_jaccard": op13_jaccard,
}

ORACLE: dict[str, str] = dict(SQL)
