"""Corpus pipeline: five stages over the documents table, each calling one operator.

Every stage reads all its predecessor kept, from a stored table. All but the
last return the columns of ``documents``; the last returns the token ids. A row
with a null text or without letters leaves at the first stage; an empty table
passes through; extra columns are carried along; rows that share a doc_id are
judged each for itself (near duplicates and leaks by row, near copies by doc_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import bpe, decontam, exact, langid, simhash
from flowgauge.llm.common import fold, stored, table
from flowgauge.llm.queries import tokenizer_path

#: Languages are accepted from this calibrated probability on.
LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts whose language is in doubt."""
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs.where(~held))
    judged = docs.withColumn("__language", langid.predict(F.col("text").cast("string"), model, docs))
    clear = (F.col("__language.lang_pred") != langid.UNKNOWN) & (F.col("__language.score") >= LANGUAGE_SCORE)
    return judged.where(clear).drop("__language")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    return simhash.keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    coded = bpe.encode(docs, tokenizer_path(), with_decoded=False)
    ids = F.when(F.col("n_tokens") == 0, F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"), "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Trained models, SimHash and BPE have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
