"""The pipeline and the registered queries on the small tables."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from flowgauge.llm import queries as llm_queries
from flowgauge.llm import simhash
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE))
def test_queries_with_sql(spark, name):
    ok, message = compare(llm_queries.QUERIES[name](spark, SF), llm_queries.ORACLE[name], SF, duck(SF))
    assert ok, message


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


def test_rows_and_folds(spark):
    n = duckdb.sql(f"select count(*) from read_parquet('{SF}/documents.parquet')").fetchall()[0][0]
    for name, parts, held in (("op3_toxicity", 4, 2), ("op10_quality", 4, 2), ("op7_language", 5, 0)):
        rows = llm_queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == n
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)


def test_stages_against_brute_force(spark):
    """Dedup, near-dedup and decontamination of what the first stage keeps, by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    rows = {r.doc_id: r.text for r in first.select("doc_id", "text").collect()}
    assert len(rows) == docs.where(F.col("text").rlike(r"\p{L}")).count()  # every text here is clear
    latest = {}
    for d, t in rows.items():
        key = t.encode().lower()
        latest[key] = max(d, latest.get(key, d))
    rows = {d: rows[d] for d in latest.values()}
    prints = {d: simhash.fingerprint(t) for d, t in rows.items()}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.DISTANCE:
                root[max(find(a), find(b))] = min(find(a), find(b))
    rows = {d: t for d, t in rows.items() if find(d) == d}
    items = [x[0] for x in duckdb.sql(f"select text from read_parquet('{SF}/benchmark.parquet')").fetchall()]
    rows = {d: t for d, t in rows.items() if not any(x in t for x in items)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm_queries.tokenizer_path())
    for r in out:
        ids = tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "the cat and the dog sleep", "en", "s", 3), (3, "the cat and the dog sleep", "en", "s", 3), (None, "the dog sleeps", "en", None, None), (4, "12", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("uid", F.lit(0)).withColumn("fp", F.lit(1)).withColumn("kept", F.lit(True))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "fp", "kept"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["3", "None"]
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == [("3", True), ("None", True)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
