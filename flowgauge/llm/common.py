"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (read from the session); only where it is unset, as in
unit tests on a local master, a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_FOLDER = "llm-tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; refuses a cluster that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = spark.conf.get("spark.flowgauge.llm.tmp", None)
    if not found:
        found = tempfile.mkdtemp(prefix="flowgauge-llm-")
        spark.conf.set("spark.flowgauge.llm.tmp", found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs its own tasks only, and each later
    use reads the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{TABLE_FOLDER}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a frame that may carry any other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_row_id(docs: DataFrame, name: str = "uid") -> DataFrame:
    """Number the rows; the same scan gives the same numbers each time it is read.

    Operators join on this number, not on doc_id, so rows that share or lack a
    doc_id stay apart.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def learning_labels(labels: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    """Labels of the learning folds as (doc_id, label).

    Rows with a null id or label are left out; a repeated id counts once, with
    label 1 if any of its rows has 1.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), parts) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def sampling_order(doc_id: Column, salt: int) -> Column:
    """A number from 0 to below 1 by a hash of doc_id, the same on every run."""
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def bounded_labels(labels: DataFrame, column: str, parts: int, held_out: int, bound: int, salt: int) -> DataFrame:
    """``learning_labels``, at most about ``bound`` rows.

    Above ``bound`` rows, a hash of doc_id picks ``bound`` of them in expectation,
    the same on every run.
    """
    rows = learning_labels(labels, column, parts, held_out)
    count = rows.count()
    if count <= bound:
        return rows
    return rows.where(sampling_order(F.col("doc_id"), salt) < bound / count)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), as (node, root = smallest node).

    Alternates large-star and small-star rounds until the edges no longer
    change. Each round is two keyed minima (combined before the shuffle) and two
    joins against one row per node, so a hub with a third of all edges is split
    by the adaptive skew join; each round's edges are stored, never collected.
    """
    state = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        near = large.join(least, "a")
        small = near.select("a", F.col("m").alias("b")).unionByName(near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        state = stored(small.distinct(), "edges")
    return state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
