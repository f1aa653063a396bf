"""Parquet table access.

Tables are read with ``spark.read.parquet`` and immediately narrowed to the
columns a plan needs, so Catalyst prunes the scan's ``ReadSchema`` and pushes
filters into the parquet reader.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(base: str, name: str) -> str:
    p = os.path.join(base, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in base else os.path.join(base, name)


def read_table(spark: SparkSession, base: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(table_path(base, name))
    return df.select(*cols) if cols else df
