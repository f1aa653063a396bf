"""Rows whose key comes more than once, told from the others before rows are moved.

A dedup or a guard compares rows of one key, so a row that is alone under its key needs
neither a shuffle nor a sort. Short hashes of the keys are counted (the only thing shuffled
for every row), and :class:`Recurring` keeps one bit for each hash that came more than once.
Different keys may share a hash or a bit: such rows are compared without need, so the bits
decide what a row costs, never what becomes of it. The rows are read twice, for the hashes
and by whoever asks, and must name the same keys both times.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freed_shuffles

MARK_BITS = 40         # of a key's hash; at 500 million keys one in 2,000 meets another's
BITS_PER_MARK = 16
PAGE_BITS = 2 ** 15    # of one row of the bit table (bitmap_construct_agg)
MOST_BITS = 2 ** 29    # 64 MB, all that is ever broadcast; beyond, more rows share a bit
PLANNED_BITS = 2 ** 28


def mark(*key: Column | str) -> Column:
    """The hash that stands for a key; keys that are equal, nulls included, have the same."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - MARK_BITS)


def _found(marks: DataFrame) -> DataFrame:
    # shuffled before they are counted: an aggregate ahead of it would carry counts of mostly single marks
    return marks.repartition("mark").groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")


class Recurring:
    """One bit for each of ``found`` (marks), in rows of ``PAGE_BITS``."""

    def __init__(self, found: DataFrame, bits: int):
        self.bits = bits
        page, bit = self._place(F.col("mark"))
        self.table = found.select(page.alias("_page"), bit.alias("_bit")).repartition("_page").groupBy("_page") \
            .agg(F.bitmap_construct_agg("_bit").alias("_bits"))

    @classmethod
    def planned(cls, marks: DataFrame) -> Recurring:
        """Those of ``marks`` (one column, ``mark``) that come more than once, found by the plan that asks for them."""
        return cls(_found(marks), PLANNED_BITS)

    def _place(self, of: Column) -> tuple[Column, Column]:
        at = of.bitwiseAND(F.lit(self.bits - 1))
        return F.shiftright(at, 15), at.bitwiseAND(F.lit(PAGE_BITS - 1))

    def _met(self, of: Column) -> Column:
        page, bit = self._place(of)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (page == F.col("_page")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)

    def again(self, rows: DataFrame, of: Column) -> DataFrame:
        """Rows that may share their mark with others."""
        return rows.join(F.broadcast(self.table), self._met(of), "left_semi")

    def once(self, rows: DataFrame, of: Column) -> DataFrame:
        """Rows that certainly don't."""
        return rows.join(F.broadcast(self.table), self._met(of), "left_anti")


@contextmanager
def counted(marks: DataFrame) -> Iterator[Recurring]:
    """The same, counted at once for jobs inside the block: with as many bits as there are marks for,
    and without the marks' shuffle files."""
    from ..sources.sinks import COMPACT, drop_folder, table_root

    spark = marks.sparkSession
    folder = table_root(spark, f"recurring-{uuid.uuid4().hex}")
    try:
        with freed_shuffles(spark):
            _found(marks).write.options(**COMPACT).parquet(f"{folder}/marks")
            found = spark.read.schema("mark long").parquet(f"{folder}/marks")
            bits, wanted = PAGE_BITS, min(found.count() * BITS_PER_MARK, MOST_BITS)
            while bits < wanted:
                bits *= 2
            kept = Recurring(found, bits)
            kept.table.write.options(**COMPACT).parquet(f"{folder}/bits")
        kept.table = spark.read.schema(kept.table.schema).parquet(f"{folder}/bits")
        yield kept
    finally:
        drop_folder(spark, folder)
