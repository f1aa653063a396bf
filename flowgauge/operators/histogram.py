"""Mergeable histograms of whole numbers.

Bins are exact below 128; above, every power of two is cut into 64 bins, so the lower
end of a bin is less than 1/64 below any of its values. Histograms over any sets of
rows merge by adding their counts, so days, repositories and windows merge without
raw rows; a group holds at most 64 bins for each power of two.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(value: str | Column) -> Column:
    """Lower end of the bin of a whole number; below zero counts as zero, null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.greatest(v.cast("long"), F.when(v.isNotNull(), F.lit(0).cast("long")))
    # 7 significant bits are kept: the length of the binary form less 7 is dropped
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def bin_quantiles(bins: DataFrame, keys: list[str], percents: dict[str, int], bin_col: str = "bin", count: str = "n") -> DataFrame:
    """``keys`` and for each ``{name: percent}`` the bin that holds the nearest rank. One row of
    ``bins`` per (keys, bin); the window of a group holds its bins, not its rows."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.select(*keys, bin_col, F.sum(count).over(upto).alias("_end"), F.sum(count).over(group).alias("_all"))
    rank = {name: F.floor((F.col("_all") * q + 99) / 100) for name, q in percents.items()}
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_end") >= r, F.col(bin_col))).alias(name) for name, r in rank.items()])
