"""One page of an ordered result, at a cost that doesn't grow with the page number.

``OFFSET n`` brings n rows to one task. Here the order is cut into cells, twice: coarse
ones (a day, a repository), then fine ones inside (a second). Counts of the coarse cells
and their running sum name those that the page touches, the fine cells inside them are
counted likewise, and only rows of the touched fine cells are ranked. Cells must follow
the order: every row of a cell stands before every row of the next.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT_ROWS = 10_000  # up to this rank a bounded top-k is cheaper than counting


def _touched(counts: DataFrame, keys: list[str], window, first: int, last: int) -> DataFrame:
    """Cells that hold a rank in ``first``..``last``; ``_base`` is the rank before the enclosing cell's first row."""
    before = F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_start", F.col("_base") + before)
    hit = placed.filter((F.col("_start") < last) & (F.col("_start") + F.col("_n") >= first))
    return hit.select(*[F.col(k).alias(f"_t{k}") for k in keys], F.col("_start").alias("_base"))


def _inside(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t{k}"))
    return rows.join(cells, same).drop(*[f"_t{k}" for k in keys])


def page_of(df: DataFrame, order: list[Column], coarse: Column, fine: Column, coarse_desc: bool, fine_desc: bool,
            page: int, size: int, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Rows ``page * size`` to ``(page + 1) * size`` of ``df`` in ``order``, which must be total for stable
    pages. ``coarse`` and ``fine`` are the cells, in ascending order unless said so (nulls as Spark sorts them)."""
    first, last = page * size + 1, (page + 1) * size
    if last <= direct_rows:
        return df.orderBy(*order).offset(first - 1).limit(size)
    way = lambda c, desc: F.col(c).desc() if desc else F.col(c).asc()
    rows = df.withColumns({"_c0": coarse, "_c1": fine})
    counted = rows.groupBy("_c0").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.lit(0).cast("long"))
    cells = _touched(counted, ["_c0"], Window.orderBy(way("_c0", coarse_desc)), first, last)
    counted = _inside(rows.select("_c0", "_c1"), cells, ["_c0"]).groupBy("_c0", "_c1", "_base").agg(F.count(F.lit(1)).alias("_n"))
    cells = _touched(counted, ["_c0", "_c1"], Window.partitionBy("_c0").orderBy(way("_c1", fine_desc)), first, last)
    ranked = _inside(rows, cells, ["_c0", "_c1"]).withColumn(
        "_rank", F.col("_base") + F.row_number().over(Window.partitionBy("_c0", "_c1").orderBy(*order)))
    return ranked.filter(F.col("_rank").between(first, last)).orderBy(*order).select(*df.columns)
