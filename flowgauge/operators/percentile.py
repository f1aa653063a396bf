"""Exact interpolated percentile per group (``percentile_cont``), skew-safe.

Spark's ``percentile`` aggregate is exact, but its final merge holds every
distinct value of a group in one task. That does not suit a hot group, such as
the org-wide scope of a busy day, which may hold a large share of all rows. Here
every group takes the same path, whatever its size, in one lazy plan:

1. equal values of a group are counted (combined before the shuffle);
2. the counts are added up by value prefix (``value >> BUCKET_BITS``), and a
   running sum over a group's prefixes finds the one or two that hold the
   wanted ranks: a group has as many rows here as prefixes, not as values;
3. only the values under those prefixes, at most ``2 ** BUCKET_BITS`` distinct
   ones each, are joined back and ranked by a second running sum.

Values are integers (durations are exact microsecond counts; a prefix is about
four seconds wide). The answer equals ``percentile_cont(p)``:
``lo + (hi - lo) * frac`` with ``lo``/``hi`` the values at ranks
``floor((n-1)p)``/``ceil((n-1)p)``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_V = "_pv"
BUCKET_BITS = 22


def _holds(rank: Column) -> Column:
    return (F.col("_start") <= rank) & (rank < F.col("_end"))


def grouped_percentile(df: DataFrame, keys: list[str], value: str | Column, p: float = 0.5,
                       out: str = "value", count_out: str | None = "sample_size", scale: float | None = None,
                       nonnull_out: str | None = None, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Return ``keys + [out, count_out, nonnull_out]`` for one ``p``; see :func:`grouped_percentiles`."""
    return grouped_percentiles(df, keys, value, {out: p}, count_out, scale, nonnull_out, bucket_bits)


def grouped_percentiles(df: DataFrame, keys: list[str], value: str | Column, wanted_ps: dict[str, float],
                        count_out: str | None = None, scale: float | None = None, nonnull_out: str | None = None,
                        bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Return ``keys``, a column for each ``{name: p}`` and ``count_out``: all of them from one
    count of the values, one running sum over the prefixes and one join.

    ``value`` must be integral (it is cast to LONG); ``scale`` divides the result
    (e.g. microseconds -> hours). ``nonnull_out`` names an optional count of
    the non-null values. ``count_out`` is the group's row count, nulls
    included, like ``count(*)``. All-null groups get a null percentile."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*[F.col(k) for k in keys], v.cast("long").alias(_V)).groupBy(*keys, _V).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_b", F.shiftright(F.col(_V), bucket_bits))
    known = F.when(F.col("_b").isNotNull(), F.col("_c")).otherwise(0)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")).select(
        *keys, "_b", F.sum("_c").over(group).alias("_n_all"), F.sum(known).over(group).alias("_n"),
        F.sum(known).over(upto).alias("_end"), known.alias("_known")).withColumn("_start", F.col("_end") - F.col("_known"))
    at = {name: (F.col("_n") - 1) * F.lit(p) for name, p in wanted_ps.items()}
    ranks = {name: (F.floor(pos).cast("long"), F.ceil(pos).cast("long")) for name, pos in at.items()}
    held = reduce(lambda a, b: a | b, [_holds(rank) for pair in ranks.values() for rank in pair])
    wanted = F.when(F.col("_n") == 0, F.lit(True)).otherwise(F.col("_b").isNotNull() & held)
    picks = ranked.filter(wanted).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_pb"),
                                         F.col("_start").alias("_before"), "_n", "_n_all")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b").eqNullSafe(F.col("_pb"))]
    inside = counts.join(picks, reduce(lambda a, b: a & b, same))
    within = Window.partitionBy(*keys, "_b").orderBy(_V).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(within)).withColumn("_start", F.col("_end") - F.col("_c"))
    ends = [F.max(F.when(_holds(rank), F.col(_V))).cast("double").alias(f"_{side}{i}")
            for i, pair in enumerate(ranks.values()) for side, rank in zip(("lo", "hi"), pair)]
    res = inside.groupBy(*keys).agg(*ends, F.max("_n").alias("_n"), F.max("_n_all").alias("_n_all"))
    cols = list(keys)
    for i, (name, pos) in enumerate(at.items()):
        q = F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))
        cols.append((q / F.lit(scale) if scale else q).alias(name))
    if count_out:
        cols.append(F.col("_n_all").alias(count_out))
    if nonnull_out:
        cols.append(F.col("_n").alias(nonnull_out))
    return res.select(*cols)
