"""Forward as-of joins (J1-J3), skew-safe.

``first_at_or_after``: for every left row, the earliest right timestamp with the
same ``by`` key that is at or after the left timestamp (ties count), else null.

A window ``min(ts) over (partition by repo order by ts desc)`` solves this in one
pass, but one window partition per repo puts a hot repo in one task. Instead
time is cut into fixed slots of ``slot_seconds``:

1. **In-slot**: left and right rows are unioned (left rows keep their columns,
   right rows carry only key and time) and a running ``min`` over the slot,
   ordered by time descending with a RANGE frame (equal times are peers, so
   ``>=`` holds), gives the answer when it lies in the left row's own slot. A
   window partition is one (key, slot), bounded by the slot width, not by the
   size of the key.
2. **Later slots**: the right side is pre-aggregated to ``min(ts)`` per
   (key, slot); together with the distinct left (key, slot) pairs this small
   table gives, per left slot, the minimum of all strictly later slots. Its
   window partition is one key's *slots*, which is bounded by the time range.

The answer is ``coalesce(in_slot, later_slots)``. Nothing is collected, no pair
of rows is enumerated, and both shuffles are on (key, slot) or on the small slot
summary.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot(ts: Column, slot_seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(slot_seconds)).cast("long")


def first_at_or_after(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                      out: str, slot_seconds: int = 3600) -> DataFrame:
    """Left rows plus ``out`` = min right ts >= left ts with equal ``by`` keys."""
    lcols = left.columns
    tag, slot, t, rt = "_asof_kind", "_asof_slot", "_asof_t", "_asof_rt"
    lft = left.select(*[F.col(c) for c in lcols], F.lit(0).alias(tag),
                      _slot(F.col(left_ts), slot_seconds).alias(slot), F.col(left_ts).alias(t))
    rgt_keys = right.select(*[F.col(k) for k in by], F.col(right_ts).alias(t)).filter(F.col(t).isNotNull())
    rgt = rgt_keys.select(*by, F.lit(1).alias(tag), _slot(F.col(t), slot_seconds).alias(slot), t)
    u = lft.unionByName(rgt, allowMissingColumns=True)
    w = (Window.partitionBy(*by, slot).orderBy(F.col(t).desc())
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    in_slot = (u.withColumn(rt, F.min(F.when(F.col(tag) == 1, F.col(t))).over(w))
               .filter(F.col(tag) == 0))

    # Slot summary: first right time per (key, slot) and the left slots asking.
    rmin = rgt.groupBy(*by, slot).agg(F.min(t).alias("_smin"))
    lslots = lft.select(*by, slot).distinct().withColumn("_smin", F.lit(None).cast(rmin.schema["_smin"].dataType))
    both = rmin.withColumn("_is_r", F.lit(1)).unionByName(lslots.withColumn("_is_r", F.lit(0)))
    # Descending slots; at equal slot the left marker sorts first, so the ROWS
    # frame "everything before me" is exactly the strictly later slots.
    ws = (Window.partitionBy(*by).orderBy(F.col(slot).desc(), F.col("_is_r").asc())
          .rowsBetween(Window.unboundedPreceding, -1))
    later = (both.withColumn("_later", F.min("_smin").over(ws))
             .filter(F.col("_is_r") == 0).select(*by, slot, "_later"))
    joined = in_slot.join(later, [*by, slot], "left")
    return joined.select(*[F.col(c) for c in lcols], F.coalesce(F.col(rt), F.col("_later")).alias(out))


def first_within(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                 out: str, within_seconds: int, slot_seconds: int = 3600) -> DataFrame:
    """Like :func:`first_at_or_after` but null when the match is more than
    ``within_seconds`` later (bounds inclusive). The nearest match is the only
    candidate that can fall in the bound, so this is exact."""
    j = first_at_or_after(left, right, by, left_ts, right_ts, out, slot_seconds)
    ok = F.unix_micros(F.col(out)) - F.unix_micros(F.col(left_ts)) <= F.lit(within_seconds * 1_000_000)
    return j.withColumn(out, F.when(ok, F.col(out)))


def followed_within(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                    out: str, within_seconds: int, slot_seconds: int = 3600) -> DataFrame:
    """0/1 flag, 1 when some right row lies in [left_ts, left_ts + within]."""
    j = first_within(left, right, by, left_ts, right_ts, "_fw_match", within_seconds, slot_seconds)
    return j.withColumn(out, F.col("_fw_match").isNotNull().cast("long")).drop("_fw_match")
