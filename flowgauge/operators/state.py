"""Dedup, latest state, sticky flags, routing (D1-D8) and the raw/state sinks.

Arrival order is the ``seq`` column. All operators are aggregations keyed by
the entity (or natural) key, so they partition on that key and use map-side
partial aggregation; no operator needs a global order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import DELIVERY
from .recurring import Recurring, mark

NATURAL_KEY = ["source", "source_id", "event_type"]

# --- fixed values: event routing (source, event types) -> entity -------------
ROUTES = {
    "workflow_run": ("github", ["workflow_run", "workflow_run.snapshot"]),
    "pull_request": ("github", ["pull_request", "pull_request.snapshot"]),
    "pull_request_review": ("github", ["pull_request_review", "pull_request_review.snapshot"]),
    # jira:issue_deleted is deliberately not projected.
    "jira_issue": ("jira", ["issue.snapshot", "jira:issue_created", "jira:issue_updated"]),
    "jenkins_build": ("jenkins", ["build.snapshot"]),
    "ai_usage": (None, ["usage.snapshot"]),  # claude_code or copilot
}
AI_SOURCES = ["claude_code", "copilot"]
# ------------------------------------------------------------------------------


def dedup_events(env: DataFrame, key: list[str] = NATURAL_KEY, order: str = "seq") -> DataFrame:
    """First arrival per natural key wins. Rows are sorted once, behind the
    shuffle, where they are spread evenly; an aggregate that carries texts also sorts
    whole envelopes before it, in tasks as large as what the scan or join gave them.
    A key without any arrival number has no first arrival: only the key is returned."""
    arrivals = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_last())
    first = env.withColumn("_before", F.lag(F.lit(1)).over(arrivals)).filter(F.col("_before").isNull()).drop("_before")
    # Filters on key columns (routing by source/event type) are pushed below the window into the scan.
    return numbered(first, key, order)


def numbered(first: DataFrame, key: list[str] = NATURAL_KEY, order: str = "seq") -> DataFrame:
    """First arrivals; of one without an arrival number only the key."""
    return first.select(*[F.col(c) if c in key else F.when(F.col(order).isNotNull(), F.col(c)).alias(c) for c in first.columns])


def deliveries(env: DataFrame, key: list[str] = NATURAL_KEY, order: str = "seq") -> DataFrame:
    """Envelopes that carry their natural key through extraction, for :func:`first_rows`. One
    without an arrival number is never the first of its key (see :func:`dedup_events`)."""
    return env.filter(F.col(order).isNotNull()).withColumn(DELIVERY, F.struct(*[F.col(c) for c in key]))


def first_rows(rows: DataFrame, key: list[str] = NATURAL_KEY, order: str = "seq") -> DataFrame:
    """D1 behind extraction: of the rows extracted from :func:`deliveries`, those of the first arrival
    per natural key. The same rows as extraction from :func:`dedup_events`, but payloads are
    neither shuffled nor sorted. A first arrival that gives no row hides the later ones, too."""
    flat = rows.select(*[c for c in rows.columns if c != DELIVERY], F.col(DELIVERY)["keyed"].alias("_keyed"),
                       *[F.col(DELIVERY)[c].alias(f"_key_{c}") for c in key])
    arrivals = Window.partitionBy(*[f"_key_{c}" for c in key]).orderBy(order)
    first = flat.withColumn("_before", F.lag(F.lit(1)).over(arrivals)).filter(F.col("_before").isNull() & F.col("_keyed"))
    return first.select(*[c for c in rows.columns if c != DELIVERY])


def latest_state(df: DataFrame, keys: list[str], order: str = "received_at", tie: str = "seq") -> DataFrame:
    """One row per key, the one with the greatest ``order``; among equal
    ``order`` values the earliest arrival wins (an update must be *strictly*
    newer to replace the stored row)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]),
                                          F.struct(F.col(order), -F.col(tie))).alias("_s"))
    return best.select(*[F.col(k) for k in keys], *[F.col("_s")[c].alias(c) for c in rest]).select(*df.columns)


# Arrival chunks for the guard: seq >> CHUNK_SHIFT. With seq = arrival
# microseconds x 4 a chunk spans about 18 minutes of arrivals.
CHUNK_SHIFT = 32


def with_record_high(df: DataFrame, keys: list[str], order: str = "received_at", tie: str = "seq",
                     out: str = "_high", chunk_shift: int = CHUNK_SHIFT) -> DataFrame:
    """Add ``out``: True when ``order`` is strictly greater than that of every
    earlier arrival (by ``tie``) with the same key - the latest-state guard.

    This is a prefix maximum in arrival order. Done as one window per key it
    would put a hot key in one task, so arrivals are cut into chunks of
    ``tie >> chunk_shift``: the maximum of each (key, chunk) is a partial
    aggregate, a window over a key's *chunks* carries the maximum of all
    earlier chunks in, and a window over one (key, chunk) finishes the prefix.
    """
    chunk = F.shiftright(F.col(tie), chunk_shift)
    c = df.withColumn("_chunk", chunk)
    per_chunk = c.groupBy(*keys, "_chunk").agg(F.max(order).alias("_cmax"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, "_chunk", F.max("_cmax").over(wc).alias("_carry"))
    wi = Window.partitionBy(*keys, "_chunk").orderBy(F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    j = c.join(carry, [*keys, "_chunk"], "left").withColumn("_inner", F.max(order).over(wi))
    prev = F.greatest(F.col("_carry"), F.col("_inner"))
    return j.withColumn(out, prev.isNull() | (F.col(order) > prev)).drop("_chunk", "_carry", "_inner")


def sticky_flag(df: DataFrame, keys: list[str], flag: str, order: str = "received_at", tie: str = "seq") -> DataFrame:
    """D3: per key, OR of ``flag`` over the events that passed the latest-state
    guard (a late, older event cannot set the flag). Returns keys + flag."""
    passed = with_record_high(df, keys, order, tie, "_passed")
    return passed.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("_passed") & F.coalesce(F.col(flag), F.lit(False))), F.lit(False)).alias(flag))


def late_events(df: DataFrame, keys: list[str], order: str = "received_at", tie: str = "seq") -> DataFrame:
    """The events the guard ignored (not newer than what had arrived). Only keys with
    several events are guarded; one without a time neither is late nor makes another so."""
    timed = df.filter(F.col(order).isNotNull())
    recurring = Recurring.planned(timed.select(mark(*keys).alias("mark")))
    return with_record_high(recurring.again(timed, mark(*keys)), keys, order, tie, "_high").filter(~F.col("_high")).drop("_high")


def connector_activity(env: DataFrame) -> DataFrame:
    """Latest receive time per source, counting redeliveries too."""
    return env.groupBy("source").agg(F.max("received_at").alias("last_checked_at"),
                                     F.count(F.lit(1)).alias("deliveries"))


def route_events(env: DataFrame) -> dict[str, DataFrame]:
    """Entity -> its envelopes; unknown types stay in raw only."""
    out = {}
    for entity, (source, types) in ROUTES.items():
        cond = F.col("event_type").isin(types)
        cond = cond & (F.col("source") == source if source else F.col("source").isin(AI_SOURCES))
        out[entity] = env.filter(cond)
    return out


def entity_of(source: Column, event_type: Column) -> Column:
    """D6 as a column: the entity an envelope projects to, else null."""
    expr = None
    for entity, (src, types) in ROUTES.items():
        cond = event_type.isin(types) & (source == src if src else source.isin(AI_SOURCES))
        expr = F.when(cond, entity) if expr is None else expr.when(cond, entity)
    return expr


def drop_replayed(env: DataFrame, stored: DataFrame) -> DataFrame:
    """Envelopes whose natural key is not stored yet (ON CONFLICT DO NOTHING)."""
    return env.join(stored.select(*NATURAL_KEY), NATURAL_KEY, "left_anti")


def narrowed(rows: DataFrame, keys: list[str], only: list[str] | None) -> DataFrame:
    return rows if only is None else rows.select(*dict.fromkeys([*keys, *only, "received_at", "seq"]))


def rebuild(env: DataFrame, entity: str, extractor, keys: list[str], sticky: str | None = None,
            only: list[str] | None = None) -> DataFrame:
    """Replay raw envelopes into a latest-state table: route (D6), extract (E*),
    dedup (D1), then latest state (D2) with an optional sticky flag. ``only`` names the
    columns wanted beside keys and time; others aren't moved."""
    rows = first_rows(extractor(route_events(deliveries(env))[entity]))
    state = latest_state(narrowed(rows, keys, only), keys)
    if sticky:
        flags = sticky_flag(rows, keys, sticky)
        state = state.drop(sticky).join(flags, keys, "inner")
    return state.drop("seq").withColumnRenamed("received_at", "last_received_at")
