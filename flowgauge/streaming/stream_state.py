"""Continuous ingest (D7): envelope stream -> raw table -> latest-state tables.

Two streams, the second run once after each micro-batch of the first:

**Landing** (:func:`land_batch`, ``readStream`` over landed envelope files):
0. unreadable envelopes and those that lack a field go to the quarantine (K4);
1. connector activity (D4) from every delivery, duplicates included;
2. the first arrival per natural key of the batch is kept (``landed``).

**Merging** (:func:`merge_batch`, ``readStream`` over ``landed``):
3. exact dedup (D1): ``dropDuplicates`` on the natural key, without a watermark.
   The keys seen so far are keyed state in RocksDB, of which only changes are
   checkpointed, so a micro-batch looks up its own keys and doesn't read the raw
   table. A batch of ``landed`` is one landing batch and holds a key once, so
   the row that stays is the first arrival. State is spread over
   ``spark.sql.shuffle.partitions`` of the first run: size it for the stream;
4. fresh envelopes are appended to the raw table under the batch's number (K1)
   and read back (not from the lineage, so a lost executor cannot change what
   was appended), routed (D6), extracted (E*) and merged into each state table
   (K2: guard D2, sticky D3); routed envelopes that name no entity are kept as
   dead letters (``unkeyed``).

What a batch lands or appends is written once under its number, state merges are
idempotent, and a merging batch that was cut off runs again from the state before
it, so replayed micro-batches leave the same tables. ``landed`` files are deleted
once a later batch has been merged.
Batch and stream give the same tables when micro-batches follow arrival order.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import state as S
from ..plans import params as P
from ..sources import readers as R
from ..sources.sinks import COMPACT, _exists, drop_folder, write_state
from ..operators.state import NATURAL_KEY, dedup_events

ENTITIES = {
    # entity: (extractor, keys, sticky flag)
    "workflow_run": (E.extract_runs, ["repo", "run_id"], None),
    "jenkins_build": (E.extract_builds, ["repo", "run_id"], None),
    "pull_request": (E.extract_pull_requests, ["repo", "pr_id"], None),
    "pull_request_review": (E.extract_reviews, ["repo", "review_id"], None),
    "jira_issue": (E.extract_issues, ["issue_key"], "reopened"),
    "ai_usage": (lambda ev: E.extract_usage(ev, P.COPILOT_MONTHLY_SEAT_USD), ["source", "actor_key", "day"], None),
}
# Jenkins builds and GitHub runs share one state table.
STATE_TABLE = {"workflow_run": "workflow_run_state", "jenkins_build": "workflow_run_state",
               "pull_request": "pull_request_state", "pull_request_review": "pull_request_review_state",
               "jira_issue": "jira_issue_state", "ai_usage": "ai_usage_state"}


def _once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless an earlier attempt of the batch did; the stored rows.
    They are read in the session ``spark``: that of a stream with state plans
    without adaptive execution."""
    if not _exists(spark, path + "/_SUCCESS"):
        df.write.mode("overwrite").options(**COMPACT).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, root: str) -> None:
    """One micro-batch of the landing stream, then the merging stream over what it landed."""
    # S3: envelopes that cannot be read or lack a field are kept as dead letters (K4).
    batch, bad = R.split_envelopes(batch)
    bad.write.mode("overwrite").parquet(f"{root}/quarantine/epoch={epoch_id}")
    # Activity over all deliveries (tiny: one row per source).
    act = S.connector_activity(batch).withColumn("epoch", F.lit(epoch_id))
    act.write.mode("overwrite").parquet(f"{root}/connector_activity/epoch={epoch_id}")
    landed = _once(spark, dedup_events(batch), f"{root}/landed/epoch={epoch_id}")
    stream = spark.readStream.schema(landed.schema).option("cleanSource", "delete").parquet(f"{root}/landed/epoch=*")
    q = (stream.dropDuplicates(NATURAL_KEY).writeStream.foreachBatch(lambda df, n: merge_batch(spark, df, n, root))
         .option("checkpointLocation", f"{root}/_seen_keys").trigger(availableNow=True).start())
    q.awaitTermination()


def merge_batch(spark: SparkSession, fresh: DataFrame, number: int, root: str) -> None:
    """One micro-batch of the merging stream: ``fresh`` holds envelopes whose key was not seen before."""
    fresh = _once(spark, fresh, f"{root}/raw_event/epoch={number}")
    # D6 -> E* -> K2, one merge per state table.
    # The natural key rides in the arrival time through the extractors, which pass it on
    # untouched, so envelopes that one of them could not key are told apart (K4).
    place = F.struct("received_at", *NATURAL_KEY)
    routed = S.route_events(fresh.withColumn("received_at", place))
    keyed: list[DataFrame] = []
    per_table: dict[str, list[DataFrame]] = {}
    for entity, (extractor, keys, sticky) in ENTITIES.items():
        per_table.setdefault(STATE_TABLE[entity], []).append(extractor(routed[entity]))
    for table, parts in per_table.items():
        updates = parts[0]
        for x in parts[1:]:
            updates = updates.unionByName(x)
        entity = next(e for e, t in STATE_TABLE.items() if t == table)
        _, keys, sticky = ENTITIES[entity]
        # payloads are parsed once a batch: the merge reads its updates several times
        staged = f"{root}/_updates/{table}"
        updates.write.mode("overwrite").options(**COMPACT).parquet(staged)
        updates = spark.read.schema(updates.schema).parquet(staged)
        keyed.append(updates.select("received_at.*").select(*NATURAL_KEY))
        updates = updates.withColumn("received_at", F.col("received_at.received_at"))
        write_state(updates, keys, f"{root}/{table}", sticky=sticky)
    entity = S.entity_of(F.col("source"), F.col("event_type"))
    routed_rows = fresh.filter(entity.isNotNull())
    # told apart by their keys alone, kept by themselves: whole envelopes meet them in a
    # join that is a broadcast by their measured size, as few are lost
    staged = f"{root}/_updates/unkeyed"
    routed_rows.select(*NATURAL_KEY).join(reduce(DataFrame.unionByName, keyed), NATURAL_KEY, "left_anti") \
        .write.mode("overwrite").options(**COMPACT).parquet(staged)
    lost_keys = spark.read.schema(fresh.select(*NATURAL_KEY).schema).parquet(staged)
    lost = routed_rows.join(lost_keys, NATURAL_KEY, "left_semi")
    lost.withColumn("reason", F.concat(F.lit("no key: "), entity)).write.mode("overwrite").parquet(f"{root}/unkeyed/batch={number}")
    drop_folder(spark, f"{root}/_updates")


def stream_state(spark: SparkSession, source_path: str, root: str, checkpoint: str,
                 fmt: str = "json"):
    """Run the ingest stream over landed envelope files (S3) until all that are
    there are processed (``availableNow``); state tables, and the dead letters in
    ``quarantine``, land under ``root``."""
    # shuffle files of a finished step go at once, not with the driver's next garbage collection
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        stream = R.scan_envelopes(spark, source_path, streaming=True, fmt=fmt)
        q = (stream.writeStream.foreachBatch(lambda df, eid: land_batch(spark, df, eid, root))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return q


def connector_activity_table(spark: SparkSession, root: str) -> DataFrame:
    """D4 over all processed micro-batches."""
    a = spark.read.parquet(f"{root}/connector_activity")
    return a.groupBy("source").agg(F.max("last_checked_at").alias("last_checked_at"),
                                   F.sum("deliveries").alias("deliveries"))


def bounded_dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """D1, bounded variant: drop redeliveries that arrive within ``delay`` of
    the first one (state is bounded by the watermark; later redeliveries pass)."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(NATURAL_KEY)


def quarantine_table(spark: SparkSession, root: str) -> DataFrame:
    """Dead letters of all processed micro-batches: unreadable or incomplete envelopes, and
    whole ones that name no entity (a pull request without an id)."""
    bad = spark.read.parquet(f"{root}/quarantine")
    if not _exists(spark, f"{root}/unkeyed"):
        return bad
    return bad.unionByName(spark.read.parquet(f"{root}/unkeyed"), allowMissingColumns=True)


SLICES = 4


def arrival_slices(env: DataFrame, slices: int = SLICES) -> DataFrame:
    """Test harness for the stream: the envelopes with the number ``slice`` of the
    range of arrival numbers they fall in. A slice is landed (by many tasks) once its
    predecessor was processed, as a broker delivers in order. The bounds are a handful
    of approximate quantiles of ``seq``."""
    bounds = env.approxQuantile("seq", [i / slices for i in range(1, slices)], 0.001)
    if not bounds:
        return env.withColumn("slice", F.lit(0))
    return env.filter(F.col("seq").isNotNull()).withColumn("slice", sum((F.col("seq") > F.lit(b)).cast("int") for b in bounds))
