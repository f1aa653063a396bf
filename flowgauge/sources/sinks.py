"""Sinks (K1-K5).

Tables are parquet folders. Raw events are append-only and partitioned by
``source`` and ``event_type`` (routing then prunes whole folders); state
tables are partitioned by a hash bucket of their key, merged bucket by
bucket (plain parquet has no MERGE) and split into more buckets as they grow; the mart uses dynamic partition overwrite
by ``metric_key``. Nothing is read and overwritten in one plan: merged rows
are stored apart first.
"""
from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.recurring import counted, mark
from ..operators.state import NATURAL_KEY, dedup_events, latest_state, numbered
from ..session import checkpoint_dir, freed_shuffles, set_for


def table_root(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", *parts) if "://" not in base else "/".join([base.rstrip("/"), "tables", *parts])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Parquet tables of texts; shuffles and spills have the cluster's own codec.
COMPACT = {"compression": "zstd"}
# Folders that a task writes side by side; those of more folders sort their rows.
OPEN_FOLDERS = 32
# Compressed text can't be split, so a file holds this many records at most.
FILE_RECORDS = 500_000


def write_folders(df: DataFrame, by: list[str], path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write ``df`` with a folder per value of ``by``. For a handful of values a task
    keeps their files open side by side, instead of sorting its whole rows by them."""
    packed = {"compression": "gzip", "maxRecordsPerFile": FILE_RECORDS} if fmt == "json" else COMPACT
    with set_for(df.sparkSession, spark__sql__maxConcurrentOutputFileWriters=str(OPEN_FOLDERS)), freed_shuffles(df.sparkSession):
        df.write.mode(mode).options(**packed, **options).partitionBy(*by).format(fmt).save(path)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder on its file system, unless an earlier attempt did. A folder that
    got no rows was not written: it becomes an empty one."""
    fs, source = _hadoop(spark, path)
    _, target = _hadoop(spark, to)
    if fs.exists(source):
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot move {path} to {to}")
    else:
        fs.mkdirs(target)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def write_raw(env: DataFrame, path: str) -> DataFrame:
    """K1: append envelopes whose natural key is not stored yet (first delivery
    wins, also within the batch). Returns what was appended (lazily: callers
    that need it afterwards should read the table back). Envelopes whose key comes
    once are written where they are read; only the others are shuffled and sorted."""
    spark = env.sparkSession
    stored = spark.read.parquet(path).select(*NATURAL_KEY) if _exists(spark, path) else None

    def unseen(rows: DataFrame) -> DataFrame:
        return rows if stored is None else rows.join(stored, NATURAL_KEY, "left_anti")

    key = mark(*NATURAL_KEY)
    with counted(env.select(key.alias("mark"))) as recurring:
        fresh = dedup_events(recurring.again(env, key)).unionByName(numbered(recurring.once(env, key)))
        write_folders(unseen(fresh), ["source", "event_type"], path, mode="append")
    return unseen(dedup_events(env))


def write_quarantine(bad: DataFrame, reason: str | F.Column, path: str) -> None:
    """K4: keep rejected records with the reason; never drop them."""
    r = F.lit(reason) if isinstance(reason, str) else reason
    bad.withColumn("reason", r).withColumn("quarantined_at", F.current_timestamp()) \
        .write.mode("append").parquet(path)


STATE_BUCKETS = 8                  # buckets a state table starts with
BUCKET_BYTES = 128 * 1024 * 1024   # a bucket larger than this on average makes the table split


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _bucket(keys: list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _layouts(spark: SparkSession, path: str) -> list[int]:
    """Bucket counts of the whole layouts of a state table, ascending. The last
    one is current; the one before stays until the next split for its readers."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    counts = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(p) if s.getPath().getName().startswith("buckets=")]
    return sorted(n for n in counts if _exists(spark, f"{path}/buckets={n}/_SUCCESS"))


def _split(spark: SparkSession, keys: list[str], path: str, buckets: int, schema: T.StructType, bucket_bytes: int) -> None:
    """Write the table anew with more buckets once they hold more than
    ``bucket_bytes`` on average. The count at least quadruples, so a row is
    copied a bounded number of times however far the table grows. The new layout
    becomes current with its ``_SUCCESS`` marker, so a split that is cut off
    leaves the old one in force."""
    fs, folder = _hadoop(spark, f"{path}/buckets={buckets}")
    held = fs.getContentSummary(folder).getLength()
    wanted = buckets
    while held > wanted * bucket_bytes:
        wanted *= 2
    if wanted == buckets:
        return
    wanted *= 2
    rows = spark.read.schema(schema).parquet(f"{path}/buckets={buckets}").withColumn("bucket", _bucket(keys, wanted))
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static") \
        .options(**COMPACT).partitionBy("bucket").parquet(f"{path}/buckets={wanted}")
    fs, root = _hadoop(spark, path)
    for status in fs.listStatus(root):
        if status.getPath().getName() not in (f"buckets={buckets}", f"buckets={wanted}"):
            fs.delete(status.getPath(), True)


def write_state(updates: DataFrame, keys: list[str], path: str, sticky: str | None = None,
                buckets: int = STATE_BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """K2: merge extracted ``updates`` (with ``received_at`` and ``seq``) into
    the latest-state table at ``path``.

    The table is partitioned by a hash bucket of the key; only the buckets the
    updates touch are read, merged and replaced (dynamic partition overwrite),
    so a micro-batch costs the state it touches, not the whole table. It starts
    with ``buckets`` buckets and splits as it grows (see :func:`_split`), so a
    bucket stays near ``bucket_bytes`` at any table size. Stored
    rows re-enter as the earliest arrivals (``seq`` = -1): an update replaces a
    row only when strictly newer (D2) and a sticky flag is OR-ed only from
    updates that pass that guard (D3). The merged rows are stored beside the table before
    the overwrite, so the write never reads the files it replaces. The merge is
    idempotent, so replaying a micro-batch after a failure (even one that
    replaced only some buckets) gives the same table."""
    from ..operators.state import sticky_flag

    spark = updates.sparkSession
    found = _layouts(spark, path)
    buckets = found[-1] if found else buckets
    folder = f"{path}/buckets={buckets}"
    upd = updates.withColumn("bucket", _bucket(keys, buckets))
    # explicit schema: a table whose earlier batches had no rows is a bare folder
    stored = T.StructType([T.StructField("last_received_at" if f.name == "received_at" else f.name, f.dataType)
                           for f in upd.schema.fields if f.name != "seq"])
    merged = upd
    if found:
        # the touched bucket numbers: at most `buckets` small integers
        touched = [r[0] for r in upd.select("bucket").distinct().collect()]
        old = (spark.read.schema(stored).parquet(folder).filter(F.col("bucket").isin(touched))
               .withColumnRenamed("last_received_at", "received_at").withColumn("seq", F.lit(-1).cast("long")))
        merged = old.unionByName(upd.select(*old.columns))
    state = latest_state(merged, [*keys, "bucket"])
    if sticky:
        state = state.drop(sticky).join(sticky_flag(merged, [*keys, "bucket"], sticky), [*keys, "bucket"], "inner")
    # gathered by bucket; a large bucket is split over several tasks at run time
    out = state.drop("seq").withColumnRenamed("received_at", "last_received_at")
    # staged as a table that goes when the merge is done; checkpoint files would stay, unpacked
    staged = f"{path}/_merged"
    out.write.mode("overwrite").options(**COMPACT).parquet(staged)
    out = spark.read.schema(out.schema).parquet(staged).hint("rebalance", "bucket")
    # the first layout is written as a whole and marked by _SUCCESS, later merges replace its buckets
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if found else "static") \
        .options(**COMPACT).partitionBy("bucket").parquet(folder)
    drop_folder(spark, staged)
    _split(spark, keys, path, buckets, stored, bucket_bytes)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/buckets={_layouts(spark, path)[-1]}").drop("bucket")


def write_mart(mart: DataFrame, path: str, window: tuple[dt.date, dt.date] | None = None) -> None:
    """K3: upsert on (metric_key, scope_id, day). The table is partitioned by
    (metric_key, day) and written with dynamic partition overwrite: each
    recomputed (metric, day) is replaced as a whole. ``window`` names the first
    and last day that were recomputed; a (metric, day) inside it that no longer
    has any row is dropped, days outside are kept. Dashboards prune on both
    partition columns; rows are sorted by scope, so row groups prune as well."""
    spark = mart.sparkSession
    # a large metric-day is split over several tasks at run time
    rows = mart.hint("rebalance", "metric_key", "day").sortWithinPartitions("metric_key", "day", "scope_type", "scope_id")
    if window is not None:
        checkpoint_dir(spark)
        rows = mart = rows.checkpoint(eager=True)  # written and listed from one computation
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_key", "day").parquet(path)
    if window is None:
        return
    low, high = (F.lit(d).cast("date") for d in window)
    stored = spark.read.parquet(path).where(F.col("day").cast("date").between(low, high)).select("metric_key", "day").distinct()
    made = mart.select("metric_key", "day").distinct()
    stale = stored.join(made, ["metric_key", "day"], "left_anti").collect()  # metrics x days of the window at most
    jvm = spark.sparkContext._jvm
    for r in stale:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/metric_key={r['metric_key']}/day={r['day']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def export_report_csv(tiles: DataFrame, series: DataFrame, path: str, scope: str = "*", days: int = 30) -> None:
    """K5: cockpit report as three CSV folders with RFC-4180 quoting: ``about``
    (scope, window, time of the figures), ``summary`` (one line a tile, with its
    DORA tier) and ``series`` (one line a tile and day, in order). The first two
    hold a handful of rows."""
    opts = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false"}
    root = path.rstrip("/")
    as_of = F.date_format(F.max("computed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in
                     (("scope", F.lit(scope)), ("window_days", F.lit(str(days))), ("as_of", as_of))])
    tiles.groupBy().agg(head.alias("head")).select(F.inline("head")).write.mode("overwrite").options(**opts).csv(f"{root}/about")
    tier = C.dora_tier("metric_key", "value", "sample_size", days)
    tiles.select(F.col("metric_key").alias("metric"), "label", F.col("value").alias("aggregate"), "unit", "sample_size", tier.alias("tier")) \
        .coalesce(1).write.mode("overwrite").options(**opts).csv(f"{root}/summary")
    series.select(F.col("metric_key").alias("metric"), "day", "value").orderBy("metric", "day") \
        .write.mode("overwrite").options(**opts).csv(f"{root}/series")
