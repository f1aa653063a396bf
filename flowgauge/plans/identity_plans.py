"""Identity and team plans over the raw envelopes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as I
from ..sources.tables import read_table


def observations(env: DataFrame) -> DataFrame:
    """I1 plus team members: everything the identity consumer resolves."""
    snaps = I.parse_team_snapshots(env.filter((F.col("source") == "github") & (F.col("event_type") == "team.snapshot")))
    return I.observe_identities(env).unionByName(I.team_member_observations(snaps))


def resolved(env: DataFrame) -> tuple[DataFrame, DataFrame]:
    return I.resolve_identities(observations(env))


def imported_teams(env: DataFrame):
    snaps = I.parse_team_snapshots(env.filter((F.col("source") == "github") & (F.col("event_type") == "team.snapshot")))
    _, aliases = resolved(env)
    return I.import_teams(snaps, aliases)


def team_requests(spark: SparkSession, base: str) -> DataFrame:
    """Admin team-creation requests derived from ``nation`` and ``region``:
    one per nation, plus two differently written names per region that share a
    slug (the later request wins)."""
    n = read_table(spark, base, "nation", "n_nationkey", "n_name")
    r = read_table(spark, base, "region", "r_regionkey", "r_name")
    t0 = 1704067200
    nations = n.select(F.concat(F.lower("n_name"), F.lit(" squad")).alias("name"),
                       F.timestamp_seconds(F.lit(t0) + F.col("n_nationkey") * 3600).alias("requested_at"),
                       (F.col("n_nationkey") * 10).alias("seq"))
    first = r.select(F.concat(F.lit("Region "), F.col("r_name")).alias("name"),
                     F.timestamp_seconds(F.lit(t0) + 100000 + F.col("r_regionkey") * 60).alias("requested_at"),
                     (F.lit(1000) + F.col("r_regionkey") * 10).alias("seq"))
    second = r.select(F.concat(F.lit("  region: "), F.lower("r_name"), F.lit("!")).alias("name"),
                      F.timestamp_seconds(F.lit(t0) + 200000 + F.col("r_regionkey") * 60).alias("requested_at"),
                      (F.lit(2000) + F.col("r_regionkey") * 10).alias("seq"))
    return nations.unionByName(first).unionByName(second)
