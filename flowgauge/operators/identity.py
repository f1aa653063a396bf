"""Identity and team resolution.

Resolution in the source system is a serial loop over arriving observations:
an alias seen before keeps its contributor; otherwise an email match attaches
it (confidence 0.90); otherwise it founds a new contributor (1.00). Because an
alias never changes after its first sighting and every alias attached through
an email carries that same normalised email, the loop has a closed form that is
a pair of aggregations (no iteration, no graph search):

1. keep each alias's *first* observation (min arrival ``seq``);
2. the contributor key of an alias is its normalised email when that first
   observation had one, else the alias itself;
3. within a key, the alias with the earliest first observation founds the
   contributor (name, email and bot flag come from it); the others attach.

Steps 1 and 2 are keyed aggregations with map-side combining; a window over the
distinct aliases of a key, sorted by arrival, names the founder.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .extract import TEAM
from .state import latest_state

EMAIL_MATCH_CONFIDENCE = 0.90
NEW_CONTRIBUTOR_CONFIDENCE = 1.00

_GH_USER = "struct<id:string,login:string,email:string>"
_GIT_SIG = "struct<name:string,email:string>"
_JIRA_USER = "struct<accountId:string,displayName:string,emailAddress:string>"
_PR_USER = f"user {_GH_USER}"
_COMMIT = f"sha string, author {_GH_USER}, commit struct<author:{_GIT_SIG}>"
_PUSH = f"commits array<struct<author:{_GIT_SIG}>>"
_JIRA = (f"issue struct<fields:struct<assignee:{_JIRA_USER}, reporter:{_JIRA_USER}>>, "
         f"fields struct<assignee:{_JIRA_USER}, reporter:{_JIRA_USER}>, user {_JIRA_USER}")


def _obs(source: str, uid: Column, name: Column, email: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), uid.alias("source_user_id"), name.alias("name"), email.alias("email"))


def _git_signature(author: Column) -> Column:
    """A git author without a platform id: the email is the only handle."""
    return F.when(author["email"].isNotNull(),
                  _obs("github", F.concat(F.lit("email:"), F.lower(author["email"])), author["name"], author["email"]))


def observe_identities(events: DataFrame) -> DataFrame:
    """Every identity an envelope reveals, with its arrival ``seq``.

    PR-family events: the (wrapped) ``user`` when it has an id; commits: the
    platform author (name from the git signature, else the login; email from
    the signature), or the bare git signature; pushes: each commit's git
    signature; Jira: assignee, reporter and webhook actor with an account id.

    Each kind reads its own envelopes (folders of the raw table) and parses them once."""
    et, src = F.col("event_type"), F.col("source")
    github = src == "github"

    def revealed(kind: Column, schema: str, found) -> DataFrame:
        # one parse a row: the one-row inline keeps it from being copied into every field access
        row = F.struct(F.from_json("payload", schema).alias("j"), F.col("seq"))
        opened = events.filter(kind).select(F.inline(F.array(row)))
        listed = opened.select(F.inline(F.array(F.struct(found(F.col("j")).alias("_found"), F.col("seq")))))
        return listed.select(F.posexplode(F.filter("_found", lambda o: o.isNotNull())).alias("pos", "o"), "seq")

    def pull_request(j: Column) -> Column:
        user = F.when(j["pull_request"].isNotNull(), j["pull_request"]["user"]).otherwise(j["user"])
        return F.array(F.when(user["id"].isNotNull(), _obs("github", user["id"], user["login"], user["email"])))

    def commit(j: Column) -> Column:
        author, git = j["author"], j["commit"]["author"]
        named = _obs("github", author["id"], F.coalesce(git["name"], author["login"]), git["email"])
        return F.array(F.when(author["id"].isNotNull(), named).otherwise(_git_signature(git)))

    def push(j: Column) -> Column:
        return F.transform(F.coalesce(j["commits"], F.array()), lambda c: _git_signature(c["author"]))

    def jira(j: Column) -> Column:
        fields = F.when(j["issue"].isNotNull(), j["issue"]["fields"]).otherwise(j["fields"])
        return F.array(*[F.when(u["accountId"].isNotNull(), _obs("jira", u["accountId"], u["displayName"], u["emailAddress"]))
                         for u in (fields["assignee"], fields["reporter"], j["user"])])

    parts = [revealed(github & et.startswith("pull_request"), f"pull_request struct<{_PR_USER.replace(' ', ':', 1)}>, {_PR_USER}", pull_request),
             revealed(github & et.startswith("commit"), _COMMIT, commit),
             revealed(github & (et == "push"), _PUSH, push),
             revealed(src == "jira", _JIRA, jira)]
    return reduce(DataFrame.unionByName, parts).select("o.*", "seq", "pos")


def team_member_observations(teams: DataFrame) -> DataFrame:
    """Team import resolves every member as an observation with no email."""
    return teams.select(F.posexplode("members").alias("pos", "m"), "seq").select(
        F.lit("github").alias("source"), F.col("m.id").alias("source_user_id"), F.col("m.login").alias("name"),
        F.lit(None).cast("string").alias("email"), "seq", "pos")


def resolve_identities(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I2 (+I5 flag): ``(contributors, aliases)`` from observations in
    ``(seq, pos)`` order, ``pos`` being the place inside an envelope (0 if
    absent); see the module doc for why this equals the serial loop."""
    place = F.struct("seq", F.col("pos") if "pos" in obs.columns else F.lit(0).alias("pos"))
    first = obs.groupBy("source", "source_user_id").agg(
        F.min_by(F.struct("name", "email"), place).alias("_f"), F.min(place).alias("first_seq"))
    first = first.select("source", "source_user_id", F.col("_f.name").alias("name"),
                         C.normalize_email(F.col("_f.email")).alias("email"), "first_seq")
    alias_key = F.concat_ws(":", "source", "source_user_id")
    keyed = first.withColumn("_key", F.when(F.col("email").isNotNull(), F.concat(F.lit("email:"), F.col("email")))
                             .otherwise(F.concat(F.lit("alias:"), alias_key)))
    founders = keyed.groupBy("_key").agg(
        F.min_by(F.struct("source", "source_user_id", "name", "email"),
                 F.struct("first_seq", "source", "source_user_id")).alias("_fd"))
    founders = founders.select(
        "_key",
        F.concat_ws(":", F.col("_fd.source"), F.col("_fd.source_user_id")).alias("contributor_id"),
        F.coalesce(F.col("_fd.name"), F.col("_fd.source_user_id")).alias("canonical_name"),
        F.col("_fd.email").alias("canonical_email"),
        C.is_bot(F.col("_fd.name"), F.col("_fd.email")).alias("is_bot"))
    contributors = founders.select("contributor_id", "canonical_name", "canonical_email", "is_bot")
    # each alias sees its founder in a window over the key: a join of the two would open all payloads twice
    within = Window.partitionBy("_key").orderBy("first_seq", "source", "source_user_id")
    founded = keyed.withColumn("_fd", F.first(F.struct("source", "source_user_id")).over(within)).withColumns({
        "contributor_id": F.concat_ws(":", F.col("_fd.source"), F.col("_fd.source_user_id")),
        "_fs": F.col("_fd.source"), "_fu": F.col("_fd.source_user_id")})
    aliases = founded.select(
        "contributor_id", "source", "source_user_id", "name", "email",
        F.when((F.col("source") == F.col("_fs")) & (F.col("source_user_id") == F.col("_fu")),
               F.lit(NEW_CONTRIBUTOR_CONFIDENCE)).otherwise(F.lit(EMAIL_MATCH_CONFIDENCE))
        .cast("decimal(3,2)").alias("match_confidence"))
    return contributors, aliases


def parse_team_snapshots(events: DataFrame) -> DataFrame:
    """E11 over ``team.snapshot`` envelopes: id and name required, repos need
    a full name, members an id, missing arrays are empty."""
    row = F.struct(F.from_json("payload", TEAM).alias("t"), F.col("received_at"), F.col("seq"))
    t = events.select(F.inline(F.array(row)))  # one parse a row, as above
    t = t.filter(F.col("t.id").isNotNull() & F.col("t.name").isNotNull())
    return t.select(
        F.col("t.id").alias("team_source_id"), F.col("t.name").alias("name"),
        F.transform(F.filter(F.coalesce(F.col("t.repositories"), F.array()), lambda r: r["full_name"].isNotNull()),
                    lambda r: r["full_name"]).alias("repos"),
        F.filter(F.coalesce(F.col("t.members"), F.array()), lambda m: m["id"].isNotNull()).alias("members"),
        "received_at", "seq")


def import_teams(snapshots: DataFrame, aliases: DataFrame, source: str = "github"):
    """Teams upserted on (source, source_id) with the latest name; repo
    and member pairs are only ever added. Returns (team, team_repo, team_member)."""
    team = latest_state(snapshots.select(F.lit(source).alias("source"), F.col("team_source_id").alias("source_id"),
                                         "name", "received_at", "seq"), ["source", "source_id"])
    team = team.select(F.concat_ws(":", "source", "source_id").alias("id"), "name", "source", "source_id")
    tid = F.concat_ws(":", F.lit(source), F.col("team_source_id"))
    team_repo = snapshots.select(tid.alias("team_id"), F.explode("repos").alias("repo")).distinct()
    members = snapshots.select(tid.alias("team_id"), F.explode("members").alias("m")).select(
        "team_id", F.lit(source).alias("source"), F.col("m.id").alias("source_user_id")).distinct()
    team_member = members.join(aliases.select("source", "source_user_id", "contributor_id"),
                               ["source", "source_user_id"], "inner").select("team_id", "contributor_id").distinct()
    return team, team_repo, team_member


def manual_teams(requests: DataFrame) -> DataFrame:
    """I4: admin-created teams: source ``manual``, id = slug(name), the latest
    request per slug wins."""
    r = requests.select(F.lit("manual").alias("source"), C.slug("name").alias("source_id"), "name",
                        F.col("requested_at").alias("received_at"), F.col("seq"))
    return latest_state(r.filter(F.length("source_id") > 0), ["source", "source_id"]).select(
        F.concat_ws(":", "source", "source_id").alias("id"), "name", "source", "source_id")


def bot_filter(df: DataFrame, contributors: DataFrame, id_col: str = "contributor_id") -> DataFrame:
    """Drop rows of contributors flagged as bots."""
    bots = contributors.filter("is_bot").select(F.col("contributor_id").alias("_bot"))
    return df.join(bots, F.col(id_col) == F.col("_bot"), "left_anti")


__all__ = ["observe_identities", "team_member_observations", "resolve_identities", "parse_team_snapshots",
           "import_teams", "manual_teams", "bot_filter"]
