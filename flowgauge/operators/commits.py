"""Commits: one entity per (repo, sha) from pushes and snapshots, and the trailers of its message.

A commit reaches us in any number of pushes (each lists what it carried) and as a
snapshot of the commit itself. :func:`merge_commits` makes one row of them: each field
is the snapshot's where it has one, else that of the earliest arrival that has one.

Trailers are the ``Token: value`` lines of a message's last paragraph, the subject
aside; a paragraph with any other line is prose and holds none. A line that starts
with a blank continues the one above it. A commit is AI-assisted when a trailer
credits a tool, or when a line below the subject says that it was generated by one; a
tool named in prose doesn't count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .extract import _ENV, _parsed

AI_TOOLS = ("claude", "copilot", "cursor")
CREDIT_TRAILERS = ("co-authored-by", "assisted-by", "generated-by")

PUSH = ("repository struct<full_name:string>, "
        "commits array<struct<id:string, message:string, timestamp:string, author:struct<username:string>>>")
SNAPSHOT = "sha string, url string, author struct<login:string>, commit struct<message:string, author:struct<date:string>>"


def trailers(message: str | Column) -> Column:
    """The trailers of a message as array<struct<token (lower case), value>>; empty for null."""
    text = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\s+$", "")
    paragraphs = F.split(text, r"\n(?:[ \t]*\n)+")
    last = F.when(F.size(paragraphs) > 1, F.element_at(paragraphs, -1))
    lines = F.split(F.regexp_replace(last, r"\n[ \t]+", " "), "\n")
    line = r"^([A-Za-z0-9][A-Za-z0-9-]*)[ \t]*:[ \t]*(\S.*)$"
    found = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, line, 1)).alias("token"),
                                                  F.regexp_extract(x, line, 2).alias("value")))
    none = F.array().cast("array<struct<token:string,value:string>>")
    return F.when(F.forall(lines, lambda x: x.rlike(line)), found).otherwise(none)


def ai_tools(message: str | Column) -> Column:
    """The AI tools that a commit message credits, sorted; empty if none."""
    text = F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit(""))
    named = "|".join(AI_TOOLS)
    credit = F.filter(trailers(text), lambda t: t["token"].isin(*CREDIT_TRAILERS))
    credited = F.transform(credit, lambda t: F.regexp_extract(F.lower(t["value"]), rf"^(?:github )?({named})\b", 1))
    generated = F.regexp_extract_all(F.lower(text), F.lit(rf"\n[^a-z0-9\n]*generated (?:with|by) \W?(?:github )?({named})\b"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.concat(credited, generated), lambda x: x != "")))


def extract_commits(events: DataFrame) -> DataFrame:
    """Commits of push and ``commit.snapshot`` envelopes: repo, sha, author, authored_at, tools, rank
    (0 for a snapshot) and the envelope's arrival. Messages are read here and not carried on.
    Commits without a sha or a repository can't be keyed and are left out."""
    pushed = _parsed(events.filter(F.col("event_type") == "push"), j=F.from_json(F.col("payload"), PUSH))
    pushed = pushed.select(F.col("j.repository.full_name").alias("repo"), *_ENV, F.explode("j.commits").alias("c")).select(
        "repo", F.col("c.id").alias("sha"), F.col("c.author.username").alias("author"),
        C.iso_instant(F.col("c.timestamp")).alias("authored_at"), ai_tools(F.col("c.message")).alias("tools"), F.lit(1).alias("rank"), *_ENV)
    snap = _parsed(events.filter(F.col("event_type") == "commit.snapshot"), j=F.from_json(F.col("payload"), SNAPSHOT))
    snap = snap.select(
        F.nullif(F.regexp_extract("j.url", r"/repos/(.+?)/commits/", 1), F.lit("")).alias("repo"), F.col("j.sha").alias("sha"),
        F.col("j.author.login").alias("author"), C.iso_instant(F.col("j.commit.author.date")).alias("authored_at"),
        F.when(F.col("j.commit.message").isNotNull(), ai_tools(F.col("j.commit.message"))).alias("tools"), F.lit(0).alias("rank"), *_ENV)
    return pushed.unionByName(snap).filter(F.col("sha").isNotNull() & F.col("repo").isNotNull())


def merge_commits(rows: DataFrame) -> DataFrame:
    """One row per (repo, sha); keyed aggregation with map-side combining."""
    place = F.struct("rank", "seq")
    best = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in ("author", "authored_at", "tools")]
    return rows.groupBy("repo", "sha").agg(*best, F.min("received_at").alias("first_received_at"))
