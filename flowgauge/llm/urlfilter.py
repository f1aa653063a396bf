"""URL filter by a character language-model ratio (operator 8, native).

Explicit rules judge first: a rule fits its host and all subdomains if the url's
path starts with the rule's path; the longest rule wins. Urls that rules allow
and block train two variable-order Markov models over the characters of the whole
url, scheme, query and fragment included (contexts of up to three characters,
Witten-Bell smoothing: each order falls back on the next shorter one as far as its
context is new). Other urls are judged by the difference of the two
log-likelihoods divided by the length, against a threshold between the means of
both classes, weighted by their deviations. Every ``FOLDS``-th page_id is held out
of the models; the threshold comes from those rows (from all ruled rows where
they lack a class).

Characters are folded to ``SYMBOLS`` signs (letters, one sign for digits, three
marks, one sign for the rest, begin and end), so the models have at most
``SYMBOLS ** 4`` entries whatever the input; that is the bound of what is
broadcast. A null url, or one without ``://``, has an empty host and path; the
method judges a url without scheme by its text, a null or empty one by the end
sign alone, so all of these get one verdict. A url of any length is read whole.
An empty table gives no rows. Without urls of both classes every other url is allowed. Rows are judged one by
one; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import stored, with_row_id

ORDER = 3
SYMBOLS = 33
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the query (fixed values).
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (name, verdict) of the longest fitting rule, or null."""
    best = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first: it is set last
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def folded(url: Column) -> Column:
    """The whole url in the model's signs, with begin and end signs."""
    text = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[^a-z0./-]", "~")
    return F.concat(F.lit("^" * ORDER), text, F.lit("$"))


def grams(rows: DataFrame) -> DataFrame:
    """One row per sign of ``signs``: the sign after its ORDER predecessors.

    The look-ahead matches at every sign, so a url of any length takes one pass.
    """
    cut = F.regexp_extract_all("signs", F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))
    return rows.withColumn("gram", F.explode(cut)).drop("signs")


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log p(allowed) - log p(blocked) of every gram in (gram, allowed, blocked).

    Both models are worked out on the table of grams alone, from the shortest
    context to the longest.
    """
    table = counts
    for label in ("allowed", "blocked"):
        total = counts.agg(F.coalesce(F.sum(label), F.lit(0)).cast("double")).first()[0]
        p = None
        for order in range(ORDER + 1):
            tail = F.substring("gram", ORDER + 1 - order, order + 1)
            seen = counts.groupBy(tail.alias("tail")).agg(F.sum(label).cast("double").alias("n"))
            if order == 0:
                level = seen.select("tail", ((F.col("n") + 1) / (total + SYMBOLS)).alias("p"))
            else:
                context = F.substring("tail", 1, order)
                contexts = seen.groupBy(context.alias("context")).agg(F.sum("n").alias("all"), F.sum((F.col("n") > 0).cast("double")).alias("kinds"))
                shorter = p.withColumnRenamed("tail", "shorter").withColumnRenamed("p", "below")
                level = seen.withColumn("context", context).withColumn("shorter", F.substring("tail", 2, order)).join(contexts, "context").join(shorter, "shorter")
                mixed = (F.col("n") + F.col("kinds") * F.col("below")) / (F.col("all") + F.col("kinds"))
                level = level.select("tail", F.when(F.col("all") > 0, mixed).otherwise(F.col("below")).alias("p"))
            p = level
        table = table.join(p.select(F.col("tail").alias("gram"), F.log("p").alias("log_" + label)), "gram")
    return table.select("gram", (F.col("log_allowed") - F.col("log_blocked")).alias("ratio"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio), one row per row of ``pages``."""
    source = with_row_id(pages.select("page_id", F.col("url").cast("string").alias("url")))
    held = F.coalesce(F.pmod(F.col("page_id"), F.lit(FOLDS)) == 0, F.lit(False))
    parts = source.select("uid", "page_id", held.alias("held"), folded(F.col("url")).alias("signs"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    rows = parts.select("uid", "page_id", "held", "host", "path", F.col("fit.name").alias("rule"), F.col("fit.verdict").alias("given"), "signs")
    rows = stored(rows, "urls")  # one numbering for both uses
    every = grams(rows.select("uid", "held", "given", "signs"))
    label = lambda v: F.sum((~F.col("held") & (F.coalesce(F.col("given"), F.lit("")) == v)).cast("long"))
    counts = stored(every.groupBy("gram").agg(label("allow").alias("allowed"), label("block").alias("blocked")), "grams")
    table = stored(ratios(counts), "ratios")
    scores = every.join(F.broadcast(table), "gram").groupBy("uid").agg(F.avg("ratio").alias("ratio"))  # SYMBOLS ** 4 rows at most
    scored = stored(rows.drop("signs").join(scores, "uid"), "scored")
    known = scored.where("given is not null").groupBy("given", "held").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("deviation"))
    sides = known.collect()  # four rows at most
    stats = {r["given"]: (r["mean"], r["deviation"]) for r in sides if r["held"]}
    if len(stats) < 2:
        every_row = scored.where("given is not null").groupBy("given").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("deviation"))
        stats = {r["given"]: (r["mean"], r["deviation"]) for r in every_row.collect()}
    if {"allow", "block"} <= set(stats):
        (a, da), (b, db) = stats["allow"], stats["block"]
        threshold = (a * db + b * da) / (da + db) if da + db > 0 else (a + b) / 2
        decided = F.when(F.col("ratio") >= threshold, "allow").otherwise("block")
    else:
        decided = F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", decided).alias("verdict"), "ratio")
