"""Scalar column functions.

Every helper maps to built-in Spark SQL expressions (``(Column...) -> Column``),
so all of them stay inside whole-stage code generation; none is a Python UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- fixed values that must equal the reference's ----------------------------
# Jira-style issue key: first match, case-sensitive, no word boundary.
ISSUE_KEY_PATTERN = r"[A-Z][A-Z0-9]{1,9}-[0-9]+"
# ISO-8601 instant with an explicit zone (a bare date is rejected).
ISO_INSTANT_GUARD = r"T.*(Z|[+-][0-9]{2}:?[0-9]{2})$"
# Names of known automation accounts (case-insensitive prefix match).
KNOWN_BOTS = ["dependabot", "renovate", "github-actions", "copilot"]
# ------------------------------------------------------------------------------


def json_text(payload, path: str) -> Column:
    """Text at a JSON path (``$.a.b``); null when missing or null."""
    return F.get_json_object(_c(payload), path)


def first_non_blank(*cols) -> Column:
    """First value whose trimmed text is non-empty (the value is returned
    untrimmed)."""
    return F.coalesce(*[F.when(F.length(F.trim(_c(c))) > 0, _c(c)) for c in cols])


def iso_instant(text) -> Column:
    """ISO-8601 instant or null."""
    t = _c(text)
    return F.when(t.rlike(ISO_INSTANT_GUARD), F.try_to_timestamp(t))


def jira_instant(text) -> Column:
    """C4: Jira timestamp (``2024-01-02T03:04:05.000+0000``), ISO fallback."""
    t = _c(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")), iso_instant(t))


def long_or_null(text) -> Column:
    """C5."""
    return F.trim(_c(text)).try_cast("bigint")


def repo_from_git_url(url) -> Column:
    """Trim, drop a trailing ``.git``, keep what follows the first
    ``github.com/``; URLs of other hosts are kept as they are."""
    stripped = F.regexp_replace(F.trim(_c(url)), r"\.git$", "")
    return F.when(F.instr(stripped, "github.com/") > 0,
                  F.regexp_extract(stripped, r"github\.com/(.*)$", 1)).otherwise(stripped)


def build_conclusion(result) -> Column:
    """Jenkins result -> run conclusion."""
    r = _c(result)
    return (F.when(r.isNull(), F.lit(None).cast("string"))
            .when(r == "SUCCESS", "success")
            .when(r.isin("FAILURE", "UNSTABLE"), "failure")
            .when(r == "ABORTED", "cancelled")
            .otherwise(F.lower(r)))


def issue_key(title) -> Column:
    """First issue key in the text, null when none."""
    return F.regexp_substr(_c(title), F.lit(ISSUE_KEY_PATTERN))


def micros(start, end) -> Column:
    """Exact duration in microseconds."""
    return F.unix_micros(_c(end)) - F.unix_micros(_c(start))


def hours_between(start, end) -> Column:
    """Fractional hours (epoch seconds / 3600)."""
    return micros(start, end) / F.lit(3.6e9)


def whole_hours(start, end) -> Column:
    """Whole hours, truncated."""
    return (micros(start, end) / F.lit(3_600_000_000)).cast("long")


def whole_minutes(start, end) -> Column:
    """Whole minutes, truncated."""
    return (micros(start, end) / F.lit(60_000_000)).cast("long")


def utc_day(ts) -> Column:
    """C11."""
    return F.to_date(_c(ts))


def month_start(ts_or_day) -> Column:
    return F.trunc(F.to_date(_c(ts_or_day)), "month")


def month_key(ts_or_day) -> Column:
    return F.date_format(month_start(ts_or_day), "yyyy-MM")


def month_label(ts_or_day) -> Column:
    return F.date_format(month_start(ts_or_day), "MMM")


def round_half_up(x, scale: int) -> Column:
    """HALF_UP rounding (exact on DECIMAL input)."""
    return F.round(_c(x), scale)


def ratio_half_up(num_units, den, scale: int) -> Column:
    """``num_units / den`` rounded HALF_UP to ``scale`` places, exactly,
    for integer ``num_units`` (e.g. cents) and positive integer ``den``; the
    result is scaled back by the caller. 0 when ``den`` is 0."""
    n, d = _c(num_units).cast("long"), _c(den).cast("long")
    q = F.call_function("div", F.lit(2) * n * F.lit(10 ** scale) + d, F.lit(2) * d)
    return F.when(d == 0, F.lit(0)).otherwise(q).cast("long")


def guarded_divide(num, den) -> Column:
    """0 when the denominator is 0."""
    return F.when(_c(den) == 0, F.lit(0)).otherwise(_c(num) / _c(den))


def cap_one(x) -> Column:
    """C14."""
    return F.least(F.lit(1), _c(x))


def slug(name) -> Column:
    """Trim, lower, non-alphanumeric runs -> '-', strip dashes at the ends."""
    s = F.regexp_replace(F.lower(F.trim(_c(name))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def normalize_email(email) -> Column:
    """Trim + lower; blank -> null."""
    e = F.lower(F.trim(_c(email)))
    return F.when(F.length(e) > 0, e)


def is_bot(name, email) -> Column:
    """C17: name ends with ``[bot]``, starts with a known bot name, or the email
    is a noreply address and the name mentions "bot"."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    e = F.lower(F.coalesce(_c(email), F.lit("")))
    starts = F.lit(False)
    for b in KNOWN_BOTS:
        starts = starts | n.startswith(b)
    return n.endswith("[bot]") | starts | (e.contains("noreply") & n.contains("bot"))


def dora_tier(metric_key, value, sample_size, window_days: int) -> Column:
    """DORA performance band of a cockpit tile (null when no value)."""
    k, v = _c(metric_key), _c(value)
    per_day = _c(sample_size) / F.lit(float(window_days))

    def bands(x, le, lims):
        cmp = (lambda a, b: a <= b) if le else (lambda a, b: a < b)
        return (F.when(cmp(x, F.lit(lims[0])), "Elite").when(cmp(x, F.lit(lims[1])), "High")
                .when(cmp(x, F.lit(lims[2])), "Medium").otherwise("Low"))

    freq = (F.when(per_day >= 1, "Elite").when(per_day >= 1.0 / 7, "High")
            .when(per_day >= 1.0 / 30, "Medium").otherwise("Low"))
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(k == "deployment_frequency", freq)
            .when(k == "lead_time_p50_hours", bands(v, False, (24, 168, 720)))
            .when(k == "change_failure_rate", bands(v, True, (0.15, 0.30, 0.45)))
            .when(k == "mttr_p50_hours", bands(v, False, (1, 24, 168))))


def tier_score(tier) -> Column:
    t = _c(tier)
    return (F.when(t == "Elite", 100).when(t == "High", 75).when(t == "Medium", 50)
            .when(t == "Low", 25).otherwise(0)).cast("long")


def tool_label(source) -> Column:
    """Anything but the metered tool is the seat tool."""
    return F.when(_c(source) == "claude_code", "Claude Code").otherwise("GitHub Copilot")


def sha256_hex(body) -> Column:
    """C20."""
    return F.sha2(_c(body), 256)
