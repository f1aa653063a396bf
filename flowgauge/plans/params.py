"""Query parameters.

Operators never call ``now()``: the evaluation instant and every tunable are
passed in explicitly, so a recompute is reproducible and testable.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

# --- fixed values that must equal the reference's defaults -------------------
# Deploy rule: a successful workflow run whose name matches (case-insensitive,
# unanchored) this pattern is a production deploy.
DEPLOY_PATTERN = "deploy|release|publish|ship|rollout"
# Remediation rule for change failure rate and time to restore.
HOTFIX_PATTERN = "hotfix|rollback|revert"
# A deploy counts as failed when a remediation follows within this many hours.
REMEDIATION_HOURS = 48
METRIC_LOGIC_VERSION = "v1"
# Lead times are cut at this many days; an open PR without activity for longer is stale.
LEAD_CAP_DAYS = 90
STALE_PR_DAYS = 7
# Ticket statuses (lower case) that count as work in progress.
IN_PROGRESS_STATUSES = ["in progress", "in development", "in review"]
# Metric keys as stored in the daily mart.
MK_DEPLOY_FREQ = "deployment_frequency"
MK_LEAD_TIME = "lead_time_p50_hours"
MK_CFR = "change_failure_rate"
MK_MTTR = "mttr_p50_hours"
MK_VELOCITY = "pr_velocity"
MK_CYCLE = "pr_cycle_time_p50_hours"
MK_PR_SIZE = "pr_size"
# Pull requests above this many changed lines are oversized.
OVERSIZED_LINES = 400
# Investment categories in display order.
CATEGORIES = ["Planned", "Unplanned", "Rework", "Unclassifiable"]
# AI cost defaults: Copilot seat price per month (USD), licensed seats, blended
# hourly rate (USD), minimum PRs per bucket for the AI impact comparison.
COPILOT_MONTHLY_SEAT_USD = 19
LICENSED_SEATS = 30
HOURLY_RATE_USD = 85
MIN_PRS_PER_BUCKET = 3
# Below this many AI-assisted PRs the comparison is flagged as a small sample.
SMALL_SAMPLE_PRS = 10
# Widest windows a request may ask for, in days: in general, and of the investment reports.
MAX_DAYS = 90
MAX_DAYS_INVESTMENT = 180
# Age bands of the open-PR list: lower ends in hours.
AGING_HOURS = 48
LATE_HOURS = 72
TOOL_LABEL_CLAUDE = "Claude Code"
TOOL_LABEL_COPILOT = "GitHub Copilot"
# Connector health: no activity for this long means STALE.
STALE_AFTER_HOURS = 24
# Repo sync: an in-progress trigger older than this is reported as failed.
STUCK_AFTER_MINUTES = 35
# Time-to-first-value target (minutes).
TARGET_MINUTES = 30
# ----------------------------------------------------------------------------
# Default limits of pull request flags: hours open, changed lines.
FLAG_LIMITS = {"age": 168, "size": OVERSIZED_LINES}
# A goal behind its line by at most this share of the way is at risk, beyond it off track.
GOAL_SLACK = 0.15
GOAL_METRICS = (MK_DEPLOY_FREQ, MK_LEAD_TIME, MK_CFR, MK_MTTR, MK_VELOCITY, MK_CYCLE)
LOWER_IS_BETTER = (MK_LEAD_TIME, MK_CFR, MK_MTTR, MK_CYCLE)
# Unplanned work: weeks of the rolling baseline, and how far above it counts.
CREEP_WEEKS = 4
CREEP_MARGIN = 0.02
# Upper ends of the age bands of open PRs, in days.
AGE_BANDS_DAYS = (1, 3, 7, 14)


@dataclass(frozen=True)
class Params:
    as_of: dt.datetime = dt.datetime(2024, 1, 31, 0, 0, 0)
    days: int = 30
    deploy_pattern: str = DEPLOY_PATTERN
    hotfix_pattern: str = HOTFIX_PATTERN
    within_hours: int = REMEDIATION_HOURS
    scope: str = "*"
    seats: int = LICENSED_SEATS
    hourly_rate: int = HOURLY_RATE_USD
    # Slot width (seconds) of the skew-safe as-of join.
    asof_slot_seconds: int = 3600
    extra: dict = field(default_factory=dict)

    def asked(self, most: int = MAX_DAYS) -> Params:
        """F8: these parameters with the window clamped to 1..``most`` days."""
        return replace(self, days=max(1, min(most, int(self.days))))

    @property
    def as_of_sql(self) -> str:
        return self.as_of.strftime("%Y-%m-%d %H:%M:%S")

    @property
    def as_of_date_sql(self) -> str:
        return self.as_of.strftime("%Y-%m-%d")


DEFAULT = Params()
