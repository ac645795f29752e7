"""Stages, roles and other constants that the operators share."""

from __future__ import annotations

# The pipeline stages in their declared order.
STAGES = (
    "APPLIED",
    "SHORTLISTED",
    "RESUME_REJECTED",
    "REVIEW",
    "INTERVIEW_SCHEDULED",
    "INTERVIEW_RESCHEDULED",
    "INTERVIEWED",
    "INTERVIEW_FAILED",
    "INTERVIEW_REVIEW",
    "NO_SHOW",
    "SELECTED",
    "REJECTED",
)
# Stages that the candidate's record decides, whatever its interviews say.
CANDIDATE_OWNED = ("REVIEW", "SHORTLISTED", "RESUME_REJECTED", "INTERVIEW_RESCHEDULED", "NO_SHOW")
# Replacements of stages from older records; any other unknown stage becomes REVIEW.
LEGACY_STAGES = {
    "INTERVIEW_REVIEW": "INTERVIEWED",
    "INTERVIEW_FAILED": "REJECTED",
    "OFFER_MADE": "SELECTED",
    "OFFER_ACCEPTED": "SELECTED",
    "OFFER_REJECTED": "REJECTED",
    "WITHDRAWN": "REJECTED",
    "ON_HOLD": "REVIEW",
}
# Spellings of interview statuses after spaces and hyphens have become underscores.
STATUS_ALIASES = {"inprogress": "ongoing", "in_progress": "ongoing", "noshow": "no_show"}
# Rank of a status where two interviews have the same times.
STATUS_RANKS = {"rescheduled": 0, "scheduled": 1, "ongoing": 2, "completed": 3, "no_show": 3, "selected": 4, "rejected": 4}

PASS_SCORE = 6
DEFAULT_THRESHOLD = 60
GRACE_MINUTES = 30
LOCAL_OFFSET = "+05:30"
