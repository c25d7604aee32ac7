"""Context-aware risk of an event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class Context:
    """The row conditions that raise a risk; a missing column counts as not met."""

    def __init__(self, columns: list[str]):
        def above(name: str, limit: float) -> Column:
            if name not in columns:
                return F.lit(False)
            return F.coalesce(F.col(name) > limit, F.lit(False))

        self.night = above("IsNightTime", 0)
        self.busy = above("EventsPerMinute", 10)
        self.many_failures = above("FailedLoginRatio", 0.5)
        self.external_ip = above("IsExternalIP", 0)
        self.suspicious_text = above("LogHasSuspicious", 0)
        self.powershell = above("LogHasPowerShell", 0)
        self.failed_login = above("IsFailedLogin", 0)
        self.unusual = above("EventIDRarity", 0.8)


def context_score(base: Column, context: Context, default: int = 5) -> Column:
    """Catalogue risk raised by the context, at most 10."""
    score = F.coalesce(base, F.lit(default))
    for condition, amount in [
        (context.night, 1),
        (context.busy, 1),
        (context.many_failures, 2),
        (context.external_ip, 1),
        (context.suspicious_text, 2),
    ]:
        score = score + F.when(condition, amount).otherwise(0)
    return F.least(F.lit(10), score).cast("int")


def cue_hits(cues: Column, context: Context) -> Column:
    """The cues met by the context, once for every trigger word that applies."""
    triggers = [
        ("night", context.night),
        ("fail", context.failed_login),
        ("powershell", context.powershell),
        ("unusual", context.unusual),
    ]

    def hits(cue: Column) -> Column:
        found = [F.when(F.lower(cue).contains(word) & met, cue) for word, met in triggers]
        return F.array_compact(F.array(*found))

    empty = F.array().cast("array<string>")
    return F.flatten(F.transform(F.coalesce(cues, empty), hits))


def is_suspicious(score: Column, cues: Column, context: Context) -> Column:
    """High risk, or at least one cue met."""
    return (score >= 7) | (F.size(cue_hits(cues, context)) > 0)


def reasons(score: Column, cues: Column, context: Context) -> Column:
    """All cues of a high-risk event, else the cues met."""
    empty = F.array().cast("array<string>")
    return F.when(score >= 7, F.coalesce(cues, empty)).otherwise(cue_hits(cues, context))
