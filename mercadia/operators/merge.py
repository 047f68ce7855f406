"""Keyed upserts, set differences, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.operators.matching import latest


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], time: str, add: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """current after changes: the newest row of a key counts; columns `add` are summed, `keep` come from the oldest.

    Both sides are united and aggregated once by key; no side is looked up row by row. A null in a newer row
    leaves the older value.
    """
    both = current.unionByName(changes, allowMissingColumns=True)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c)
    oldest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c)
    aggregates = [F.max(time).alias(time)] + [F.sum(c).alias(c) if c in add else oldest(c) if c in keep else newest(c) for c in both.columns if c not in keys and c != time]
    return both.groupBy(*keys).agg(*aggregates).select(*both.columns)


def add_if_absent(values: Column, more: Column) -> Column:
    return F.array_union(F.coalesce(values, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))


def unsent(contacts: DataFrame, sent: DataFrame) -> DataFrame:
    """Contacts whose number (phone) no message went to."""
    return contacts.join(sent.select("phone").distinct(), "phone", "left_anti")


def orphans(files: DataFrame, *references: DataFrame) -> DataFrame:
    """Files (file_id) that none of the references (file_id) names."""
    for r in references:
        files = files.join(r.select("file_id").where("file_id IS NOT NULL").distinct(), "file_id", "left_anti")
    return files


def age_seconds(c: Column, now: str) -> Column:
    """0 for a missing time."""
    return F.coalesce(F.lit(now).cast("timestamp").cast("double") - c.cast("timestamp").cast("double"), F.lit(0.0))


#: Seconds after which jobs, sessions, tables and files go.
FINISHED_TTL, STALE_TTL, SESSION_TTL, TABLE_TTL, ORPHAN_TTL = 12 * 3600, 7200, 12 * 3600, 8 * 86400, 12 * 3600


def job_expired(status: Column, created: Column, running: Column, now: str) -> Column:
    """Finished jobs after FINISHED_TTL, waiting ones that don't run after STALE_TTL."""
    age = age_seconds(created, now)
    finished = F.lower(status).isin("done", "error", "canceled") & (age >= FINISHED_TTL)
    stale = F.lower(status).isin("queued", "processing") & ~running & (age >= STALE_TTL)
    return F.coalesce(finished | stale, F.lit(False))


def expired(created: Column, seconds: int, now: str) -> Column:
    return age_seconds(created, now) >= seconds


__all__ = ["upsert", "add_if_absent", "unsent", "orphans", "age_seconds", "job_expired", "expired", "latest"]
