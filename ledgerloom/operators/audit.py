"""Audit log: search, retention, request budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import page


def search(events: DataFrame, equal: dict | None = None, since=None, until=None, resource: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; ``since`` and ``until`` are inclusive, ``resource`` is one of the row's ids."""
    for name, value in (equal or {}).items():
        events = events.where(F.col(name) == value)
    if since is not None:
        events = events.where(F.col("created_at") >= since)
    if until is not None:
        events = events.where(F.col("created_at") <= until)
    if resource is not None:
        events = events.where(F.array_contains("resource_ids", resource))
    return page(events, [F.desc("created_at"), F.desc("audit_event_id")], limit, offset)


def retained(events: DataFrame, cutoff) -> DataFrame:
    return events.where(F.col("created_at") >= cutoff)


def replay_budget(requests: DataFrame, most: int = 300, seconds: int = 60) -> DataFrame:
    """Which requests (request_id, subject, at in seconds) fit their subject's budget.

    A window opens with the first request after the last one closed, so it depends on all before. A
    subject's requests lie in one partition, in time order, and pass batch by batch; only the
    window's start and count are carried along.
    """

    def fold(batches):
        subject, start, used = object(), 0, 0
        for batch in batches:
            allowed, left = [], []
            for who, at in zip(batch["who"], batch["at"], strict=True):
                if who != subject or at >= start + seconds:
                    subject, start, used = who, at, 0
                allowed.append(used < most)
                used += allowed[-1]
                left.append(most - used)
            yield batch.assign(allowed=allowed, remaining=left)[["request_id", "subject", "allowed", "remaining"]]

    own = requests.select("request_id", "subject", "at", F.coalesce(F.col("subject").cast("string"), F.lit("")).alias("who"))
    return own.repartition("who").sortWithinPartitions("who", "at", "request_id").mapInPandas(fold, "request_id long, subject long, allowed boolean, remaining long")
