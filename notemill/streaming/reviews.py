"""Reviews as a log of events: the status of a (record, model, category) is the one that was set last.

What counts is an event's own time, then its number, not when it arrives: late and repeated events change nothing that a
later one has set. All works on a stream as on a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("record", "model", "category")


def statuses(events: DataFrame, keys: Sequence[str] = KEYS, at: str = "at", number: str = "number") -> DataFrame:
    """(keys, at, number, status, comment) as last set. On a stream use update mode: a key's row comes again when it changes."""
    last = events.groupBy(*keys).agg(F.max(F.struct(at, number, "status", "comment")).alias("_last"))
    return last.select(*keys, "_last.*")


def approvals(latest: DataFrame, where: Column, at: Column, status: str = "correto", keys: Sequence[str] = KEYS) -> DataFrame:
    """Events that set a status on all rows of latest for which `where` holds, to be appended to the log."""
    return latest.where(where).select(*keys, at.alias("at"), (F.col("number") + 1).alias("number"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("comment"))
