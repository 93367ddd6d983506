"""Retries with state: what became of each record is kept by key, from the log of its attempts.

A record is done with its first good attempt, dead after `most` bad ones, else due for the next. The state is a set of
attempt numbers, so attempts that come late, twice or in another order lead to the same end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _status(failed: int, good: int, most: int) -> tuple[str, int]:
    """(done, dead or due, how often it failed before) from a bit for each bad attempt and one for each good one."""
    if good:
        return "done", (failed & ((good & -good) - 1)).bit_count()
    n = failed.bit_count()
    return ("dead" if n >= most else "due"), n


def outcomes(attempts: DataFrame, key: str, attempt: str, ok: str, most: int = 3) -> DataFrame:
    """(key, status, failed, seen) whenever they change: for a stream, in update mode; later rows have more attempts `seen`.

    attempts: key, the attempt's number from 1 on, and whether it was good. Attempts beyond most, or with a null key or
    number, are not counted. One key's state is a few numbers, whatever the number of its attempts.
    """
    if not 1 <= most <= 60:
        raise ValueError("between 1 and 60 attempts")
    kind = attempts.schema[key].dataType.simpleString()
    rows = attempts.where(F.col(key).isNotNull() & F.col(attempt).between(1, most)).select(key, F.col(attempt).cast("int").alias("attempt"), F.coalesce(ok, F.lit(False)).alias("ok"))

    def follow(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, good = before = tuple(state.get) if state.exists else (0, 0)
        for part in parts:
            for number, fine in zip(part["attempt"], part["ok"], strict=True):
                bit = 1 << (int(number) - 1)
                failed, good = (failed, good | bit) if fine else (failed | bit, good)
        if (failed, good) != before:
            state.update((failed, good))
            status, n = _status(failed, good, most)
            yield pd.DataFrame({key: [names[0]], "status": [status], "failed": [n], "seen": [failed.bit_count() + good.bit_count()]})

    return rows.groupBy(key).applyInPandasWithState(follow, f"`{key}` {kind}, status string, failed int, seen int", "failed long, good long", "update", GroupStateTimeout.NoTimeout)


def due(latest: DataFrame, key: str) -> DataFrame:
    """(key, attempt): what to try next."""
    return latest.where("status = 'due'").select(key, (F.col("failed") + 1).alias("attempt"))


def dead_letters(latest: DataFrame, key: str) -> DataFrame:
    return latest.where("status = 'dead'").select(key, "failed")


def at_once(attempts: DataFrame, key: str, attempt: str, ok: Column, most: int = 3) -> DataFrame:
    """The same from a whole log: (key, status, failed)."""
    counted = attempts.where(F.col(key).isNotNull() & F.col(attempt).between(1, most))
    fine = F.coalesce(ok, F.lit(False))
    sums = counted.groupBy(key).agg(F.min(F.when(fine, F.col(attempt))).alias("good"), F.collect_set(F.when(~fine, F.col(attempt))).alias("bad"))  # at most 60 numbers
    n = F.size(F.filter("bad", lambda x: F.col("good").isNull() | (x < F.col("good"))))
    return sums.select(key, F.when(F.col("good").isNotNull(), "done").when(F.size("bad") >= most, "dead").otherwise("due").alias("status"), n.alias("failed"))
