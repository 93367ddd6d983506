"""Runs that break off and go on, retries against the whole log, and reviews in any order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notemill.streaming import recovery, resumable, reviews


def wait(query):
    query.awaitTermination()


@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_breaks_off_goes_on(spark, tmp_path, after):
    """after: the part was written when the run ended, but not committed."""
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(60).repartition(6).write.parquet(source)
    calls, seen = [], []

    def stage(part):
        calls.append(part.count())
        if not after and len(calls) == 3:
            raise RuntimeError("stopped")
        return part.withColumn("twice", F.col("id") * 2)

    files = lambda: resumable.files(spark, source, "id long", 1)
    if after:
        real = resumable.F.current_timestamp

        def broken():
            seen.append(1)
            if len(seen) == 3:
                raise RuntimeError("stopped after the write")
            return real()

        resumable.F.current_timestamp = broken
    try:
        with pytest.raises(Exception, match="stopped"):
            wait(resumable.run(files(), target, stage))
    finally:
        if after:
            resumable.F.current_timestamp = real
    wait(resumable.run(files(), target, stage))
    wait(resumable.run(files(), target, stage))
    assert len(calls) == 7  # six parts, one of them twice
    assert sorted((r["id"], r["twice"]) for r in resumable.results(spark, target).collect()) == [(i, 2 * i) for i in range(60)]
    parts = {r["part"]: r["n"] for r in resumable.ledger(spark, target).collect()}
    assert set(parts) == set(range(6)) and sum(parts.values()) == 60
    spark.range(60, 65).coalesce(1).write.mode("append").parquet(source)
    wait(resumable.run(files(), target, stage))
    assert resumable.results(spark, target).count() == 65 and len(calls) == 8


def test_retries_in_any_order_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(3)
    log = []
    for k in range(60):
        for n in range(1, rng.randint(1, 5)):
            ok = rng.random() < 0.3
            log += [(f"r{k}", n, ok)] * rng.choice([1, 1, 2])
            if ok:
                break
    log += [(None, 1, True), ("late", None, True), ("r0", 9, True), ("odd", 1, None)]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "id string, attempt int, ok boolean")
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(5):
        df.where(F.pmod(F.hash("id", "attempt"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(source)
    wait(resumable.run(recovery.outcomes(resumable.files(spark, source, df.schema, 1), "id", "attempt", "ok", 3), target, mode="update"))
    last = resumable.latest(resumable.results(spark, target), ["id"], ["seen"])
    got = {r["id"]: (r["status"], r["failed"]) for r in last.collect()}
    assert got == {r["id"]: (r["status"], r["failed"]) for r in recovery.at_once(df, "id", "attempt", F.col("ok"), 3).collect()}
    want = {}
    for k in {i for i, n, _ in log if i is not None and n is not None}:
        mine = {n: ok for i, n, ok in log if i == k and n is not None and n <= 3}
        good = min((n for n, ok in mine.items() if ok), default=None)
        bad = [n for n, ok in mine.items() if not ok and (good is None or n < good)]
        want[k] = ("done" if good else "dead" if len(bad) >= 3 else "due", len(bad))
    assert got == want and {s for s, _ in want.values()} == {"done", "dead", "due"}
    assert {(r["id"], r["attempt"]) for r in recovery.due(last, "id").collect()} == {(k, n + 1) for k, (s, n) in want.items() if s == "due"}
    assert {r["id"] for r in recovery.dead_letters(last, "id").collect()} == {k for k, (s, _) in want.items() if s == "dead"}
    with pytest.raises(ValueError):
        recovery.outcomes(df, "id", "attempt", "ok", 0)


def test_last_review_wins_whenever_it_arrives(spark, tmp_path):
    events = spark.createDataFrame([(1, "m", "c", 5, 1, "b", None), (1, "m", "c", 9, 1, "d", "x"), (1, "m", "c", 5, 2, "c", None), (1, "m", "c", 9, 1, "d", "x"), (2, "m", "c", 1, 1, None, None)], "record long, model string, category string, at long, number int, status string, comment string")
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in ("at = 9", "number = 2", "at < 9 and number = 1"):  # the last comes first
        events.where(part).coalesce(1).write.mode("append").parquet(source)
        wait(resumable.run(reviews.statuses(resumable.files(spark, source, events.schema)), target, mode="update"))
    rows = lambda df: sorted(tuple(r) for r in df.select("record", "at", "number", "status", "comment").collect())
    now = resumable.latest(resumable.results(spark, target), reviews.KEYS, ["at", "number"])
    assert rows(now) == rows(reviews.statuses(events)) == [(1, 9, 1, "d", "x"), (2, 1, 1, None, None)]
    new = reviews.approvals(now, F.col("status").isNull(), F.lit(20).cast("long"))
    assert rows(reviews.statuses(events.unionByName(new))) == [(1, 9, 1, "d", "x"), (2, 20, 2, "correto", None)]
