"""Stored tables: what an update rewrites, what it leaves, and what a broken one does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notemill.sources import stored


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    stored.create(spark.range(200).select("id", (F.col("id") * 2).alias("v"), F.lit("a").alias("s")), path, "id", 16)
    before = files(tmp_path / "t")
    change = spark.createDataFrame([(3, "b", 1), (3, "c", 2), (7, "a", 1), (999, "z", 1), (None, "n", 1)], "id long, s string, at int")
    got = stored.upsert(change, path, order="at")
    assert got["version"] == 2 and got["written"] == 1 and 1 < got["read"] <= 3  # of the two keys that are there, one changes
    assert before <= files(tmp_path / "t") and len(files(tmp_path / "t") - before) == 1
    want = [(i, 2 * i, "c" if i == 3 else "a") for i in range(200)]
    assert rows(stored.read(spark, path)) == want and rows(stored.read(spark, path, 1))[3] == (3, 6, "a")
    held = files(tmp_path / "t")
    assert stored.upsert(change, path, order="at")["written"] == 0 and stored.versions(spark, path) == [1, 2] and files(tmp_path / "t") == held
    assert stored.upsert(change, path, order="at", insert=True)["version"] == 3
    assert rows(stored.read(spark, path).where("id > 199")) == [(999, None, "z")]


def test_a_run_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    stored.create(spark.range(20).select("id", F.lit(1).alias("v")), path, "id", 4)
    change = spark.range(20).select("id", F.lit(2).alias("v"))
    real = stored._publish
    monkeypatch.setattr(stored, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        stored.upsert(change, path)
    assert {r["v"] for r in stored.read(spark, path).collect()} == {1}
    monkeypatch.setattr(stored, "_publish", real)
    about = stored.manifest(spark, path)
    stored.upsert(change, path)
    assert {r["v"] for r in stored.read(spark, path).collect()} == {2} and stored.read(spark, path).count() == 20
    with pytest.raises(RuntimeError, match="another run"):
        real(spark, path, about | {"version": 2})
    with pytest.raises(ValueError):
        stored.create(change, path, "id")
    with pytest.raises(ValueError):
        stored.read(spark, path, 9)


def test_empty_tables_and_changes(spark, tmp_path):
    path = f"{tmp_path}/t"
    none = spark.createDataFrame([], "id long, v string")
    stored.create(none, path, "id", 4)
    assert stored.read(spark, path).count() == 0 and stored.upsert(none, path)["written"] == 0
    assert stored.upsert(spark.createDataFrame([(1, None)], "id long, v string"), path, insert=True)["written"] == 1
    assert rows(stored.read(spark, path)) == [(1, None)]
    assert stored.upsert(spark.createDataFrame([(1, None)], "id long, v string"), path)["written"] == 0
