"""Files by row: names, index parts, refusals and a second run over what a broken one left."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notemill.plans import catalogue
from notemill.sources import pages, readers


def test_pages_index_and_instructions(spark, tmp_path):
    rows = spark.createDataFrame([(f"p {i}.html", f"<{i:03d}>", f"text é {i}" if i else None) for i in range(25)], "f string, t string, c string")
    pages.write(rows, f"{tmp_path}/out", "f", "t", "c", "All & more", "Read <this>.", pages_per_part=10)
    got = {p.name: p.read_text() for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert {n: t for n, t in got.items() if n.startswith("p ")} == {f"p {i}.html": f"text é {i}" if i else "" for i in range(25)}
    parts = sorted(n for n in got if n.startswith("index-"))
    assert len(parts) == 3 and "_SUCCESS" in got and all(f'href="{p}"' in got["index.html"] for p in parts)
    assert "25 pages" in got["index.html"] and "Read &lt;this&gt;." in got["index.html"] and "All &amp; more" in got["index.html"]
    listed = "".join(got[p] for p in parts)
    assert [listed.index(f"&lt;{i:03d}&gt;") for i in range(25)] == sorted(listed.index(f"&lt;{i:03d}&gt;") for i in range(25))
    assert readers.text_files(spark, f"{tmp_path}/out/p *.html").count() == 24  # not the empty one


@pytest.mark.parametrize("names", [["a", "a"], [None], ["x/y"], ["index.html"], ["_a"], [""]])
def test_names_that_cannot_be(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "c") for n in names], "f string, c string")
    with pytest.raises(Exception, match="name"):
        pages.write(rows, f"{tmp_path}/out", "f", "f", "c")
    assert not (tmp_path / "out/_SUCCESS").exists()


def test_no_rows_and_a_folder_that_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c")], "f string, c string")
    pages.write(rows.limit(0), f"file://{tmp_path}/out", "f", "f", "c")
    assert "0 pages" in (tmp_path / "out/index.html").read_text()
    with pytest.raises(ValueError, match="already"):
        pages.write(rows.withColumn("n", F.lit(1)), f"{tmp_path}/out", "f", "f", "c")


def test_many_files_are_one_listing(spark, tmp_path):
    rows = spark.createDataFrame([(f"p[{i}].{'txt' if i % 3 else 'csv'}", str(i)) for i in range(60)], "f string, c string")
    pages.write(rows, f"{tmp_path}/out", "f", "f", "c")
    read = readers.text_files(spark, f"{tmp_path}/out/*.txt")
    assert sorted(r["text"] for r in read.collect()) == sorted(str(i) for i in range(60) if i % 3)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan  # each of the 40 files was a path, which Spark looks up in jobs of their own
    assert [r["name"] for r in readers.text_files(spark, f"{tmp_path}/o*/index.html").collect()] == ["index.html"]


def test_files_in_folders_are_listed_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"n {i:03d}.txt", f"\ufeff<é> {i}\r\n" if i else "") for i in range(57)], "f string, c string")
    pages.write(rows, f"{tmp_path}/out", "f", "f", "c", pages_per_part=30, per_folder=8)
    folders = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) > 6 and max(len(list(p.iterdir())) for p in folders) == 8
    read = pages.read(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, read.collect())) == [(f"n {i:03d}.txt", f"\ufeff<é> {i}\r\n") for i in range(1, 57)]
    assert read.rdd.getNumPartitions() == len(folders)
    linked = "".join(r["text"] for r in pages.read(spark, f"{tmp_path}/out", index=True).collect())
    assert linked.count("<li>") == 57 and all(f'href="{p.parent.name}/{p.name}"' in linked for f in folders for p in f.iterdir())


def test_read_nothing_and_files_without_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c")], "f string, c string")
    pages.write(rows.limit(0), f"file://{tmp_path}/none", "f", "f", "c", per_folder=8)
    assert pages.read(spark, f"file://{tmp_path}/none").count() == pages.read(spark, f"{tmp_path}/none", index=True).count() == 0
    pages.write(rows, f"{tmp_path}/flat", "f", "f", "c")
    with pytest.raises(Exception, match="no folder"):
        pages.read(spark, f"{tmp_path}/flat").count()


@pytest.mark.parametrize("name", ["note_files", "page_files"])
def test_queries_keep_no_file_list_in_the_driver(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex" not in plan and "BatchScan pages" in plan  # one entry a file, all held by the driver
