"""JSON arrays cut at any byte against a whole-file parser."""

from __future__ import annotations

import json
import random

import pytest

from notemill.sources import arrays, readers, writers


def value(rng, deep=0):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "𝔘", "\n", ",", '\\"', "}{", "\\\\"]) for _ in range(rng.randint(0, 12)))
    if deep > 2 or rng.random() < 0.4:
        return rng.choice([text(), 1, None, True, 2.5, text()])
    if rng.random() < 0.5:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {text(): value(rng, deep + 1) for _ in range(rng.randint(0, 3))}


@pytest.mark.parametrize("split", [61, 400, 1 << 27])
def test_elements_at_any_split(spark, tmp_path, split):
    rng = random.Random(split)
    want = []
    for k in range(24):
        items = [value(rng, rng.randint(0, 1)) for _ in range(rng.choice([0, 1, 5, 60]))]
        want += [(k, json.dumps(x, sort_keys=True)) for x in items if isinstance(x, dict)]
        after = {} if k % 2 else {"notes": items, "more": [{"not": "one"}, "]"], "n": {"x": [{}]}}
        made = json.dumps(after or items, ensure_ascii=k % 3 == 0, indent=k % 4 or None)
        (tmp_path / f"{k:02d}.json").write_text(rng.choice(["", "\n ", "﻿"]) + made + rng.choice(["", "\n"]), encoding="utf-8")
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = arrays.elements(spark, str(tmp_path))
        tasks = got.rdd.getNumPartitions()
        rows = [(int(r["file"][-7:-5]), json.dumps(json.loads(r["value"]), sort_keys=True)) for r in got.collect()]
    finally:
        for key, v in old.items():
            spark.conf.set(key, v)
    assert sorted(rows) == sorted(want)
    assert split > 100 or tasks > 100


def test_cut_from_every_row(spark):
    rng = random.Random(9)
    for _ in range(300):
        items = [value(rng, 0) for _ in range(rng.randint(0, 8))]
        rows = json.dumps(items).split("}")
        at = rng.randint(0, len(rows))
        quoted, depth = False, 0
        for row in rows[:at]:
            quoted, depth, _ = arrays.step(row, quoted, depth, arrays.NEVER)
        head, tail = list(arrays.cut(rows[:at], False, 0, 1)), list(arrays.cut(rows[at:], quoted, depth, 1))
        open_ = [t for t, _, ends in head if not ends]
        found = [t for t, own, ends in head if own and ends] + ["".join(open_ + [t for t, own, _ in tail if not own])] + [t for t, own, ends in tail if own and ends]
        assert [json.loads(t) for t in found if t.startswith("{")] == [x for x in items if isinstance(x, dict)]


def test_written_arrays_are_read_again(spark, tmp_path):
    rows = [(str(i), 'a "quoted" } text \\ é' * 5) for i in range(200)]
    df = spark.createDataFrame(rows, "paciente_id string, codigo_cid string").repartition(3)
    for name, under in (("bare", None), ("wrapped", "notes")):
        writers.json_arrays(df, f"{tmp_path}/{name}", under)
        assert sorted((r["paciente_id"], r["codigo_cid"]) for r in readers.array_records(spark, f"{tmp_path}/{name}").collect()) == sorted(rows)
        for part in (tmp_path / name).glob("part-*"):
            made = json.loads(part.read_text())
            assert isinstance(made if under is None else made[under], list)
    writers.json_arrays(df.limit(0), f"{tmp_path}/none")
    assert readers.array_records(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        writers.json_arrays(df.withColumnRenamed("codigo_cid", "text"), f"{tmp_path}/raw")
    (tmp_path / "other.json").write_text('{"else": []}')
    with pytest.raises(ValueError):
        arrays.elements(spark, f"{tmp_path}/other.json")
