"""What keeps the cleanup queries in proportion to their input: records dealt out before their lists become rows, phrases without Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import checks, entities, lexicon
from notemill.plans import base, catalogue

ONE_SHUFFLE = ("dedup_intra", "mutual_exclusive", "cross_dedup", "canonical_map", "cleanup_steps", "recategorise", "change_count", "regrouped_lists", "qc_repeated_keys", "clinical_layers")


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_rows_of_entities_are_not_shuffled(spark, sf, name, monkeypatch):
    monkeypatch.setattr(base, "DEALT", 16)
    made = catalogue.QUERIES[name](spark, sf)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"\bExchange (\w+\([^)]*)", plan) == re.findall(r"\bExchange (hashpartitioning\(doc_id#\d+L, 13)", plan) and "EvalPython" not in plan
    assert made.rdd.getNumPartitions() == 13  # 200 documents


def test_phrases_without_python_are_those_of_the_automaton(spark):
    tables = (lexicons.TRANSLATIONS, {"th": "TH", "tion": "CION", "en": "in"}, {"kış": "x", "são j": "y_", "$a": "+b", "mu.": "no!", "İs": "i"})
    assert all(lexicon.built_in(t) for t in tables)
    assert not any(lexicon.built_in(t) for t in ({}, {"a": ""}, {"a": "b", "b": "c"}, {"$": "x"}, {"νοσος": "x"}, {f"p{i}": f"q{i}" for i in range(65)}))
    rng = random.Random(6)
    for table in tables:
        bits = [*table, *[k.upper() for k in table], *[k[1:] for k in table], "ſ", "İ", "ı", "K", "é", "é", "_", "-", "٣", "²", "x", "$", "\\"]
        rows = [("".join(rng.choice(bits) + rng.choice(["", " ", " ", ","]) for _ in range(rng.randint(0, 8))),) for _ in range(800)] + [(None,), ("",)]
        phrases = list(table)
        machine = lexicon.Automaton({"": [lexicon.Term(k, True, True) for k in phrases]})
        got = spark.createDataFrame(rows, "x string").select("x", lexicon.substitute(F.col("x"), table).alias("y"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert [(r["x"], r["y"]) for r in got.collect()] == [(x, None if x is None else lexicon.substituted(x, machine, phrases, table)) for (x,) in rows]


def _rows(spark):
    rng = random.Random(7)
    words = ["rash", "Rash", "febre", "fever", "Derrame pleural", "derrame  pleural", "FC 80", "SpO2 97", "paciente", "dor", " dor ", "HBV", "é", "E"]
    rows = [(r if r else None, rng.choice(lexicons.CATEGORIES), p, rng.choice(words)) for r in range(60) for p in range(rng.randint(0, 12))]
    return spark.createDataFrame(rows, "record_id long, category string, pos int, entity string")


def test_one_pass_over_removals_equals_both_sides_compared(spark):
    rows = _rows(spark).where("record_id is not null")
    got = entities.removals(entities.after_exclusive(rows))
    assert sorted(got.collect()) == sorted(entities.changes(rows, entities.exclusive(rows)).collect())


def test_layer_counts_are_those_of_all_marks(spark):
    rows, want = _rows(spark), {}
    marks = entities.layer_marks(rows)
    assert sorted(map(str, marks.collect())) == sorted(map(str, entities.layer_marks(rows.repartition(3, "record_id"), dealt=True).collect()))
    for m in sorted(marks.collect(), key=lambda m: (m["layer"], m["record_id"] or -1, m["category"], m["pos"])):
        want.setdefault(m["layer"], []).append(m["entity"])
    for dealt in (False, True):
        got = {r["layer"]: (r["n"], r["examples"]) for r in entities.layer_counts(rows.repartition(3, "record_id"), 3, dealt).collect()}
        assert got == {k: (len(v), v[:3]) for k, v in want.items()} and len(got) == 5


def test_repeated_keys_list_each_category_once(spark):
    rows = spark.createDataFrame([(1, "b", 0, "X"), (1, "a", 0, "x"), (1, "b", 1, "x "), (1, "a", 1, "y"), (None, "c", 0, "z"), (None, "c", 1, "Z")], "record_id long, category string, pos int, entity string")
    assert sorted((r["entity"], r["detail"]) for r in checks.repeated_keys(rows).collect()) == [("x", "a,b"), ("z", "c")]
    plan = checks.repeated_keys(rows)._jdf.queryExecution().executedPlan().toString()
    assert "key, category" in re.sub(r"#\d+", "", plan)  # counted by category before any list is made


def test_keys_of_ascii_and_other_texts(spark):
    rows = spark.createDataFrame([(x,) for x in ("Abc", " É \t x\n", "a  b", "ÀÉÎ", "éX", "", None, " A", "日本 X")], "x string")
    long = F.regexp_replace(F.lower(F.translate(text.strip(F.col("x")), text._FROM, text._TO)), r"\s+", " ")
    assert all(r[0] for r in rows.select(text.key(F.col("x")).eqNullSafe(long)).collect())


def test_patterns_of_ascii_texts_find_the_same(spark):
    rng = random.Random(8)
    patterns = [*lexicons.COMPLEXITY.values(), *lexicons.SYMPTOMS.values(), *base.FLAGS.values(), "a|b c", r"x*a\b", "[^a]b", "(a|)b", r"(?s)k.s", "é|s"]
    bits = ["negative", "Ruled out", "q12h", "sputum for\nculture", "sputum culture", "a", "b", "x", "K", "ſ", "é", "É", "_", "-", "\n", "no growth", "RASH", "1234", "k", "s", "!!", "art regimen"]
    rows = [("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 10))),) for _ in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "x string")
    x = F.col("x")
    same = [text.has(x, p).eqNullSafe(x.rlike(f"(?iU){p}")) & (text.count(x, p) == F.coalesce(F.regexp_count(x, F.lit(f"(?iU){p}")), F.lit(0))) for p in patterns]
    assert all(all(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(same)]).collect())
    assert text._eager(r"\b(ab|[cd])\b").startswith("(?i)(?=[ACDacd])") and text._eager("x*a") == "(?i)x*a"


def test_hits_are_never_objects_of_their_own(spark, monkeypatch):
    """All hits of a batch of texts as dictionaries took gigabytes; flat arrays of some texts at a time do not."""
    import tracemalloc

    import pyarrow as pa

    machine = lexicon.Automaton({"w": [lexicon.Term("a", True, True)], "none": []})
    texts = pa.array(["a " * 20_000, None, "", "b"])
    tracemalloc.start()
    got = lexicon._listed(machine, pa.concat_arrays([texts] * 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.is_null().to_pylist() == [False, True, False, False] * 10 and got[0].as_py()[1] == {"name": "w", "start": 2, "end": 3}
    assert [len(h) for h in got[:4].to_pylist() if h is not None] == [20_000, 0, 0] and peak < 20_000_000  # some 90 MB as dictionaries
    monkeypatch.setattr(lexicon, "AT_ONCE", 2)
    found = lexicon.hits(spark.createDataFrame([(i, "a" * (i % 2)) for i in range(7)], "i long, x string").coalesce(1), "x", {"w": ["a"]})
    assert [(r["i"], len(r["hits"])) for r in found.collect()] == [(i, i % 2) for i in range(7)]
