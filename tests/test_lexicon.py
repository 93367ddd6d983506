"""Terms, hits, flags and counts of the automaton against the patterns themselves."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import lexicon
from notemill.operators.lexicon import Term

ALL = {**lexicons.SYMPTOMS, **lexicons.LABELS, **{f"m_{k}": p for k, p in lexicons.MENTIONS.items()}, **{f"c_{k}": p for k, p in lexicons.COMPLEXITY.items()}}


def test_patterns_are_spelt_out_in_their_order():
    assert lexicon.terms(r"\b(hep[- ]?[ab]|x)\b") == [Term(t, True, True) for t in ("hep-a", "hep-b", "hep a", "hep b", "hepa", "hepb", "x")]
    assert lexicon.terms(r"fever|b\.? c") == [Term("fever"), Term("b. c"), Term("b c")]
    assert lexicon.terms(r"\b(a|\bart\b)") == [Term("a", True), Term("art", True, True)]
    assert all(lexicon.terms(p) is None for p in (r"a.*b", r"q\d+h", r"[^a]b", r"a\bb", r"", r"\b", r"(?:[abcdefgh]{1,8})"))
    lists, other = lexicon.split(ALL)
    assert len(lists) >= 27 and set(other) <= {"c_medications", "c_tb_tests"}


def test_hits_equal_the_patterns_matches():
    lists, _ = lexicon.split(ALL)
    machine = lexicon.Automaton(lists)
    rng = random.Random(1)
    bits = sorted({t.text for v in lists.values() for t in v})
    for _ in range(1500):
        body = "".join(rng.choice([rng.choice(bits), rng.choice(bits).upper(), rng.choice(bits)[1:], " ", " ", "-", "_", "x", "é", "İ"]) for _ in range(rng.randint(0, 25)))
        got = [(machine.names[i], a, b) for i, a, b in machine.hits(body)]
        want = [(k, m.start(), m.end()) for k in lists for m in re.finditer(ALL[k], lexicon.lowered(body))]
        assert got == want, body


def test_flags_and_counts_equal_those_of_patterns(spark):
    lists, _ = lexicon.split(ALL)
    rng = random.Random(2)
    bits = sorted({t.text for v in lists.values() for t in v})
    rows = [(i, " ".join(rng.choice([rng.choice(bits), rng.choice(bits).title(), "and", "of"]) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(None, None), (1, "")]
    df = lexicon.hits(spark.createDataFrame(rows, "hits_id long, x string"), "x", lists)
    assert df.columns == ["hits_id", "x", "hits"]
    flagged, counted = lexicon.flags(F.col("hits"), lists), lexicon.counts(F.col("hits"), lists)
    plain = text.flags(F.col("x"), {k: ALL[k] for k in lists})
    same = [flagged[k].eqNullSafe(plain[k]) for k in plain] + [counted[k] == text.count(F.col("x"), ALL[k]) for k in lists]
    checked = df.select(*[c.alias(f"c{i}") for i, c in enumerate(same)])
    assert checked.count() == len(rows) and all(all(r) for r in checked.collect())


def test_ten_thousand_terms_in_one_pass(spark):
    rng = random.Random(3)
    words = [f"term{i}" for i in range(10_000)]
    rows = [(i, " ".join(rng.choices([*words, "termx", "aterm1", "term1_"], k=200))) for i in range(50)]
    found = lexicon.hits(spark.createDataFrame(rows, "i long, x string"), "x", {"known": words})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    held = set(words)
    for r in found.collect():
        at, want = 0, []
        for w in r["x"].split(" "):
            if w in held:
                want.append((at, at + len(w)))
            at += len(w) + 1
        assert [(h["start"], h["end"]) for h in r["hits"]] == want


def test_empty_lexicons_and_too_large_ones(spark, monkeypatch):
    df = spark.createDataFrame([("a b",), (None,)], "x string")
    assert [r["hits"] for r in lexicon.hits(df, "x", {"none": [""]}).collect()] == [[], None]
    assert lexicon.hits(df.limit(0), "x", {"a": ["a"]}).count() == 0
    monkeypatch.setattr(lexicon, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        lexicon.hits(df, "x", {"a": ["a", "b"]})


def test_all_phrases_at_once_equal_one_after_the_other(spark):
    table = lexicons.TRANSLATIONS
    assert lexicon.feeding(table) == []
    assert lexicon.feeding({"a b": "x c", "c": "y", "c d e": "b", "e": ""}) == [("c d e", "a b"), ("a b", "c")]
    rng = random.Random(5)
    bits = [*table, *[k.upper() for k in table], *[k.split()[-1] for k in table], "non-", "-", ", ", "é", "x"]
    rows = [("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 9))),) for _ in range(1500)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "x string").select("x", lexicon.substitute(F.col("x"), table).alias("one"), text.phrases(F.col("x"), table).alias("chain"))
    assert all(r["one"] == r["chain"] for r in df.collect())
    overlaps = {"a b c": "1", "b c d e": "2", "e": "3", "$": "4"}
    got = spark.createDataFrame([("a b c d e a b c",)], "x string").select(lexicon.substitute(F.col("x"), overlaps), text.phrases(F.col("x"), overlaps)).first()
    assert got[0] == got[1] == "a 2 1"
