"""Similarity joins and the matching against all pairs, compared one by one."""

from __future__ import annotations

import difflib
import random
import re

import pytest

from notemill.operators import scoring, similarity


def alike(a, b, ratio):
    short, long = sorted((a, b), key=len)
    return bool(short and re.search(rf"\b{re.escape(short)}\b", long)), difflib.SequenceMatcher(None, a, b).ratio() >= ratio


def strings(rng, n, letters):
    out = set()
    while len(out) < n:
        s = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        out.add(s)
        if rng.random() < 0.6:  # a few letters away, or inside
            k = rng.randrange(len(s))
            out.add(rng.choice([s[:k] + rng.choice(letters) + s[k:], s[:k] + s[k + 1 :], s[:k] + rng.choice(letters) + s[k + 1 :], s + " " + s[:3], "x " + s]))
    return sorted(out)


@pytest.mark.parametrize("ratio", [0.6, 0.85, 0.95])
def test_pairs_equal_all_pairs(spark, ratio):
    rng = random.Random(int(ratio * 100))
    items = [*strings(rng, 150, "ab"), *strings(rng, 150, "abcdefgé -_/²𝔘"), "--", "_", "a--b", "", "é", "aé b", "é b"]
    rows = [(rng.choice([1, 1, 2, None]), x) for x in items]
    left, right = ([r for r in rows if rng.random() < 0.7] for _ in range(2))
    frame = lambda x: spark.createDataFrame([*x, x[0], (1, None)], "c long, e string")
    got = {(r["c"], r["l"], r["r"]): (r["stands"], r["ratio"] > 0) for r in similarity.similar_pairs(frame(left), frame(right), "c", "e", ratio).collect()}
    want = {(c, a, b): alike(a, b, ratio) for c, a in left for k, b in right if c == k and a != b and a and b and any(alike(a, b, ratio))}
    assert got == want and len(want) > 50


def test_word_borders_as_in_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        a, b = ("".join(rng.choices("ab _-é²", k=rng.randint(1, n))) for n in (3, 9))
        assert similarity.stands_in(a, b) == bool(re.search(rf"\b{re.escape(a)}\b", b)), (a, b)


def greedy(pairs):
    used, out = (set(), set()), []
    for c, a, b in pairs:
        if (c, a) not in used[0] and (c, b) not in used[1]:
            used[0].add((c, a))
            used[1].add((c, b))
            out.append((c, a, b))
    return set(out)


@pytest.mark.parametrize("tail", [0, 10, 10_000])
def test_rounds_take_what_one_pass_takes(spark, tail):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = {(rng.choice([1, 2, None]), f"l{rng.randrange(25)}", f"r{rng.randrange(25)}") for _ in range(500)} | {(3, "hub", f"r{i}") for i in range(60)}
    pairs = spark.createDataFrame(sorted(rows, key=str), "c long, l string, r string")
    order = [(r["c"], r["l"], r["r"]) for r in sorted(pairs.withColumn("h", F.xxhash64("c", "l", "r")).collect(), key=lambda r: (r["h"], r["l"], r["r"]))]
    got = [tuple(r) for r in similarity.matching(pairs, "c", tail).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(order)


def test_scores_of_large_and_odd_groups(spark):
    gold = spark.createDataFrame([(1, "febre alta"), (1, "tosse"), (1, "diabetes"), (1, "dor"), (None, "hiv"), (2, "x"), (1, None)], "c long, e string")
    predicted = spark.createDataFrame([(1, "febre"), (1, "diabete"), (1, "tosse"), (1, "tosse seca"), (None, "hiv/aids"), (3, "y")], "c long, e string")
    got = {r["c"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.fuzzy_scores(gold, predicted, "c", "e").collect()}
    assert got == {1: (3, 1, 2), None: (1, 0, 0), 2: (0, 0, 1), 3: (0, 1, 0)}
    assert scoring.fuzzy_scores(gold.limit(0), predicted.limit(0), "c", "e").count() == 0
    with pytest.raises(ValueError):
        similarity.similar_pairs(gold, predicted, "c", "e", 0)
