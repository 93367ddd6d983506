"""Quality rules, tandem runs and the divergence audit against brute force, on made-up tables with awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import divergence, queries, repeats, rules

DOCS = "doc_id long, text string, lang string, source string, term string, n string, value string, runs string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts, langs and sources, empty and long texts, ties, repeats, and columns named like results."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    line = lambda k: " ".join(rng.choices(words, k=k))
    rows = [(i, "\n".join(line(rng.randint(0, 20)) for _ in range(rng.randint(1, 5))), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \n\t ", "en", None), (103, "a  b\nc", "en", "s1"), (104, "a b c", "en", "s1"), (104, "a b c", "en", "s1"), (None, "a b c", "en", "s2"), (None, "a b c " * 30, None, "s2")]
    rows += [(200, "x" * 100_000, "en", "s0"), (201, "ab " * 40_000, "en", "s0"), (202, line(20_000), "fr", "s0"), (203, "Äö 𝔘n d Éa " * 9, "de", "s9"), (204, "l1 x\nl1 x\n\n\nl2\nl1 x \x0b", "xx", "s0"), (205, "", "xx", "s1")]
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules


def counts_of(text):
    text, w = text or "", words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    lines = [x for x in text.split("\n") if words_of(x)]
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines), sum(c.isupper() for c in text), sum(c in "!?" for c in text), sum(c in "0123456789" for c in text), len(set(w)))


def test_statistics_of_whole_texts(spark, odd, empty):
    got = Counter(tuple(r) for r in rules.statistics(odd).select("doc_id", *rules.COUNTS).collect())
    assert got == Counter((r["doc_id"], *counts_of(r["text"])) for r in odd.select("doc_id", "text").collect())
    assert rules.statistics(empty).count() == 0


def test_texts_longer_than_the_sieve_count_alike(spark, odd, monkeypatch):
    want = rules.statistics(odd).select("n_repeat_words").collect()
    monkeypatch.setattr(rules, "PLACE_BITS", 4)
    assert rules.statistics(odd).select("n_repeat_words").collect() == want


def planted(spark, n, seed):
    """Feature rows in which poor ones follow two conjunctions, and other features are noise."""
    rng, known = random.Random(seed), sorted(rules.features())
    out = []
    for i in range(n):
        f = {k: rng.randint(0, 1000) for k in known}
        poor = (f["symbols"] > 700 and f["upper"] <= 500) or f["dup_lines"] > 900
        out.append((*[f[k] for k in known], int(poor), i % 3 == 0))
    names = ", ".join(f"{k} int" for k in known)
    return spark.createDataFrame(out, f"{names}, _poor int, _prune boolean")


def test_covering_finds_planted_conjunctions(spark):
    found = rules.learn(planted(spark, 3000, 1))
    assert 2 <= len(found) <= 4 and all(len(r.conditions) <= 3 for r in found)
    assert {f for r in found for f, _, _ in r.conditions} <= {"symbols", "upper", "dup_lines"}
    other = planted(spark, 3000, 2).withColumn("kept", rules.verdict(found))
    wrong = other.where((F.col("_poor") == 1) == F.col("kept")).count()
    assert wrong < 30
    assert "symbols > " in " / ".join(map(str, found))


def test_one_sided_or_no_labels_give_no_rules(spark):
    rows = planted(spark, 200, 3)
    assert rules.learn(rows.withColumn("_poor", F.lit(0))) == [] == rules.learn(rows.withColumn("_poor", F.lit(1))) == rules.learn(rows.limit(0))
    noise = rows.withColumn("_poor", (F.pmod(F.hash("words", "marks", "length"), F.lit(2)) == 0).cast("int"))
    assert len(rules.learn(noise)) <= 1


def test_rules_in_order_and_none(spark):
    one, two = rules.Rule((("words", True, 10),)), rules.Rule((("words", False, 3), ("marks", True, 0)))
    rows = spark.createDataFrame([(11, 0), (3, 1), (3, 0), (5, 9)], "words int, marks int")
    assert [r[0] for r in rows.select(rules.verdict([one, two])).collect()] == [False, False, True, True]
    assert {r[0] for r in rows.select(rules.verdict([])).collect()} == {True}


def test_quality_rules_hold_on_a_held_out_third(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    got, found = rules.quality_rules(docs, labels.where(~held))
    assert found
    rest = got.join(labels.where(held), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rest.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * n[0, False]
    again, same = rules.quality_rules(docs.repartition(5), labels.where(~held))
    assert same == found


def test_odd_rows_of_rules(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None), (3, 1), (104, 1)], "doc_id long, quality int")
    got, found = rules.quality_rules(odd, labels)
    assert found == [] and got.count() == odd.count()
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) == (not r["kept"])
    assert rules.quality_rules(empty, labels)[0].count() == 0
    kept = rules.drop_by_rules(odd, [rules.Rule((("words", True, 60),))])
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got.where("not base_failed and n_words <= 60").collect())


# tandem runs


def runs_by_hand(w, least):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def without_repeats(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_all_runs_of_short_strings():
    rng = random.Random(1)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 80:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    strings = [[], [0], [0] * 50, *fibonacci]
    for _ in range(1500):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 50))]
        strings.append((w[: rng.randint(1, 9)] * 20)[: len(w)] + w if rng.random() < 0.4 else w)
    for w in strings:
        got = repeats.runs_of(np.array([*w, 99]), 1)
        assert list(zip(*[x.tolist() for x in got], strict=True)) == runs_by_hand(w, 1), w


def test_one_string_holds_many_texts():
    rng = random.Random(2)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 8)):
            w = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([0, 1, 11, 12, 13, 40, 90]))]
            a, p = rng.randrange(len(w) + 1), rng.randint(1, 10)
            texts.append(w[:a] + (w[a : a + p] * 99)[: len(w) - a] if rng.random() < 0.7 else w)
        for w, (n, found, collapsed) in zip(texts, repeats._rows_of([" ".join(w).encode() for w in texts], 12), strict=True):
            want = runs_by_hand(w, 12)
            assert (n, found, collapsed.decode()) == (len(w), want, without_repeats(w, want))


def test_strings_are_cut_between_stretches_only(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join([*rng.choices("abcdefghijkl", k=20), *rng.choices("xyz", k=5) * 6]).encode() for _ in range(30)]
    want = list(repeats._rows_of(texts, 12))
    monkeypatch.setattr(repeats, "STRING_WORDS", 40)
    assert list(repeats._rows_of(texts, 12)) == want and all(r[1] for r in want)


def test_runs_of_odd_rows(spark, odd, empty):
    got = repeats.tandem_runs(odd)
    by_text = {}
    for r in odd.select("doc_id", "text").collect():
        w = words_of(r["text"])
        runs = runs_by_hand(w, 12) if len(w) < 5000 else [(0, 40_000, 1)] if w[0] == "ab" else []
        by_text.setdefault(r["doc_id"], []).append((len(w), [tuple(x) for x in runs], without_repeats(w, runs)))
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_text.items()}
    assert repeats.tandem_runs(empty).count() == 0
    with pytest.raises(ValueError):
        repeats.tandem_runs(odd, least=5)


def test_planted_periods(spark):
    import zlib

    rows = [(i, " ".join(f"{i}-{k}" for k in range(i % 70)) if i % 9 else None) for i in range(400)] + [(None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r, (i, text) in zip(queries.with_periods(docs).collect(), rows, strict=True):
        w = words_of(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, n)])
        assert r["text"] == text


# divergence


def by_hand(rows, least_docs, top=50):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    table = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(table)), lang, s) for t, lang, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(t, s) for t, x, s in terms if x == lang]
        held = Counter(w for t, _ in mine for w in set(t))
        kept = sorted(w for w, k in held.items() if k >= least_docs)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        counts = {s: Counter(w for t, x in mine if x == s for w in t) for s in {s for _, s in mine}}
        p, q = {s: share(c) for s, c in counts.items()}, share(Counter(w for t, _ in mine for w in t))
        for s in p:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            term = [(p[s][w] - q[w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, w, v, i + 1) for i, (v, w) in enumerate(ranked[: None if part == "pair" else top])}
    return out


@pytest.mark.parametrize("least_docs", [1, 2, 9, 1000])
def test_divergence_by_hand(spark, odd, least_docs):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    got = [tuple(r) for r in divergence.audit(odd, least_docs=least_docs, top=7).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, least_docs, 7)


def test_histograms_hold_every_term_of_every_pair(spark):
    rng = random.Random(5)
    counts = [(g, "en", f"t{t}", rng.randint(1, 3)) for g in range(5) for t in range(40) if rng.random() < 0.4]
    groups = spark.createDataFrame([(g, "en", 40) for g in range(6)] + [(9, "de", 0), (10, "de", 0)], "gid long, lang string, vocabulary long")
    got = divergence.joint_histograms(spark.createDataFrame(counts, "gid long, lang string, term string, n long"), groups)
    held = {(g, t): n for g, _, t, n in counts}
    want = {}
    for a, b in combinations(range(6), 2):
        for t in range(40):
            key = (a, b, held.get((a, f"t{t}"), 0), held.get((b, f"t{t}"), 0))
            want[key] = want.get(key, 0) + 1
    assert {tuple(r)[:4]: r["terms"] for r in got.where("terms <> 0").collect()} == want
    assert got.where("a = 9 and b = 10 and terms = 0").count() == 1


def test_divergence_of_an_empty_table_and_flushed_counts(spark, odd, empty, monkeypatch):
    assert divergence.audit(empty).count() == 0
    want = sorted(map(tuple, divergence.term_counts(odd).collect()))
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.term_counts(odd).collect())) == want
