"""The corpus operators against SQL, brute force and exact round trips, on made-up tables with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import boosting, chat, common, exact_dedup, ftrl, minhash, mixing, packing, pii, quality, queries, sharding, toxicity, vectors, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, empty and long texts, repeats, and columns named like results."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \n\t ", "en", None), (103, "a  b\nc", "en", "s1"), (104, "a b c", "en", "s1"), (104, "a b c", "en", "s1"), (None, "a b c", "en", "s2"), (None, "q r", None, "s2")]
    rows += [(200, "x" * 200_000, "en", "s0"), (201, " ".join(rng.choices(words, k=30_000)), "en", "s0")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", "clash") for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    from tests.test_queries import TABLES, rows

    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


# exact dedup


def test_exact_groups(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd).collect()
    source = odd.select("doc_id", "text").collect()
    groups = {}
    for r in source:
        groups.setdefault(hashlib.sha256(norm(r["text"]).encode()).hexdigest(), []).append(r["doc_id"])
    assert len(got) == len(source)
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(groups.keys())
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted(hashlib.sha256(norm(r["text"]).encode()).hexdigest() for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_a_full_filter_only_lets_more_rows_through(odd):
    few = exact_dedup.exact_duplicates(odd, most_bits=exact_dedup.BLOCK, hashes=1)
    assert sorted(map(str, few.collect())) == sorted(map(str, exact_dedup.exact_duplicates(odd).collect()))


# mixing


def water(sizes, weights, total, cap):
    left, out, open_ = total, {}, set(sizes)
    while open_:
        share = {s: left * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_meets_targets(odd, empty):
    got = mixing.mix_queue(odd).groupBy("row", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    sizes = Counter()
    for r in odd.select("source", "text").collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = water(dict(sizes), weights, 1.5 * sum(sizes.values()), 2)
    assert len(got) == odd.count()
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(2, want[s] / 16)
    assert sum(r["taken"] for r in got) == sum(int(want[s]) for s in sizes)
    again = mixing.mix_stream(odd.repartition(5)).select("doc_id", "size", "taken", "pass").collect()
    assert Counter(map(str, again)) == Counter(map(str, mixing.mix_stream(odd).select("doc_id", "size", "taken", "pass").collect()))
    assert mixing.mix_stream(empty).count() == 0 and mixing.mix_documents(empty).columns == empty.columns


def queued(rows, share, weights, passes, ticks, seed=1):
    """Brute force: every fragment of every source in order of finish, one list, cut at the budget. rows: (id, source, size)."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    goal = water(dict(sizes), weight, share * sum(sizes.values()), passes)
    out = []
    for s in sizes:
        at = 0
        for p in range(passes):
            for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0], r[2])):
                for j in range(ticks + 1):
                    low, high = int(goal[s] * j / ticks), int(goal[s] * (j + 1) / ticks) if j < ticks else at + n
                    words = min(at + n, high) - max(at, low)
                    if words > 0:
                        finish = (at + n) / goal[s] if j == ticks or high >= at + n else (j + 1) / ticks
                        out.append((finish, p + 1, hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i, words))
                at += n
    left, taken = sum(int(g) for g in goal.values()), Counter()
    for _, _, _, i, words in sorted(out):
        taken[i] += min(words, left)
        left -= min(words, left)
    return taken


def test_mix_is_the_queue_cut_at_the_budget(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", "c", "d"]), rng.choice([0, 1, 3, 40, 700])) for i in range(120)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, s, n in rows], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_queue(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    want = queued(rows, 1.5, (5, 2, 1), 2, 30)
    assert got == {i: want[i] for i, _, _ in rows}


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"h{k:04d}": rng.choice([1, 5, 30, 900]) for k in range(700)} | {None: 50}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want = water(sizes, weight, 1.5 * sum(sizes.values()), 2)
    got = {r["source"]: r["target"] for r in mixing.targets(df.repartition(5), 1.5).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_is_in_order_and_whole_documents_keep_columns(odd):
    stream = [(r["before"], r["finish"]) for r in mixing.mix_stream(odd).collect()]
    assert stream == sorted(stream) and [f for _, f in stream] == sorted(f for _, f in stream)
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert max(r["count"] for r in mixed.where("doc_id < 60").groupBy("doc_id").count().collect()) <= 2


def test_rows_of_one_id_get_their_own_copies(spark):
    rows = [(None if i % 5 == 0 else i % 7, "x " * (3 + i), f"s{i % 2}") for i in range(60)] + [(1000 + i, "y " * 40, "s0") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix_queue(docs).groupBy("row", "doc_id", "size", "source", "pass").agg(F.sum("taken").alias("taken")).collect():
        taken[(r["doc_id"], r["size"], r["source"])] += int(r["taken"] * 2 >= r["size"])
    got = Counter((r["doc_id"], len(r["text"].split()), r["source"]) for r in mixing.mix_documents(docs).collect())
    assert got == +taken


# packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_over_counts_equals_plan_over_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100 if rng.random() < 0.5 else 20) for _ in range(rng.randint(0, 400))]
    runs = packing.plan(dict(Counter(lengths)), 100)
    assert sum(t for t, _ in runs) == best_fit(lengths, 100)
    assert Counter({n: c for n, c in Counter(x for t, content in runs for n, k in content for x in [n] * (t * k)).items()}) == Counter(lengths)
    assert all(sum(n * k for n, k in content) <= 100 for _, content in runs)


def test_packed_pieces(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack_documents(odd, capacity=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[(r["doc_id"], k // 64, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= 64
    assert len(places) == best_fit([r["length"] for r in got], 64)
    assert packing.pack_documents(empty).count() == 0


def test_word_ids_are_the_tokenizers():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.checked(public_tokenizers.path("word_bpe_49k.json"))
    t, rng = Tokenizer.from_file(path), random.Random(3)
    bits = ["a", "B", "é", "É", ".", ",", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", " ", " ", "\n", "1", "中", "ß", "İ", "\u0301", "don't", "<|", "|>", "\u0085", "\xa0"]
    texts = ["it's o'clock... a.b, 'Tis <|endoftext|> x\u0085y é \x1cz ÀÉ, İI Σας ΑΣ.", "", " \n\t", "a,b.,c ..,,", "ªº² ß ǅ ﬁ, ﬁ. é. ５ x²", "é. ́a 中文,字.", "don't. 'll, x's.", None, "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|>. <|endoftext|>."]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for most in (packing.CACHED_WORDS, 40):  # the second forgets words all the time
        words, got = packing.WordIds(path, most), []
        for _, _, data, offsets in wordhash.slices(pa.array(texts)):
            ids, ends = words.of(data, offsets)
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError, match="only byte-level"):
        packing.checked(public_tokenizers.path("byte_bpe_50k.json"))


# toxicity and quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("aeioubdglmnrst", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        body = rng.choices(words, k=rng.randint(20, 80))
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.8)
        if toxic:
            for _ in range(3):
                body[rng.randrange(len(body))] = rng.choice(["fiend", "wretch", "louse"])
        if not good:
            body = [w.upper() + "!!" for w in body]
        docs.append((i, " ".join(body) if good else "|".join(body[:5]) + "\n" + " ".join(body), "en", f"s{i % 4}", 0))
        if i % 3:
            labels.append((i, good, toxic))
    docs += [(9000, None, None, None, 0), (9001, "", "en", "s", 0), (None, "word", "en", "s", 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([*labels, (1, None, None), (None, 1, 1), (77777, 1, 0)], "doc_id long, quality int, toxic int"), {r[0]: r for r in docs}


def test_toxicity_on_held_out_rows(labelled, empty):
    docs, labels, rows = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [(r["score"], any(w in rows[r["doc_id"]][1] for w in ("fiend", "wretch", "louse", "FIEND", "WRETCH", "LOUSE"))) for r in got if r["held_out"] and r["doc_id"] < 900]
    bad, fine = [s for s, y in unseen if y], [s for s, y in unseen if not y]
    assert sum(a > b for a in bad for b in fine) / (len(bad) * len(fine)) > 0.95
    assert toxicity.toxicity(empty.select("doc_id", "text"), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_chances_rise_and_fit_the_labels():
    rng = np.random.default_rng(2)
    sums = np.round(rng.normal(size=400) * 3, 1)
    labels = (rng.random(400) < 1 / (1 + np.exp(-2 * sums))).astype(float)
    curve = toxicity.chances(sums, labels)
    at = np.unique(sums)
    found = curve.of(at)
    assert (np.diff(found) > 0).all() and 0 < found[0] and found[-1] < 1
    assert abs(curve.of(sums).mean() - labels.mean()) < 0.03
    # of all rising step functions none is nearer: no two neighbouring pools are out of order
    level = {x: np.interp(x, curve.sums, curve.chances) for x in at}
    pools = {}
    for x, y in zip(sums, labels):
        pools.setdefault(level[x], []).append(y)
    means = [np.mean(v) for _, v in sorted(pools.items())]
    assert all(a <= b for a, b in zip(means, means[1:]))
    assert (toxicity.chances(np.empty(0), np.empty(0)).of(np.zeros(3)) == 0.5).all()
    assert toxicity.chances(np.zeros(9), np.ones(9)).of(np.zeros(1))[0] > 0.9


def test_ftrl_equals_the_update_rule():
    """Coordinate by coordinate, as the rule is written."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = rng.integers(0, 2, 60).astype(float)
    model = ftrl.Ftrl(alpha=0.5, l1=0.3, l2=0.1).fit(rows, y, 2)
    z, n, order = Counter(), Counter(), np.random.default_rng(7)

    def weight(i):
        l1 = 0.0 if i == "bias" else 0.3
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + n[i] ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for k in order.permutation(60):
            on = [*rows[k].tolist(), "bias"]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[k]
            for i in on:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += g * g
    sparse = model.sparse()
    got = dict(zip(sparse.index.tolist(), sparse.weight.tolist(), strict=True))
    assert all(abs(got.get(i, 0.0) - weight(i)) < 1e-6 for i in range(30)) and abs(sparse.bias - weight("bias")) < 1e-9


def test_scores_are_the_weights_of_a_texts_distinct_features(spark):
    import pyarrow as pa

    texts = ["You fiend, you  fiend!", "", "a b a b", None, "naïve ÉTÉ"]
    _, count, rows, index = next(iter(toxicity.features(pa.array(texts))))
    index_of = [sorted(set(index[rows == i].tolist())) for i in range(count)]
    some = sorted({x for xs in index_of for x in xs})
    model = ftrl.Sparse(-0.25, np.array(some, np.int32), np.linspace(-1, 1, len(some)).astype(np.float32))
    weight = dict(zip(some, model.weight.tolist(), strict=True))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(0.25 - sum(weight[x] for x in xs)))) < 1e-6 for i, xs in enumerate(index_of))


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(100, 5000, 50)) for _ in range(400)]
    y = np.array([i % 2 for i in range(400)], float)
    rows = [np.append(r, 7) if t else r for r, t in zip(rows, y, strict=True)]
    model = ftrl.Ftrl(alpha=1.0, l1=3.0, l2=0.1).fit(rows, y, 3).sparse()
    assert 7 in model.index and len(model.index) < 100


def test_quality_keeps_good_pages(labelled, empty):
    docs, labels, rows = labelled
    got = {r["doc_id"]: r["keep"] for r in quality.quality(docs, labels).collect()}
    good = [i for i, r in rows.items() if i is not None and i < 900 and "!!" not in r[1]]
    poor = [i for i, r in rows.items() if i is not None and i < 900 and "!!" in r[1]]
    assert np.mean([got[i] for i in good]) > 0.98 and np.mean([got[i] for i in poor]) < 0.1
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert quality.quality(docs, labels.limit(0)).where("keep").count() == docs.count()
    assert quality.quality(empty, labels).count() == 0


def test_quality_learns_from_unlabelled_rows_outside_any_sample(spark, labelled):
    docs, labels, rows = labelled
    poor = [r[1].replace("\n", " ") for i, r in rows.items() if i is not None and i < 600 and "!!" in (r[1] or "")]
    last = [r["id"] for r in spark.range(20_000, 21_000).orderBy(F.xxhash64("id", F.lit(13)).desc()).limit(60).collect()]
    rare = spark.createDataFrame([(i, poor[k], "en", "rare", 0) for k, i in enumerate(last)], docs.schema)
    model, _ = quality.fit(docs.unionByName(rare), labels.where("doc_id < 600"), pool_rows=240)
    source = quality._feature("source", np.array([quality.hash_bytes(b"rare")]))[0]
    assert model.views[1].table()[source] < 0


def test_co_training_equals_its_rounds_by_hand(spark, labelled):
    """The same rounds in one process: the models learnt from all rows at once are the models of the jobs."""
    import pyarrow as pa

    docs, labels, rows = labelled
    label = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null and doc_id is not null").collect()}
    table = quality._keyed(docs, "doc_id", "text", "source", "lang").toArrow()
    batch = table.combine_chunks().to_batches()[0]
    keys, ids = batch.column("_key").to_pylist(), batch.column("_id").to_pylist()
    views = ([], [])
    for _, count, a, b in quality.views(batch):
        for view, part in zip(views, (a, b), strict=True):
            view.extend(ftrl.per_row(*part, count))
    given = [{}, {}]

    def learnt():
        theirs = given[0].keys() | given[1].keys()
        chosen = sorted((i for i in range(len(keys)) if ids[i] in label or keys[i] in theirs), key=lambda i: (keys[i], len(views[0][i])))
        y = np.array([label.get(ids[i], -1) for i in chosen])
        pseudo = tuple(np.array([g.get(keys[i], -1) for i in chosen], int) for g in given)
        return quality.learn(([views[0][i] for i in chosen], [views[1][i] for i in chosen]), y, pseudo, 3)

    model = learnt()
    for _ in range(3):
        free = [i for i in range(len(keys)) if ids[i] not in label]
        logit = [{keys[i]: float(model.views[v].table()[views[v][i]].sum() + model.views[v].bias) for i in free} for v in range(2)]
        many = max(1, int(0.5 * min(4000, len(free)) / 3))
        for v in range(2):
            picked = []
            for y, sign in ((1, 1), (0, -1)):
                best = sorted((k for k in logit[v] if sign * logit[v][k] >= quality.SURE), key=lambda k, v=v, s=sign: (-s * logit[v][k], k))
                picked += [(k, y) for k in best if k not in given[1 - v]][:many]
            given[1 - v].update(picked)
        model = learnt()
    got, _ = quality.fit(docs, labels)
    assert sum(map(len, given)) > 20
    for a, b in zip(got.views, model.views, strict=True):
        assert np.abs(a.table() - b.table()).max() < 1e-4 and abs(a.bias - b.bias) < 1e-4
    assert np.abs(got.scale - model.scale).max() < 1e-3 and np.abs(got.mix - model.mix).max() < 1e-3


def test_threshold_keeps_its_share_of_the_good_pages_not_fitted(spark):
    scored = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") / 20_000).alias("_quality"))
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    fitted = spark.range(0, 5000).select(F.col("id").alias("_id"))
    least = quality.rejects(scored, labels, fitted)
    assert 0.25 < least <= 0.2509
    assert quality.rejects(scored, labels.limit(0), fitted) == 0.0
    assert quality.rejects(scored, labels, labels.select(F.col("doc_id").alias("_id"))) < 0.002


def test_worker_keeps_one_cache(spark):
    assert common.held("a", dict) is common.held("a", dict)
    common.held("b", list)
    assert list(common._held) == ["b"]
    common.let_go()
    assert not common._held


# chat


def test_chat_escapes_and_reads_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["\\", "<", "[", "s>", "/s>", "INST]", "[INST]", "[ROLE:", "<|image:", "]", " ", "a\n"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for x in texts:
        assert chat.unescape(chat.escape(x)) == x and not chat._CONTROL.search(chat.escape(x))
        before, after = chat.marks(x)
        assert chat.parse(before + chat.escape(x) + after) == (x, x) or x in chat.OPEN
    turns = spark.createDataFrame([(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "tool use]", "y"), (1, 1, "assistant", "b</s>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.formatted_conversations(turns).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 10
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb</s>\nassistant\nb</s>\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b</s>b</s>").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"tool use]\ny\n").hexdigest()
    assert chat.formatted_conversations(turns.limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    parts = [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "uri": "u1", "width": 57, "height": 28}, {"type": "audio", "uri": "u2", "seconds": 2.0}, {"type": "document", "uri": None, "pages": 3}, {"type": "odd", "text": "end"}, None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, text {chat.T.ArrayType(chat.PART).simpleString()}")
    r, empty_turn = chat.format_turns(df).orderBy("turn").collect()
    assert r["segment"] == "<s>[INST] see <\\|image:0|><|image:0:3|><|audio:1:50|><|document:2:1536|>end [/INST]"
    assert [(a["position"], a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "u1", 3), (1, "audio", "u2", 50), (2, "document", None, 1536)]
    assert r["expanded_tokens"] == 1589 and empty_turn["loss"][0]["start"] == empty_turn["loss"][0]["end"]


# near-duplicates


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(rows, similarity=0.8):
    """Brute force over all pairs."""
    rows = [r for r in rows if r[0] is not None]
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            either = sum((bags[i] | bags[j]).values())
            same = norm(rows[i][1]).split() == norm(rows[j][1]).split() or rows[i][0] == rows[j][0]
            if same or (either and sum((bags[i] & bags[j]).values()) >= similarity * either):
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return {k: least[top(i)] for i, (k, _) in enumerate(rows)}


def copies(seed=3, families=12):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(900)]
    rows, k = [], 0
    for f in range(families):
        base = rng.choices(words, k=rng.randint(3, 140)) * (2 if f % 4 == 0 else 1)
        for _ in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((k, " ".join(text)))
            k += 1
    return [*rows, (900, None), (901, ""), (902, " "), (903, "one two"), (904, "one  two"), (None, "one two"), (903, "one two")]


def test_near_classes_equal_brute_force(spark, empty):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_classes(docs).collect()]
    assert len(got) == len(rows) and {k: c for k, c in got if k is not None} == classes(rows)
    kept = minhash.drop_near_duplicates(docs)
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == set(classes(rows).values())
    assert minhash.near_classes(empty).count() == 0


def test_near_classes_of_string_ids_and_of_one_id_with_several_texts(spark):
    rows = copies(21, 6)
    rows += [(k, t) for (k, _), (_, t) in zip(rows[:6], rows[-20:-14], strict=True)]  # ids once more, with other texts
    want = classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect() if r["doc_id"] is not None} == want
    texts = docs.withColumn("doc_id", F.format_string("k%05d", "doc_id")).where("doc_id not like '%null%'")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(texts).collect()}
    assert got == {f"k{a:05d}": f"k{b:05d}" for a, b in want.items()}


def test_hot_leaders_and_components_are_dealt_out(spark):
    """One text with hundreds of near copies, so that pairs, edges and labels of one key are salted."""
    rng = random.Random(5)
    words = [f"u{i}" for i in range(4000)]
    base = rng.choices(words, k=120)
    rows = [(0, " ".join(base))]
    for k in range(1, 1400):
        text = list(base)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(text)))
    got = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_recall_of_planted_pairs(spark):
    """2,000 pairs of distinct texts at similarity 0.8 to 0.85: the least that must be linked."""
    rng = random.Random(17)
    rows, pairs = [], 0
    while pairs < 2000:
        n = rng.randint(60, 300)
        base = [f"p{pairs}x{i}" for i in range(n)]
        other, changed = list(base), 0
        at = rng.randrange(5, n - 12)
        while bag_ratio(base, other) >= 0.86 and changed < 60:
            other[(at + changed) % n] = f"q{pairs}x{changed}"
            changed += 1
        if 0.8 <= bag_ratio(base, other) < 0.86:
            rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(other))]
            pairs += 1
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.999 * pairs


def bag_ratio(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK_TEXTS", 3)
    rows = copies(8, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_classes(docs).collect() if r["doc_id"] is not None} == classes(rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    off = []
    for _ in range(40):
        w = rng.integers(1, 20, 60)
        v = np.maximum(1, w + rng.integers(-6, 7, 60))
        h = wordhash.mix(rng.integers(0, 2**63, 60).astype(np.uint64))
        s = minhash.signatures(np.concatenate([h, h]), np.repeat([0, 1], 60), np.concatenate([w, v]), 2, 1024)
        off.append((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(off)) < 0.008 and np.std(off) < 0.03


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    v = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 160), 500]], "id long")
    got = {r["id"]: r["component"] for r in common.components(v, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500}


# vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 150, 250)] + rng.normal(size=(250, 16)) * 0.35
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, near]))]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (1005, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    for chunk, cell in ((4096, 4096), (30, 100)):
        got = {r["vec_id"]: r for r in vectors.near_vectors(df, chunk_rows=chunk, sample_rows=cell).collect()}
        x = np.array([v for _, v in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = x @ x.T >= 0.9
        np.fill_diagonal(g, False)
        assert [got[i]["n_links"] for i in range(len(rows))] == g.sum(1).tolist()
        label = np.arange(len(x))
        for _ in range(50):
            label = np.array([min(label[i], label[g[i]].min() if g[i].any() else label[i]) for i in range(len(x))])
        assert [got[i]["component_id"] for i in range(len(rows))] == label.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_each_length_link(spark):
    rng = np.random.default_rng(8)
    rows = []
    for dim, many in ((1, 6), (2, 20), (3, 20), (12, 30), (16, 60)):
        base = rng.normal(size=(many // 2, dim))
        rows += [[float(x) for x in v] for v in np.vstack([base, base + rng.normal(size=base.shape) * 0.1])]
    rows = list(enumerate(rows))
    rows += [(0, rows[-1][1]), (7, rows[7][1]), (None, rows[9][1]), (None, [0.0, 0.0, 1e9]), (None, [float("nan")])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == linked(rows)


def linked(rows, cosine=0.9):
    """Brute force over rows (id, vector): how often each (id, links, least id reachable, kept) is in the result."""
    def one(v):
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [one(v) for _, v in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine]
    many, label = Counter(a for a, _ in pairs), list(range(len(rows)))
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label)}
    return Counter((i, many[k], least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows))


def test_rows_of_one_id_and_of_none_count_on_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.02]), (3, [0.0, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False), (3, 0, 3, True)]) == linked(rows)
    nameless = vectors.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.1])], "vec_id string, embedding array<float>")).collect()
    assert [tuple(r) for r in nameless] == [(None, 1, None, True)] * 2


def test_one_vector_in_very_many_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 2500, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(-7.0))).alias("embedding"))
    got = vectors.near_vectors(rows).groupBy("n_links", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(2499, 0, 2500), (499, 2500, 500)}


def test_vectors_of_extreme_size_copies_and_string_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [list(v) for v in base] + [list(v * s) for v, s in zip(base[:6], (1e-200, 1e200, 1e-300, 1e300, 5e-310, 1e307), strict=True)] + [list(base[0])] * 9
    rows = [(f"id{k:03d}", [float(x) for x in v]) for k, v in enumerate(rows)]
    for chunk in (vectors.CHUNK_ROWS, 4):
        got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), chunk_rows=chunk).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == linked(rows)


def test_pairs_at_a_blocks_bound(spark):
    """Pairs whose whole distance lies in one block, at the budget of all of them, with borders of cells between them."""
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(400, 8))
    plan = vectors.Plan(vectors.unit(sample), 0.9, 4, 8, 10**9)
    rows = []
    for k in range(60):
        axis = plan.axes[k % 4]
        u = vectors.unit((axis @ rng.normal(size=axis.shape[1]))[None])[0]
        other = axis @ rng.normal(size=axis.shape[1])
        other = vectors.unit((other - (other @ u) * u)[None])[0]
        angle = np.arccos(0.9) * (1 - 1e-9 if k % 2 else 1 + 1e-7)
        rows += [u, np.cos(angle) * u + np.sin(angle) * other]
    rows = list(enumerate([[float(x) for x in v] for v in [*rows, *vectors.unit(sample)]]))
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most_pivots=8, sample_rows=400).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == linked(rows)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_spans_equal_plain_patterns(spark, empty):
    rng = random.Random(5)
    bits = ["a", "b.c", "@", "@x.yz", "1", "22", "255", "256", "0", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "é", "😀", "\n", "_", "%", "4111111111111111", "+1 (555) 010-9999", "10.0.0.1"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, "1" * 3000 + "a" * 5000 + "@" + " 1-" * 3000), (1002, "1.2.3.4 " * 1200), (None, "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.spans(docs)
    got = {r["doc_id"]: r for r in pii.digest(found).collect()}
    for k, text in rows:
        want = {kind: [m for m in re.finditer(p, text or "") if passes(kind, m.group())] for kind, p in BASE.items()}
        assert [got[k][f"n_{kind}"] for kind in BASE] == [len(want[kind]) for kind in BASE], text
        listed = ",".join(f"{kind}:{m.start()}:{m.end()}" for kind in BASE for m in want[kind])
        assert got[k]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and got[k]["spans"].startswith(listed)
    assert pii.digest(pii.spans(empty)).count() == 0


def test_added_spans_and_redaction(spark):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    rows = [(i, f"word password={key(12).lower()} then {key(20)} and version 3.0 {'é' * (i % 3)} me{i}@ex.org") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.spans(docs)
    texts = [r["text"] for r in pii.redact(docs).collect()]
    kinds = Counter(s["kind"] for r in found.collect() for s in r["added"])
    assert kinds["secret"] >= 70 and kinds["key"] >= 70
    assert sum("password=[secret]" in t for t in texts) == kinds["secret"] and sum("[key]" in t for t in texts) == kinds["key"]
    assert all(t.endswith("[email]") and "version 3.0 " in t for t in texts)


def test_redaction_of_null_and_repeated_ids(spark):
    rows = [(None, "to a@b.cd"), (1, "ma a@b.cd"), (1, "x c@d.ef"), (1, None), (2, ""), (3, "é 4111 1111 1111 1111, 10.0.0.1")]
    docs = spark.createDataFrame([(i, t, "_t", "s") for i, t in rows], "doc_id long, text string, _t string, base string")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (r["text"] for r in got.collect()))) == sorted(["to [email]", "ma [email]", "x [email]", "None", "", "é [card], [ip]"])


def test_trees_on_spans_planted_elsewhere(spark):
    model, least = pii.fitted(spark)
    for g, kind in enumerate(pii.CANDIDATES):
        rows = [r[1:] for r in pii.examples(spark, 6000, seed=99) if r[1][0] == g]
        taken = [(hits, n) for x, hits, n in rows if model.probability(x) >= least[g]]
        hits, n, real = sum(h for h, _ in taken), sum(n for _, n in taken), sum(h for _, h, _ in rows)
        assert hits / n > 0.93 and hits / real > 0.5, (kind, hits / n, hits / real)


def test_base_spans_hide_candidates_and_masks_are_exact(spark):
    rows = [(0, "call (555) 010-1234 now"), (1, "call +1 (555) 010-9999 now"), (2, "tel 4111 1111 1111 1111 x"), (3, "é 10.0.0.1 call 555-010-1234")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"] + r["added"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [("number", 5, 19)], 1: [("phone", 5, 22)], 2: [("card", 4, 23)], 3: [("ip", 2, 10), ("number", 16, 28)]}


def test_trees_learn_counts():
    rows = [((a, b), float(n * (a > 1 or b == 0)), float(n)) for a in range(4) for b in range(3) for n in (20,)]
    model = boosting.calibrate(boosting.boost(rows), rows)
    assert all((model.probability(x) > 0.5) == (p > 0) for x, p, _ in rows)
    assert boosting.threshold(model, rows, 0.95) <= min(model.probability(x) for x, p, _ in rows if p)
    assert boosting.boost([]).probability((0, 0)) == 0.5 and boosting.threshold(boosting.boost([]), [], 0.9) > 1


# sharding


def test_shards(odd, empty):
    placed, slot_map = sharding.shard_documents(odd, 7)
    got, source = placed.collect(), odd.select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in source)
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.SlotMap.from_json(slot_map.to_json()) == slot_map
    assert sharding.shard_documents(empty)[0].count() == 0
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert len(loads) <= 7


def test_shards_hold_equal_bytes(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(900)).cast("int")).alias("text"))
    loads = [r["n"] for r in sharding.shard_documents(docs, 10)[0].groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(loads) == 10 and max(loads) - min(loads) < 0.002 * sum(loads) / 10


def test_stored_map_is_edited_when_bytes_move(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/map"
    small = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.col("id"), F.lit(50)).cast("int")).alias("text"))
    first, made = sharding.shard_documents(small, 5, folder=folder)
    assert sharding.versions(spark, folder) == [1, 2] and sharding.load_map(spark, folder).shards == made.shards
    again, same = sharding.shard_documents(small, 5, folder=folder)
    assert same.version == 2 and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    grown = small.withColumn("text", F.when(F.col("doc_id") < 300, F.repeat(F.col("text"), 60)).otherwise(F.col("text")))
    later, edited = sharding.shard_documents(grown, 5, folder=folder)
    assert edited.version == 3 and 0 < sum(a != b for a, b in zip(made.shards, edited.shards, strict=True)) < 400
    loads = [r["n"] for r in later.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(loads) < 1.02 * sum(loads) / 5
    with pytest.raises(ValueError, match="already"):
        sharding.save_map(spark, folder, edited)
    wider = edited.grown(sharding.slot_weights(sharding.sized_records(grown), sharding.SLOTS)[0])
    placed, used = sharding.shard_documents(grown, slot_map=wider)
    assert used.count == 6 and {r["shard"] for r in placed.select("shard").distinct().collect()} == set(range(6))


def test_map_edits_move_few_slots():
    rng = random.Random(3)
    weights = [rng.randint(1, 100) for _ in range(2000)]
    packed = sharding.SlotMap.packed(weights, 40)
    loads = packed._loads(weights)
    assert max(loads) < 1.01 * sum(loads) / 40
    grown = packed.grown(weights)
    assert grown.version == 2 and all(to == 40 for _, _, to in grown.moved)
    assert all(a == b or b == 40 for a, b in zip(packed.shards, grown.shards, strict=True))
    assert 0.9 < grown._loads(weights)[40] / (sum(weights) / 41) < 1.1
    skewed = sharding.SlotMap.fresh(2000, 40).rebalanced([w * (50 if i % 40 == 0 else 1) for i, w in enumerate(weights)])
    assert 0 < len(skewed.moved) < 200
