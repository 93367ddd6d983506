"""Near-duplicates by BagMinHash over multisets of word shingles, banding and exact verification.

A shingle that occurs c times has weight c. Weights are discretised at the integers and grouped in dyadic intervals
[0, 1), [1, 2), [2, 4), [4, 8), ...: each interval of each shingle has a Poisson process in time, whose rate is its
length for each of m components. A point belongs to a component and to a place in its interval; a document with
weight c sees the points below c. A component's value is the first point seen, so two documents agree in it with the
probability of their weighted Jaccard similarity. Points are made in order of time and only until every component has
one, which takes about m ln m points whatever the document's length. The intervals stand side by side and points beyond a
weight are rejected; an interval is not split on its next point, which gives the same distribution.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import wordhash
from notemill.llm.common import bounded_broadcast, components, copied, cut, hot_keys, map_texts, named, numbered, salted, salted_join

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 6) ** 32, less than 1 in 10,000.
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
#: Of SIZE one-bit values, a pair of similarity 0.8 differs in a tenth; beyond 5 standard deviations of that it is not verified.
MOST_BITS = int(SIZE * 0.1 + 5 * (SIZE * 0.1 * 0.9) ** 0.5) + 1
#: Members of one bucket that a task holds at most twice of: texts, and their shingles in all (one text may be larger).
CHUNK_TEXTS, CHUNK_SHINGLES = 1024, 2_000_000
_NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all shingles (a text of fewer words has one of all its words), and two checksums of each row's words."""
    count = len(offsets) - 1
    starts, ends, rows = wordhash.spans(data, offsets, _NOT_SPACE)
    hashes = wordhash.span_hashes(data, starts, ends)
    many = np.bincount(rows, minlength=count)
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    place = (np.arange(len(rows)) - first[rows]).astype(np.uint64)
    sums = []
    for salt in (0x1F, 0x2F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(hashes + wordhash.mix(place + np.uint64(salt))), dtype=np.uint64)])
        sums.append(wordhash.mix(total[first + many] - total[first] + many.astype(np.uint64)))
    long, long_rows = wordhash.joined(hashes, rows, tuple(range(words)))
    few = np.flatnonzero((many > 0) & (many < words))
    return np.concatenate([long, sums[0][few]]), np.concatenate([long_rows, few]), sums[0], sums[1]


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order and how often each occurs."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))


def signatures(hashes: np.ndarray, rows: np.ndarray, weights: np.ndarray, count: int, size: int = SIZE) -> np.ndarray:
    """count x size values from distinct (row, hash) with weights; rows without any keep zeros."""
    out = np.zeros(count * size, np.uint64)
    total = np.bincount(rows, weights=weights, minlength=count)
    horizon = np.where(total > 0, (np.log(size) + 4) / np.maximum(total, 1), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        here = np.zeros(count, bool)
        here[todo] = True
        mine = here[rows]
        h, r, w = hashes[mine], rows[mine], weights[mine]
        levels = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1  # intervals that begin below w
        item = np.repeat(np.arange(len(h)), levels)
        level = np.arange(len(item)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
        length = np.maximum(low, 1)
        base = wordhash.mix(h[item] + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        rate, until, below, row = size * length.astype(float), horizon[r[item]], w[item], r[item]
        time, step = np.zeros(len(item)), 0
        least = np.full(count * size, np.inf)
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(base):
            step += 1
            value = wordhash.mix(base + np.uint64(step * int(_GOLD) % 2**64))
            time = time - np.log(((value >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
            on = time <= until
            if not on.all():
                base, rate, until, below, row, low, length, time, value = (x[on] for x in (base, rate, until, below, row, low, length, time, value))
            more = wordhash.mix(value ^ np.uint64(0x94D049BB133111EB))
            weight_at = low + (more >> np.uint64(32)).astype(np.int64) * length // (1 << 32)
            seen = weight_at < below
            key = (row * size + ((more & np.uint64(0xFFFFFFFF)).astype(np.int64) * size >> 32))[seen]
            np.minimum.at(least, key, time[seen])
            points.append((key, time[seen], value[seen]))
        for key, when, value in points:
            first = when == least[key]
            out[key[first]] = value[first]
        empty = np.isinf(least.reshape(count, size)).any(axis=1) & here
        horizon[empty] *= 2
        todo = np.flatnonzero(empty)
    return out.reshape(count, size)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    yield from wordhash.slices(batch.column("_text"))


def sign(found: DataFrame) -> DataFrame:
    """(_id, k1, k2, weight, b0.., bands) of every row of (_id, _text): checksums of its words, number of shingles, one-bit values, bands."""
    bits = [f"b{i}" for i in range(-(-SIZE // 64))]

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, data, offsets in _texts(batch):
                h, r, k1, k2 = shingles(data, offsets)
                weight = np.bincount(r, minlength=count)
                signature = signatures(*counted(h, r), count)
                packed = np.packbits((signature & np.uint64(1)).astype(np.uint8), axis=1).view("<i8") if count else np.empty((0, len(bits)), np.int64)
                band = np.zeros((count, BANDS), np.uint64)
                for i in range(ROWS):
                    band = wordhash.mix(band + signature[:, i::ROWS] * np.uint64(2 * i + 3))
                band = wordhash.mix(band + np.arange(BANDS, dtype=np.uint64))
                ends = np.concatenate([[0], np.cumsum(np.where(weight > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[weight > 0].ravel().view(np.int64)))
                cols = [batch.column("_id").slice(first, count), *[pa.array(k.view(np.int64)) for k in (k1, k2)], pa.array(weight, pa.int64()), *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(bits))], bands]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "k1", "k2", "weight", *bits, "bands"])

    return map_texts(found.select("_id", "_text"), signed, f"_id long, k1 long, k2 long, weight long, {', '.join(f'{b} long' for b in bits)}, bands array<long>")


def bags(found: DataFrame, texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(t, bag) of the needed texts (t): a text's shingles as distinct numbers, the j-th occurrence of a shingle being its own.

    A text is read from a row with its first id; k1 and k2 tell it from others with that id.
    """
    wanted = cut(needed.join(texts.select("t", "rep", "k1", "k2"), "t"))
    rows = found.select("_id", "_text").join(bounded_broadcast(wanted.select(F.col("rep").alias("_id")).distinct()), "_id", "left_semi")

    def bagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, data, offsets in _texts(batch):
                h, r, k1, k2 = shingles(data, offsets)
                h, r, n = counted(h, r)
                item = np.repeat(np.arange(len(h)), n)
                turn = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
                number = np.where(turn == 0, h[item], wordhash.mix(h[item] + turn.astype(np.uint64) * _GOLD)).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(r[item], minlength=count))]).astype(np.int32)
                keys = [pa.array(k.view(np.int64)) for k in (k1, k2)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, count), *keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(number))], ["rep", "k1", "k2", "bag"])

    made = map_texts(rows, bagged, "rep long, k1 long, k2 long, bag array<long>")
    return made.join(bounded_broadcast(wanted), ["rep", "k1", "k2"]).select("t", "bag").dropDuplicates(["t"])


def verified(pairs: DataFrame, texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b: texts; a cut table) whose multisets of shingles have at least the similarity, exactly.

    A text that is b of very many pairs is copied to as many tasks as they need.
    """
    bag = bags(found, texts, pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    left, right = (bag.select(F.col("t").alias(side), F.col("bag").alias(f"bag_{side}")) for side in ("a", "b"))
    hot = hot_keys(pairs, "b")
    both = F.size(F.array_intersect("bag_a", "bag_b"))
    met = salted(pairs.select("a", "b"), "b", hot).join(left, "a").join(copied(right, "b", hot), ["b", "_salt"])
    shared = met.select("a", "b", both.alias("both"), (F.size("bag_a") + F.size("bag_b") - both).alias("either"))
    return shared.where(F.col("both") >= F.col("either") * similarity).select("a", "b")


def across(placed: DataFrame, texts: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components of one bucket, enough of them to join what is linked.

    placed: (t, key, component). A bucket's members meet in one task, or, in chunks of bounded size, in one task for
    each two chunks. A pair is compared in the first bucket that it shares and only while its components are apart, so
    a task returns fewer links than it has members.
    """
    needed = cut(placed.select("t").distinct())
    bag = bags(found, texts, needed)
    facts = texts.drop("k1", "k2", "rep", "copies")
    sized = placed.join(facts.select("t", "weight"), "t")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("weight") / CHUNK_SHINGLES)).cast("int")
    counts = cut(sized.groupBy("key").agg(chunks.alias("chunks")))
    tasks = max(1, needed.count() // 500)
    dealt = placed.join(bounded_broadcast(counts), "key").withColumn("chunk", F.pmod(F.xxhash64("t"), F.col("chunks")).cast("int"))
    meets = F.concat(F.transform(F.sequence(F.lit(0), F.col("chunk")), lambda h: F.struct(h.alias("h"), F.col("chunk").alias("c"))), F.when(F.col("chunk") + 1 < F.col("chunks"), F.transform(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1), lambda c: F.struct(F.col("chunk").alias("h"), c.alias("c")))).otherwise(F.array().cast("array<struct<h:int,c:int>>")))
    dealt = dealt.select("t", "key", "component", "chunk", F.when(F.col("chunks") == 1, F.pmod("key", F.lit(tasks))).otherwise(F.lit(-1)).alias("shared"), F.explode(meets).alias("m"))
    dealt = dealt.select("t", "key", "component", "chunk", "m.h", "m.c", F.when(F.col("shared") >= 0, F.col("shared")).otherwise(F.xxhash64("key", "m.h", "m.c")).alias("task"))
    bits = [c for c in facts.columns if c[0] == "b" and c != "bands"]
    rows = dealt.join(facts, "t").join(bag, "t")

    def compared(table: pa.Table) -> pa.Table:
        number = lambda name: table.column(name).to_numpy()
        rep, key, component, chunk, h, c, weight = (number(n) for n in ("t", "key", "component", "chunk", "h", "c", "weight"))
        packed = np.stack([number(b) for b in bits], 1).view(np.uint64)
        band = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        lists = table.column("bag").combine_chunks()
        bag_of = [np.sort(lists[i].values.to_numpy()) for i in range(len(lists))]
        order = np.lexsort((c, h, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
        cuts = np.append(np.flatnonzero(new), len(order))
        a, b = [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            group = order[s:e]
            k, same = key[group[0]], h[group[0]] == c[group[0]]
            left, right = group[chunk[group] == h[group[0]]], group[chunk[group] == c[group[0]]]
            label = dict(zip(group.tolist(), np.unique(component[group], return_inverse=True)[1].tolist(), strict=True))
            left_label, right_label = (np.array([label[i] for i in x.tolist()], np.int64) for x in (left, right))
            for n, i in enumerate(left):
                apart = right_label != left_label[n]
                if same:
                    apart[: n + 1] = False
                j = np.flatnonzero(apart)
                if not len(j):
                    continue
                other = right[j]
                ok = np.minimum(weight[i], weight[other]) >= similarity * np.maximum(weight[i], weight[other])
                ok &= np.bitwise_count(packed[other] ^ packed[i]).sum(1) <= MOST_BITS
                j, other = j[ok], other[ok]
                if not len(j):
                    continue
                agree = band[other] == band[i]
                ok = band[i][agree.argmax(1)] == k
                j, other = j[ok], other[ok]
                if not len(j):
                    continue
                mine, theirs = bag_of[i], [bag_of[o] for o in other]
                flat = np.concatenate(theirs)
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                sizes = np.array([len(x) for x in theirs])
                both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for t in j[both >= (len(mine) + sizes - both) * similarity]:
                    if right_label[t] != left_label[n]:
                        a.append(rep[i])
                        b.append(rep[right[t]])
                        old, to = right_label[t], left_label[n]
                        right_label[right_label == old] = to
                        left_label[left_label == old] = to
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return cut(rows.groupBy("task").applyInArrow(compared, "a long, b long"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, class_id, copies, kept) of every row: class_id is the smallest id reachable over links.

    Words are runs of characters outside [\\x20\\x09-\\x0D], as they are; two texts link when the multisets of their
    shingles have weighted Jaccard similarity `similarity` or more. Texts of the same words always share a class, also
    those without words, which link with nothing else; texts of one to four words have one shingle. copies: rows with the
    same words. Null texts count as empty. Ids are of any type with an order. Rows without an id stand alone (class_id
    null, kept); rows repeated with one id share its class, whatever their texts. Other columns are not read. An empty table gives an empty result.

    Pairs are never listed within a bucket. Distinct texts are first held against their bucket's most central member
    only, which makes few components of a large group of near copies at one pair a member and band. Then the members of
    one bucket that lie in different components are compared in blocks, until they are joined or all pairs are tried. Links
    can be lost in two ways, both by chance and both rare at any size: a pair at similarity 0.8 shares no band (below 1 in
    10,000), or its one-bit values differ by more than MOST_BITS, when it is not verified (below 1 in 100,000).
    """
    found, names = numbered(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), id_col)
    signed = cut(sign(found))
    known = signed.where("_id is not null")
    facts = ["weight", *[c for c in signed.columns if c[0] == "b"]]
    texts = known.groupBy("k1", "k2").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in facts])
    texts = cut(texts.withColumn("t", F.monotonically_increasing_id()))
    spread = texts.select("t", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(spread.join(shared, "key"))
    central = members.groupBy("t").agg(F.sum("n").alias("met"))  # who meets most others is likeliest near them all
    ranked = members.join(central, "t")
    leaders = cut(ranked.groupBy("key").agg(F.max_by("t", F.struct("met", -F.col("t"))).alias("leader")))
    bits = [c for c in facts if c[0] == "b" and c != "bands"]
    side = lambda name: texts.select(F.col("t").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ["weight", *bits]])
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in bits), F.lit(0))
    likely = (F.least("a_weight", "b_weight") >= F.greatest("a_weight", "b_weight") * similarity) & (differ <= MOST_BITS)
    met = salted_join(members.select("t", "key"), leaders, "key").where("t <> leader")
    to_leader = cut(met.select(F.col("t").alias("a"), F.col("leader").alias("b")).distinct())
    hot = hot_keys(to_leader, "b")
    first = cut(salted(to_leader, "b", hot).join(side("a"), "a").join(copied(side("b"), "b", hot), ["b", "_salt"]).where(likely).select("a", "b"))
    # rows repeated with one id and different texts share a class
    owners = known.select("_id", "k1", "k2").join(texts.select("k1", "k2", "t"), ["k1", "k2"]).select("_id", "t")
    several = cut(owners.groupBy("_id").agg(F.min("t").alias("b"), F.max("t").alias("z")).where("b <> z").select("_id", "b"))
    again = salted_join(cut(owners.join(bounded_broadcast(several.select("_id")), "_id", "left_semi")), several, "_id").select(F.col("t").alias("a"), "b").where("a <> b").distinct()
    links = cut(verified(first, texts, found, similarity).unionByName(again))
    vertices = cut(members.select("t").unionByName(links.select(F.explode(F.array("a", "b")).alias("t"))).distinct().withColumnRenamed("t", "id"))
    joined = cut(components(vertices, links))
    placed = cut(members.select("t", "key").join(joined.withColumnRenamed("id", "t"), "t"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ = cut(placed.join(split, "key", "left_semi"))
    more = across(open_, texts, found, similarity) if open_.limit(1).count() else None
    if more is not None and more.limit(1).count():
        joined = cut(components(vertices, links.unionByName(more)))
    own = cut(texts.select("t", "k1", "k2", "rep", "copies").join(joined.withColumnRenamed("id", "t"), "t", "left").withColumn("component", F.coalesce("component", "t")))
    least = own.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = cut(salted_join(own, least, "component").select("k1", "k2", "class_id", "copies"))
    found_class = signed.select("_id", "k1", "k2").join(classes, ["k1", "k2"], "left")
    mine = F.col("_id").isNotNull()
    out = found_class.select("_id", F.when(mine, F.col("class_id")).alias("class_id"), F.when(mine, F.col("copies")).otherwise(1).alias("copies"), F.coalesce(F.col("_id") == F.col("class_id"), F.lit(True)).alias("kept"))
    id_type = docs.schema[id_col].dataType
    if names is not None:
        return named(out, ["_id", "class_id"], names).withColumnRenamed("_id", id_col)
    return out.select(F.col("_id").cast(id_type).alias(id_col), F.col("class_id").cast(id_type).alias("class_id"), "copies", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, the one of smallest id; all columns stay as they are.

    Rows repeated with one id stay or go together.
    """
    gone = cut(near_classes(docs, id_col, text_col, similarity).where("not kept").select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(bounded_broadcast(gone, 1_000_000), docs[id_col] == gone["_gone"], "left_anti")
