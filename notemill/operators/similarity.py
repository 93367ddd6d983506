"""Similarity joins on short strings: pairs whose matching blocks cover enough of both, or one of which stands in the other.

No group is compared pair by pair. Two strings a and b with ratio 2 M / (|a| + |b|) >= r, M characters in matching blocks,
have at most |a| + |b| - 2 M others, so blocks are few and most neighbouring characters stay neighbours: the pair shares a
bigram, and the first one that it shares in any fixed order stands among the first D + 1 of each side's. These prefixes,
rarest bigrams first, and bands of length are the keys of an equi-join. A string that stands as words in another shares
all its words with it; its longest is the key. Only pairs found so are compared exactly.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.session import checkpointed

#: Bigrams that come last in the order of prefixes because most strings have them.
COMMON = 100
#: So many pairs left over are matched in one pass; more take rounds.
TAIL = 100_000


def stands_in(short: str, long: str) -> bool:
    """Whether short is in long with a word border at both of its ends, as \\b is defined."""
    word = lambda i: 0 <= i < len(long) and (long[i].isalnum() or long[i] == "_")
    at = long.find(short) if short else -1
    while at >= 0:
        end = at + len(short)
        if word(at - 1) != word(at) and word(end - 1) != word(end):
            return True
        at = long.find(short, at + 1)
    return False


def block_ratio(a: str, b: str, least: float) -> float:
    """Share of the characters of a and b in matching blocks; 0 where bounds by length and letters show it is below least."""
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0


def gram_size(ratio: float) -> int:
    """2 if unequal strings with this ratio always share a bigram, that is 3 M > |a| + |b| + 1, else 1."""
    for total in range(2, 400):
        m = math.ceil(ratio * total / 2 - 1e-9)
        if m <= (total - 1) // 2 and 3 * m < total + 2:
            return 1
    return 2


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of one or two neighbouring characters; no lambda refers to the text, so it is cut once."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    if size == 1:
        return F.array_distinct(letters)
    return F.array_distinct(F.array_compact(F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), lambda a, b: F.concat(a, b))))


def _prefix(text: Column, ratio: float, common: dict[str, int]) -> Column:
    """The distinct grams of text of which the first that it shares with a similar string is one, in order.

    All of text's grams that a similar string lacks are lost to unmatched characters: an own one costs at most as many
    grams as they are long, one of the other string's between two of its own one less.
    """
    q = gram_size(ratio)
    least = ratio / (2 - ratio)  # length of the shortest similar string, as a share
    lost = q - (2 * q - 1) * ratio / 2 * (1 + least) + (q - 1) * least
    rank = F.create_map(*[F.lit(x) for kv in common.items() for x in kv]) if common else F.create_map().cast("map<string,int>")
    ordered = F.sort_array(F.transform(_grams(text, q), lambda g: F.struct(F.coalesce(F.try_element_at(rank, g), F.lit(0)).alias("n"), F.xxhash64(g).alias("h"), g.alias("g"))))
    return F.slice(F.transform(ordered, lambda x: x["g"]), F.lit(1), (F.floor(F.length(text) * lost + 1e-6) + 1).cast("int"))


def _common(items: DataFrame, ratio: float) -> dict[str, int]:
    """The COMMON most frequent grams and their ranks, the most frequent highest."""
    grams = items.select(F.explode(_grams(F.col("x"), gram_size(ratio))).alias("g"))
    top = grams.groupBy("g").count().orderBy(F.desc("count"), "g").limit(COMMON).collect()
    return {r["g"]: COMMON - i for i, r in enumerate(top)}


def candidates(left: DataFrame, right: DataFrame, by: str, ratio: float = 0.85) -> DataFrame:
    """Distinct pairs (by, l, r) of left and right rows (by, x) that may be similar; every similar pair of unequal strings is one."""
    common = _common(left.unionByName(right), ratio)
    band = F.floor(F.log(F.greatest(F.length("x"), F.lit(1))) / math.log((2 - ratio) / ratio) + 1e-9).cast("int")

    def keyed(df: DataFrame, name: str, **more: Column) -> DataFrame:
        """A side's rows with a hash of the group, the string, its length and further columns."""
        return df.where("x <> ''").select(F.xxhash64(by).alias("_k"), F.col(by).alias(f"_{name}"), F.col("x").alias(name), F.length("x").alias(f"n_{name}"), *[c.alias(k) for k, c in more.items()])

    def prefixed(df: DataFrame, name: str, bands: list[int]) -> DataFrame:
        made = keyed(df.withColumn("_p", _prefix(F.col("x"), ratio, common)), name, **{f"p_{name}": F.col("_p"), "_b": F.array(*[band + b for b in bands])})
        return made.withColumn("_b", F.explode("_b")).withColumn("_g", F.explode(f"p_{name}"))

    same = F.col("_l").eqNullSafe(F.col("_r"))
    near = prefixed(left, "l", [0]).join(prefixed(right, "r", [-1, 0, 1]), ["_k", "_b", "_g"])
    once = F.get(F.array_intersect("p_l", "p_r"), F.lit(0)) == F.col("_g")  # of the grams a pair shares only the first finds it
    near = near.where(same & once & (2 * F.least("n_l", "n_r") >= ratio * (F.col("n_l") + F.col("n_r")) - 1e-9))

    words = F.array_distinct(F.regexp_extract_all("x", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    marks = F.array_distinct(F.regexp_extract_all("x", F.lit(r"(?s)[^\p{L}\p{Nd}]"), F.lit(0)))  # for strings without a word
    inside = [
        keyed(a, s, _w=F.coalesce(longest, F.get(marks, F.lit(0)))).join(keyed(b, t, _w=F.explode(F.concat(words, marks))), ["_k", "_w"]).where(same & (F.col(f"n_{s}") < F.col(f"n_{t}")) & F.contains(F.col(t), F.col(s)))
        for a, s, b, t in ((left, "l", right, "r"), (right, "r", left, "l"))
    ]
    out = lambda df: df.select(F.col("_l").alias(by), "l", "r")
    return out(near).unionByName(out(inside[0])).unionByName(out(inside[1])).where("l <> r").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, by: str, item: str, ratio: float = 0.85) -> DataFrame:
    """(by, l, r, stands, ratio): pairs of unequal items of left and right in one group that are similar.

    stands: the shorter is in the longer between word borders. ratio: the share of characters in matching blocks, 0 where
    it is below the ratio asked for. Null by is a group; null and empty items have no partner. Repeated rows are one.
    """
    if not 0 < ratio <= 1:
        raise ValueError("a ratio is above 0 and at most 1")
    side = lambda df: df.select(by, F.col(item).alias("x")).where("x is not null").distinct()

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            stands = [stands_in(*sorted((a, b), key=len)) for a, b in zip(rows["l"], rows["r"], strict=True)]
            share = [block_ratio(a, b, ratio) for a, b in zip(rows["l"], rows["r"], strict=True)]
            rows = rows.assign(stands=stands, ratio=[x if x >= ratio else 0.0 for x in share])
            yield rows[rows["stands"] | (rows["ratio"] > 0)]

    pairs = candidates(side(left), side(right), by, ratio)
    return pairs.mapInPandas(test, f"`{by}` {pairs.schema[by].dataType.simpleString()}, l string, r string, stands boolean, ratio double")


def matching(pairs: DataFrame, by: str, tail: int = TAIL) -> DataFrame:
    """(by, l, r): each l and each r of a group in at most one pair, greedily in the order of a hash of the pair.

    Pairs that come first for both of their sides are taken in rounds, which end what is left of both; with an order at
    random few rounds are needed (their number grows with the logarithm), and no group is anywhere as a whole. The last
    pairs, at most tail of them, are matched in one pass. Each round is kept in the shared checkpoint folder.
    """
    order = F.struct(F.xxhash64(by, "l", "r"), "l", "r")
    left = checkpointed(pairs.select(F.xxhash64(by).alias("_k"), by, "l", "r", order.alias("_o")))
    taken: list[DataFrame] = []
    while left.limit(tail + 1).count() > tail:
        first = lambda side: left.groupBy("_k", by, side).agg(F.min("_o").alias("_o")).select("_k", by, "_o")  # noqa: B023, E731
        won = checkpointed(first("l").intersect(first("r")).select("_k", by, F.col("_o.l").alias("l"), F.col("_o.r").alias("r")))
        taken.append(won.select(by, "l", "r"))
        for side in ("l", "r"):
            gone = won.select("_k", F.col(by).alias("_by"), F.col(side).alias("_x"))
            left = left.join(gone, (left["_k"] == gone["_k"]) & left[by].eqNullSafe(gone["_by"]) & (left[side] == gone["_x"]), "left_anti")
        left = checkpointed(left)

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        used: tuple[set, set] = (set(), set())
        keep = []
        for a, b in zip(rows["l"], rows["r"], strict=True):
            keep.append(a not in used[0] and b not in used[1])
            if keep[-1]:
                used[0].add(a)
                used[1].add(b)
        return rows[keep]

    kind = left.schema[by].dataType.simpleString()
    ranked = left.select(by, "l", "r", F.col("_o.col1").alias("h"))
    last = ranked.groupBy(by).applyInPandas(lambda rows: greedy(rows.sort_values(["h", "l", "r"])[[by, "l", "r"]]), f"`{by}` {kind}, l string, r string")
    for won in taken:
        last = last.unionByName(won)
    return last
