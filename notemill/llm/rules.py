"""Quality rules: word statistics of whole texts, and ordered rules over them learned by sequential covering.

Everything is DataFrame functions. Statistics are computed once per text, in one narrow pass; learning only ever
aggregates the narrow table of labelled statistics, of which the driver sees counts per value (at most 10,001 values a
feature), so every labelled row takes part whatever their number. A rule is a conjunction of thresholds; a list of rules
becomes one conditional expression, which codegen evaluates in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import NOT_SPACE, SPACE, cut, salted_join

SYMBOLS = "#*$%&|<>"
#: Largest value of a feature; what is above counts as this.
TOP = 10_000
#: Word positions share a long with the upper bits of their window's hash. Texts of more words skip that sieve.
PLACE_BITS = 24
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct"]


def _permille(part: Column, whole: Column) -> Column:
    return F.least(F.lit(TOP), F.coalesce(F.floor(1000 * part / F.nullif(whole, F.lit(0))), F.lit(0))).cast("int")


def features() -> dict[str, Column]:
    """Integer features in [0, TOP] from the columns COUNTS; 0 where there is nothing to divide by."""
    c = {k: F.col(k) for k in COUNTS}
    return {
        "words": F.least(F.lit(TOP), c["n_words"]).cast("int"),
        "symbols": _permille(c["n_symbols"], c["n_words"]),
        "dup_lines": _permille(c["n_dup_lines"], c["n_lines"]),
        "repeats": _permille(c["n_repeat_words"], c["n_words"]),
        "upper": _permille(c["n_upper"], c["word_chars"]),
        "marks": _permille(c["n_marks"], c["n_words"]),
        "digits": _permille(c["n_digits"], c["word_chars"]),
        "distinct": _permille(c["n_distinct"], c["n_words"]),
        "length": F.least(F.lit(TOP), F.coalesce(F.floor(100 * c["word_chars"] / F.nullif(c["n_words"], F.lit(0))), F.lit(0))).cast("int"),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, wherever the optimiser puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _equal_neighbour(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Places j of the sorted array items whose item equals the one before or after."""
    places = F.when(F.size(items) > 1, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda j: F.get(items, j)
    return F.filter(places, lambda j: F.coalesce(same(at(j), at(j - 1)), F.lit(False)) | F.coalesce(same(at(j), at(j + 1)), F.lit(False)))


def _repeat_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more.

    Hashes of windows, sorted with their places, tell which may; those are compared as words. No lambda refers to a column,
    so that moving the expression (into a filter, say) never computes an array once an element.
    """
    mask, high = (1 << PLACE_BITS) - 1, lambda x: F.shiftright(x, PLACE_BITS)
    windows = F.slice(F.arrays_zip(words.alias("x"), F.slice(words, 2, F.size(words)).alias("y"), F.slice(words, 3, F.size(words)).alias("z")), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashed = F.transform(windows, lambda v, i: F.xxhash64(v).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

    def covered(both: Column) -> Column:
        words, hashes = both["words"], both["hashes"]
        sieved = F.transform(_equal_neighbour(hashes, lambda a, b: high(a) == high(b)), lambda j: F.get(hashes, j).bitwiseAND(F.lit(mask)).cast("int"))
        every = F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
        maybe = F.when(F.size(words) <= mask, sieved).otherwise(every)
        named = F.sort_array(F.transform(maybe, lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(3)]).alias("t"), i.alias("i"))))
        twice = _let(named, lambda n: F.transform(_equal_neighbour(n, lambda a, b: a["t"] == b["t"]), lambda j: F.get(n, j)["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return _let(F.struct(words.alias("words"), F.sort_array(hashed).alias("hashes")), covered)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and COUNTS (long) of every row of docs; a null text has no words and no lines.

    n_words, word_chars (code points in words), n_symbols (#*$%&|<>), n_lines and n_dup_lines (\\n-split lines with a
    word, and those equal to an earlier one), n_repeat_words (words in three-word windows that occur twice or more in the
    text, first occurrences included), n_upper (upper-case letters), n_marks (! and ?), n_digits, n_distinct (words).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    less = lambda drop: (F.length("_t") - F.length(F.translate("_t", drop, ""))).cast("long")
    found = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), lines.alias("_lines"), F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0)).alias("_w"))
    found = found.select(
        "_id",
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        less("!?").alias("n_marks"),
        less("0123456789").alias("n_digits"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )
    return found.select(F.col("_id").alias(id_col), *COUNTS)


@dataclass(frozen=True)
class Rule:
    """All of conditions (feature, above, threshold) hold; hits and misses: labelled rows held out from growing it."""

    conditions: tuple[tuple[str, bool, int], ...]
    hits: int = 0
    misses: int = 0

    def column(self) -> Column:
        return _all(self.conditions)

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t}" for f, above, t in self.conditions)


def _all(conditions) -> Column:
    out = F.lit(True)
    for f, above, t in conditions:
        out = out & (F.col(f) > t if above else F.col(f) <= t)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression over the feature columns: false at the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(counts: dict[str, list[tuple[int, int, int]]], p0: int, n0: int, least: int) -> tuple[str, bool, int] | None:
    """The threshold of most information gain; counts: feature -> (value, poor, good) ascending. Ties: the first."""
    best, found = 1e-9, None
    for f, values in sorted(counts.items()):
        p = n = 0
        for (value, poor, good), (after, _, _) in zip(values, values[1:], strict=False):
            p, n = p + poor, n + good
            middle = (value + after) // 2  # between two seen values, the margin is the same on both sides
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a >= least and (gain := _gain(a, b, p0, n0)) > best:
                    best, found = gain, (f, above, middle)
    return found


def learn(labelled: DataFrame, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """Ordered rules that tell poor rows of labelled: columns _poor (0 or 1), _prune (boolean) and those of features().

    Sequential covering: a rule grows on two thirds of the rows no rule covers yet, a threshold at a time by information
    gain, until it covers no good row or has most_conditions; it is pruned to the prefix that is best on the other third,
    (poor - good) / (poor + good), the shorter of equal ones. It is taken if (poor + 1) / (poor + good + 2) of all rows it
    covers is at least 1 - 2 (1 - precision) and, of the held-out ones, poor / (poor + good) at least precision; rows it
    covers are left out from then on. Without poor or good rows there are no rules. All labelled rows count.
    """
    names = sorted(features())
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in names]))
    rules: list[Rule] = []
    left = F.lit(True)
    poor, good = F.sum("_poor"), F.sum(1 - F.col("_poor"))

    def tally(rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
        got = rows.select("_poor", pairs.alias("x")).groupBy("x.feature", "x.value").agg(poor.alias("p"), good.alias("n")).collect()
        out: dict[str, list[tuple[int, int, int]]] = {}
        for r in sorted(got, key=lambda r: (r["feature"], r["value"])):
            out.setdefault(r["feature"], []).append((r["value"], r["p"], r["n"]))
        return out

    while len(rules) < most_rules:
        conditions: list[tuple[str, bool, int]] = []
        rest = labelled.where(left)
        while len(conditions) < most_conditions:
            counts = tally(rest.where(~F.col("_prune")).where(_all(conditions)))
            p0, n0 = (sum(x[i] for x in next(iter(counts.values()), [])) for i in (1, 2))
            if not p0 or not n0 or (new := _best_condition(counts, p0, n0, least)) is None:
                break
            conditions.append(new)
        if not conditions:
            return rules
        sums = [F.sum(F.when(_all(conditions[:k]) & c, x)) for k in range(1, len(conditions) + 1) for c in (F.col("_prune"), F.lit(True)) for x in (F.col("_poor"), 1 - F.col("_poor"))]
        row = [x or 0 for x in rest.select(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        held = [tuple(row[4 * k : 4 * k + 4]) for k in range(len(conditions))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n, _, _ in held]
        k = worth.index(max(worth))
        p, n, all_p, all_n = held[k]
        if p == 0 or p < precision * (p + n) or (all_p + 1) / (all_p + all_n + 2) < 1 - 2 * (1 - precision):
            return rules
        rules.append(Rule(tuple(conditions[: k + 1]), p, n))
        left = left & ~rules[-1].column()
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """(one row per row of docs: id_col, COUNTS, features, base_failed and kept; the rules learned from labels).

    kept is false where base_failed is, else what the rules say. Rules are learned from all labelled rows of docs that
    the base rules pass; label_col 0 is poor, any other value good. Of several labels of one id the least counts; null ids
    and null labels are no labels. Rows repeated with one id each count. A third of the rows, by a hash of the id, is held
    out for pruning. Without labels nothing but the base rules rejects. Other columns of docs are not read.
    """
    made = features()
    stats = statistics(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text")
    stats = cut(stats.withColumns(made).withColumn("base_failed", base_failed()))
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(F.min(label_col).alias("_label"))
    rows = stats.where("not base_failed and _doc is not null").select("_doc", *made)
    known = cut(salted_join(rows, marks, "_doc").select(*made, (F.col("_label") == 0).cast("int").alias("_poor"), (F.pmod(F.xxhash64("_doc"), F.lit(3)) == 0).alias("_prune")))
    rules = learn(known)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumnRenamed("_doc", id_col), rules


def drop_by_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs without the rows that the base rules or the rules given reject; all columns stay as they are."""
    rows = statistics(docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text").withColumns(features())
    return rows.where(~base_failed() & verdict(rules)).select("_doc.*")
