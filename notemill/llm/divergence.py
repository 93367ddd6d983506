"""Source divergence audit: how far the word shares of the sources of one language are from each other.

Terms are counted per language and source in one pass with counts combined before the shuffle. For a pair of sources the
terms are not compared one by one: pairs that share a term are tallied to a joint histogram, how many terms have which
(count, count), and the cells with a zero follow from each source's own histogram, so terms that only one of the two has,
or neither, are never joined. The divergence evaluates its function once a cell, times the cell's terms.

Pairs of sources are what the audit returns; a join only ever pairs sources that share a term, in equi-joins that AQE can
split. Numbers are longs and decimals: exact at any size.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.common import _stored, bounded_broadcast, cut, ensure_checkpoint_dir, map_texts, remove

#: Distinct (source, term) that a task counts before it hands them on.
HELD = 300_000
#: Bytes of a term stand for themselves, A-Z for a-z, all others for a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold the term), summed; null text, lang, source count as ''.

    Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in the whole text, with only A-Z lower-cased.
    """

    def run(batches: Iterable) -> Iterator:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            terms, n, docs = [], [], []
            for seen, held in found.values():
                terms += seen
                n += seen.values()
                docs += map(held.__getitem__, seen)
            group = pa.array(np.repeat(np.arange(len(found)), np.array([len(seen) for seen, _ in found.values()], np.int64)))
            names = [pa.array([key[k] for key in found], pa.string()).take(group) for k in range(2)]
            found.clear()
            return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seen, held = found.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode().translate(_TERM_BYTES).split(b" ") if text else []
                seen.update(words)
                held.update(set(words))
                seen.pop(b"", None)
                if sum(len(x[0]) for x in found.values()) > HELD:
                    yield out()
        yield out()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("_text", text_col), ("lang", lang_col), ("source", source_col))])
    made = map_texts(rows, run, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint_histograms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, count_a, count_b, terms) with a < b: how many of the terms of a language have these counts in the groups a and b.

    counts: gid, lang, term, n > 0; groups: gid, lang, vocabulary (terms of the language). Both are stored tables. All
    vocabulary terms are in the cells, those with a zero on either side or both as well: first each group's own
    histogram counts as if the other had none of its terms, and neither any other term; then the shared terms, which the
    join finds, move from there to their own cells.
    """
    side = lambda x: counts.select(F.col("gid").alias(x), "lang", "term", F.col("n").alias(f"count_{x}"))
    shared = side("a").join(side("b"), ["lang", "term"]).where("a < b").groupBy("a", "b", "count_a", "count_b").agg(F.count("*").alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("count_a"), b.alias("count_b"), m.alias("m"))
    a, b, m = F.col("count_a"), F.col("count_b"), F.col("m")
    moved = shared.select("a", "b", F.inline(F.array(cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))))
    own = cut(counts.groupBy("gid", "n").agg(F.count("*").alias("m")))
    sizes = bounded_broadcast(cut(groups.join(own.groupBy("gid").agg(F.sum("m").alias("size")), "gid", "left").select("gid", "lang", "vocabulary", F.coalesce("size", zero).alias("size"))))
    one = lambda x: sizes.select(F.col("gid").alias(x), "lang", "vocabulary", F.col("size").alias(f"size_{x}"))
    pairs = cut(one("a").join(one("b").drop("vocabulary"), "lang").where("a < b"))
    lone = lambda x: pairs.select("a", "b").join(own.withColumnRenamed("gid", x), x)
    cells = moved.unionByName(lone("a").select("a", "b", F.col("n").alias("count_a"), zero.alias("count_b"), "m"))
    cells = cells.unionByName(lone("b").select("a", "b", zero.alias("count_a"), F.col("n").alias("count_b"), "m"))
    cells = cells.unionByName(pairs.select("a", "b", zero.alias("count_a"), zero.alias("count_b"), (F.col("vocabulary") - F.col("size_a") - F.col("size_b")).alias("m")))
    # cells that sum to nothing still say that the pair is there, for a language without a vocabulary
    return cells.groupBy("a", "b", "count_a", "count_b").agg(F.sum("m").alias("terms"))


def share(count: Column, total: Column, vocabulary: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * vocabulary)); 0 where there is no vocabulary."""
    whole = lambda x: x.cast("decimal(20,0)")
    parts = F.call_function("div", F.lit(scale).cast("decimal(12,0)") * whole(count + smoothing), F.nullif(whole(total + smoothing * vocabulary), F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(1 + parts, F.lit(0).cast("long"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, smoothing: int = 5, scale: int = 1_000_000_000, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs.

    A language keeps the terms that at least least_docs of its documents hold; every source of it, and the language as a
    whole, gives each kept term a share (see share()). Part `pair`: each other source of the language, with the summed
    absolute differences of the shares of all kept terms. Part `term`: the top kept terms that the source holds with a
    share above the language's, and by how much. Ranks go by value, largest first, then item by UTF-8. Null text, lang
    and source count as ''; a group without terms is in; a language without kept terms has pairs of value 0; an empty
    table gives an empty result. The result is stored, of sources times sources of a language, and its parts removed.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/divergence-{uuid.uuid4().hex}"
    of_term = Window.partitionBy("lang", "term")
    seen = term_counts(docs, text_col, lang_col, source_col)
    seen = seen.withColumns({"held": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    named = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    named = _stored(named.withColumn("gid", F.monotonically_increasing_id()), f"{folder}/named")
    kept = seen.where(F.col("held") >= least_docs).join(bounded_broadcast(named), ["lang", "source"])
    kept = _stored(kept.select("gid", "lang", "term", "n", "total", "first"), f"{folder}/kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("first"), 1)).alias("vocabulary"))
    sums = kept.groupBy("gid").agg(F.sum("n").alias("group_total"))
    zero = F.lit(0).cast("long")
    groups = named.join(bounded_broadcast(cut(langs)), "lang", "left").join(bounded_broadcast(cut(sums)), "gid", "left")
    groups = _stored(groups.select("gid", "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("lang_total", "vocabulary", "group_total")]), f"{folder}/groups")
    few = bounded_broadcast(groups)
    share_of = lambda count, total: share(count, total, F.col("vocabulary"), smoothing, scale)

    total = lambda x: few.select(F.col("gid").alias(x), "vocabulary" if x == "a" else F.col("vocabulary").alias("_same"), F.col("group_total").alias(f"total_{x}"))
    cells = joint_histograms(kept, groups).join(total("a"), "a").join(total("b"), "b")
    apart = F.abs(share_of(F.col("count_a"), F.col("total_a")) - share_of(F.col("count_b"), F.col("total_b")))
    values = cells.groupBy("a", "b").agg(F.sum(apart.cast("decimal(20,0)") * F.col("terms")).cast("long").alias("value"))
    values = values.select("value", F.inline(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other")), F.struct(F.col("b").alias("gid"), F.col("a").alias("other")))))
    item = few.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = values.join(item, "other").select("gid", F.lit("pair").alias("part"), "item", "value")

    above = share_of(F.col("n"), F.col("group_total")) - share_of(F.col("total"), F.col("lang_total"))
    terms = kept.drop("lang").join(few.drop("lang", "source"), "gid").select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), above.alias("value")).where("value > 0")
    by = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
    found = cut(ranked.join(few, "gid").select("lang", "source", "part", "item", "value", "rank"))
    remove(spark, folder)
    return found
