"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document, once for each pass over its source that the mix may make, waits in its source's queue. Its
virtual finish time is the words of its source up to and including it, divided by the source's target. As a document may
be long, it is served in fragments, one for each tick of virtual time that it spans, and a fragment finishes with its
tick or its document. The stream is all sources' fragments in order of finish, globally; a prefix sum of words over that
order, by ranges and within a range, truncates it at the total budget. So no source is off its target by more than a tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import NOT_SPACE, bounded_broadcast, cut, running, spread_rank

WEIGHTS = (5, 2, 1)
#: Ticks of virtual time up to 1, when all targets are met: at most, and so that fragments stay within a few times the documents.
MOST_TICKS, LEAST_TICKS = 4096, 16


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside [\\x20\\x09-\\x0D]; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...] = WEIGHTS, passes: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in order of code point, null last, weigh as weights says, repeating; they share `share` of all sizes in
    proportion, no target above passes x its source's size; what is above goes to the others by weight until none is
    above. That is a water level: target = min(cap, weight x level), and the level follows from running sums of the
    sources in order of cap / weight. Sources may be many: no task holds them all.
    """
    source = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = running(source, by_name, {"_place": F.lit(1).cast("long")})
    capped = cut(placed.withColumns({"weight": weight, "cap": F.col("source_size") * float(passes)}).withColumn("ratio", F.col("cap") / F.col("weight")))
    total = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    filling = running(capped, [F.col("ratio"), *by_name], {"_filled": F.col("cap"), "_closed": F.col("weight")})
    level = (F.lit(total["size"] * share) - F.col("_filled")) / (F.lit(total["weight"]) - F.col("_closed"))
    # of sources with one ratio the first, which finds them all open, has the highest level
    first = F.max_by("level", F.struct(-F.col("ratio"), F.col("level"))).alias("level")
    found = filling.withColumn("level", level).where("level <= ratio").agg(first).first()["level"]
    target = F.col("cap") if found is None else F.least("cap", F.col("weight") * F.lit(found))
    return capped.select("source", "source_size", target.alias("target"))


def _shuffled(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, row_col: str | None) -> DataFrame:
    """(row, _id, source, size, _key) of every row; _key: the md5 of seed and id, by which sources are shuffled."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    wanted = [F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("row")]
    return docs.select(*wanted).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary")))


def _fragments(entries: DataFrame, ticks: int) -> DataFrame:
    """A row for each tick that an entry spans: words, finish. Entries without words, or of no target, have one of no words.

    Tick j of a source ends at word floor(target x (j + 1) / ticks); all that lies beyond the last is one more tick.
    """
    border = lambda j: F.floor(F.col("target") * j / ticks).cast("long")
    end = F.col("_start") + F.col("size")
    tick = lambda words: F.least(F.lit(ticks), F.floor(words * ticks / F.col("target"))).cast("int")
    spanned = F.sequence(F.greatest(F.lit(0), tick(F.col("_start")) - 1), F.least(F.lit(ticks), tick(end) + 1))

    def part(j: Column) -> Column:
        last = j == ticks
        upto = F.when(last, end).otherwise(F.least(end, border(j + 1)))
        words = upto - F.greatest(F.col("_start"), border(j))
        return F.struct(words.alias("words"), F.when(last | (border(j + 1) >= end), end / F.col("target")).otherwise((j + 1) / F.lit(float(ticks))).alias("finish"))

    parts = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter(F.transform(spanned, part), lambda p: p["words"] > 0))
    return entries.select("*", F.inline_outer(parts)).withColumn("words", F.coalesce("words", F.lit(0).cast("long")))


def mix_queue(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, passes: int = 2, budget: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """All fragments: (row, id_col, source, size, source_size, target, pass, finish, words, before, taken).

    before: words of the whole stream ahead of the fragment; taken: those of its words that the budget (words in all;
    the sum of the targets, each rounded down, if None) reaches. row tells apart rows repeated with one id. Null texts and
    empty ones have size 0, no words and no finish; null sources form a source of their own, null ids are shuffled like
    the text 'null'; a table without rows or words gives targets 0 and takes nothing. Reruns agree. Other columns are not read.
    """
    sized = cut(_shuffled(docs, seed, id_col, text_col, source_col, row_col))
    goal = cut(targets(sized, share, weights, passes))
    whole = goal.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.floor("target")), F.lit(0)).cast("long").alias("words")).first()
    ticks = int(min(MOST_TICKS, max(LEAST_TICKS, sized.count() // max(1, whole["n"]))))
    named = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    start = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")
    own = [F.col("_key"), F.col("_id"), F.col("size"), F.col("row")]
    queued = spread_rank(named(sized), ["_source"], own, "_start", "size", bucket=start)
    queued = queued.join(bounded_broadcast(named(goal).select("_source", "source_size", "target")), "_source")
    entries = queued.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).withColumn("_start", F.col("_start") + (F.col("pass") - 1) * F.col("source_size"))
    fragments = cut(_fragments(entries, ticks))
    finish = F.coalesce("finish", F.lit(0.0))
    place = F.when(finish <= 1, finish * 40000).otherwise(65535 - 25535 / F.greatest(finish, F.lit(1.0)))  # grows with finish
    ranked = spread_rank(fragments, [], [finish, F.col("pass"), *own], "before", "words", bucket=place)
    left = F.lit(whole["words"] if budget is None else int(budget)) - F.col("before")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), left))
    return ranked.withColumn("taken", taken).select("row", F.col("_id").alias(id_col), "source", "size", "source_size", "target", "pass", "_key", "finish", "words", "before", "taken")


def mix_stream(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """What the budget reaches of mix_queue(), range-sorted by place in the stream: written files follow the mix's order."""
    return mix_queue(docs, id_col=id_col, **options).where("taken > 0").repartitionByRange("before").sortWithinPartitions("before").drop("_key")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", passes: int = 2, **options) -> DataFrame:
    """docs as the mix holds them, with docs' columns, in the mix's order: each document as often as it takes at least half of it.

    Whole documents only: one in service at the cut is kept if at least half its words are in the mix; it stands where
    its last fragment does. Documents without words cost no budget and stay once, ahead of all others. Where ids are
    repeated or null, the table is written once with a number for each row, and each row gets its own copies.
    """
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1)).limit(1).count() > 0
    if repeated:
        docs = cut(docs.withColumn("_mix_n", F.monotonically_increasing_id()))
    queue = mix_queue(docs, id_col=id_col, passes=passes, row_col="_mix_n" if repeated else None, **options)
    entries = queue.groupBy(F.col("row").alias("_mix_row"), F.col(id_col).alias("_mix_id"), "size", "pass").agg(F.sum("taken").alias("taken"), F.max("before").alias("_mix_at"))
    kept = entries.where(((F.col("size") == 0) & (F.col("pass") == 1)) | ((F.col("size") > 0) & (F.col("taken") * 2 >= F.col("size"))))
    kept = cut(kept.select("_mix_row", "_mix_id", F.when(F.col("size") > 0, F.col("_mix_at")).otherwise(-1).alias("_mix_at")))
    same = docs["_mix_n"] == kept["_mix_row"] if repeated else docs[id_col] == kept["_mix_id"]
    order = ["_mix_at", "_mix_row"]
    return docs.join(bounded_broadcast(kept), same).repartitionByRange(*order).sortWithinPartitions(*order).drop("_mix_n", "_mix_row", "_mix_id", "_mix_at")
