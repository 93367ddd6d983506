"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every normalised text and counts the cells of a counting Bloom filter; cells set at least twice form a
bitmap. Pass 2 tests every row against the bitmap: a row one of whose cells was set once cannot have a copy and passes
straight through; only the others shuffle on their digest. The filter may say yes too often, never no wrongly, so the
result is exact at any size. Its size is a parameter with a hard upper bound (16 MB by default), which is what makes
broadcasting it safe; on larger inputs more rows shuffle and nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import BROADCAST_ROWS, SPACE, bounded_broadcast, cut, power_of_two, salted_join

BLOCK = 32768  # bits in a bitmap that bitmap_construct_agg builds


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _cells(bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64("text_sha256", F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def repeated_cells(digests: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(block, bitmap) of the cells that two or more rows set; at most bits / 32768 rows of 4 KB."""
    cells = digests.select(F.explode(F.array(*_cells(bits, hashes))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    placed = twice.select(F.floor(F.col("cell") / BLOCK).alias("block"), (F.col("cell") % BLOCK).alias("at"))
    return placed.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 2**27, hashes: int = 2) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty, so null
    and empty texts form one group. The smallest id stays; null ids come after all others; of rows repeated with one id
    and text exactly one is kept. Other columns of docs are not read, so their names cannot clash. An empty table gives
    an empty result. group_size counts rows.
    """
    digests = cut(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("text_sha256")).withColumn("_row", F.monotonically_increasing_id()))
    bits = power_of_two(16 * digests.count(), BLOCK, most_bits)
    bitmaps = F.broadcast(cut(repeated_cells(digests, bits, hashes)))  # most_bits / 8 bytes at most
    tested = digests.withColumn("maybe", F.lit(True))
    for cell in _cells(bits, hashes):
        tested = tested.withColumn("cell", cell).withColumn("block", F.floor(F.col("cell") / BLOCK))
        tested = tested.join(bitmaps, "block", "left").withColumn("maybe", F.col("maybe") & _is_set(F.col("bitmap"), F.col("cell") % BLOCK)).drop("block", "bitmap", "cell")
    tested = cut(tested)
    alone, maybe = tested.where(~F.col("maybe")), tested.where("maybe")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = cut(maybe.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")))
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = maybe.join(F.broadcast(groups), "text_sha256") if few else salted_join(maybe, groups, "text_sha256")
    out = [F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"]
    shuffled = found.withColumns({"keep_id": F.col("first.id"), "kept": F.col("first.row") == F.col("_row")}).select(*out)
    return alone.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out).unionByName(shuffled)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() does not keep; all columns stay as they are."""
    marks = cut(exact_duplicates(docs, id_col, text_col))
    key = [id_col, "text_sha256"]
    gone = cut(marks.where("not kept").select(F.col(id_col).alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"), (F.coalesce(F.col(id_col).eqNullSafe(F.col("keep_id")), F.lit(True))).alias("_same")).distinct())
    hashed = docs.withColumn("_sha", digest(F.col(text_col)))
    match = lambda side: hashed[id_col].eqNullSafe(side["_gone_id"]) & (hashed["_sha"] == side["_gone_sha"])
    others = gone.where("not _same")
    left = hashed.join(bounded_broadcast(others), match(others), "left_anti")
    if gone.where("_same").limit(1).count() == 0:
        return left.drop("_sha")
    again = gone.where("_same").select("_gone_id", "_gone_sha")  # rows repeated with one id and text: one of them stays
    pair = lambda a, b: a[id_col].eqNullSafe(b["_gone_id"]) & (a["_sha"] == b["_gone_sha"])
    single = left.join(again, pair(left, again), "left_anti")
    return single.unionByName(left.join(again, pair(left, again), "left_semi").dropDuplicates([id_col, "_sha"])).drop("_sha")
