"""Cohorts: coverage, complexity, strata, samples, splits and exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.config import Settings
from notemill.functions import lexicons, text


#: A side of a join is broadcast only if it has no more rows than this.
BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_in(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def keep_out(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among ids; a null key is dropped, as NOT IN drops it."""
    return df.where(F.col(on).isNotNull()).join(ids.select(on), on, "left_anti")


def mentions(body: Column, group: Column, patterns: Mapping[str, str]) -> Column:
    """How often the pattern of the row's group occurs; 0 for an unknown group."""
    counted = F.lit(0)
    for name, pattern in patterns.items():
        counted = F.when(group == name, text.count(body, pattern)).otherwise(counted)
    return counted


def coverage(n: Column) -> Column:
    return F.when(n == 0, "zero").when(n <= 2, "minimal").otherwise("adequate")


def histogram(df: DataFrame, value: str, edges: Sequence[int], over: str) -> DataFrame:
    """Rows by half-open bin [a, b), and those from the last edge on as `over`."""
    label, low = F.lit(over), F.lit(edges[-1])
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        inside = (F.col(value) >= a) & (F.col(value) < b)
        label, low = F.when(inside, f"{a}-{b - 1}" if b - a > 1 else str(a)).otherwise(label), F.when(inside, a).otherwise(low)
    return df.withColumns({"bin": label, "low": low}).groupBy("bin", "low").agg(F.count("*").alias("n"))


def described(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median, least, most and sample deviation (0 for a single row), to one decimal."""
    dev = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 1).alias("mean"), F.round(F.median(value), 1).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(dev, 1).alias("deviation"))


def complexity(counts: Mapping[str, Column], present: Mapping[str, Column], size: Column) -> Column:
    """2 negations + 3 pending + 2 differentials + medications div 5 + 10 for each present + 5 and 3 by length."""
    score = counts["negations"] * 2 + counts["pending"] * 3 + counts["differentials"] * 2 + F.floor(counts["medications"] / 5)
    for p in present.values():
        score = score + F.when(p, 10).otherwise(0)
    return (score + F.when(size > 15000, 5).otherwise(0) + F.when(size > 10000, 3).otherwise(0)).cast("long")


def size_bin(size: Column) -> Column:
    return F.when(size < 8000, "short").when(size < 20000, "medium").otherwise("long")


def token_budget(size: Column) -> Column:
    return F.when(size < 15000, 16384).when(size < 30000, 24576).when(size < 45000, 32768).otherwise(49152)


def error_class(message: Column) -> Column:
    """token_overflow if the message has one of the marks of an exceeded limit, else error; ok for none."""
    return F.when(message.isNull() | (message == ""), "ok").when(F.lower(message).rlike(lexicons.OVERFLOW), "token_overflow").otherwise("error")


def top_per_stratum(df: DataFrame, strata: Mapping[str, Column], order: Sequence[Column], n: int, prefer: Column | None = None) -> DataFrame:
    """The first n rows of each stratum; a row may be in several. Preferred rows come first, others fill up.

    Each stratum's rows are ranked in a window over rows pre-cut to n in each of 64 hash parts, so a stratum with most rows is
    not ordered in one task.
    """
    named = F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in strata.items()]), lambda x: x.isNotNull())
    rows = df.withColumn("stratum", F.explode(named)).withColumn("_preferred", F.lit(0) if prefer is None else F.when(prefer, 0).otherwise(1))
    return first_rows(rows, ["stratum"], [F.col("_preferred"), *order], F.lit(n)).drop("_preferred")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: Column, parts: int = 64, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key: first within hash parts of it, so that no key is ordered whole in one task."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if not c.startswith("_")]), F.lit(parts))
    local = rows.withColumn("_part", part).withColumn("_most", most)
    local = local.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where("_n <= _most")
    return local.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"{rank} <= _most").drop("_part", "_n", "_most")


def stratified(df: DataFrame, keys: Sequence[str], quota: DataFrame, order: Sequence[Column]) -> DataFrame:
    """quota rows (keys, quota) of each stratum, in an order that should be a hash of the row's id."""
    return first_rows(df.join(bounded_broadcast(quota), list(keys)), keys, order, F.col("quota"))


def anchored(df: DataFrame, anchors: DataFrame, on: str, keys: Sequence[str], quota: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The anchors (rows of df whose `on` is in anchors; all of them), and quota rows of each stratum from the others; with `anchor`."""
    fixed = keep_in(df, anchors, on).withColumns({"anchor": F.lit(True), "rank": F.lit(0)})
    others = stratified(df.join(anchors.select(on), on, "left_anti"), keys, quota, order)
    return fixed.unionByName(others.withColumn("anchor", F.lit(False)).select(*df.columns, "anchor", "rank"))


def smoke(df: DataFrame, order: Sequence[Column], n: int = 3) -> DataFrame:
    """A few rows to try things on: the first n in an order that should be a hash of the row's id."""
    return df.orderBy(*order).limit(n)


def with_flag(df: DataFrame, term: str, flag: str, value: int = 1) -> DataFrame:
    """The distinct terms that are marked with the value."""
    return df.where((F.col(flag) == value) & F.col(term).isNotNull()).select(term).distinct()


def filled_from_neighbours(df: DataFrame, class_col: str, bin_col: str, quota: Mapping[str, int], neighbours: Mapping[str, Sequence[str]], order: Sequence[Column]) -> DataFrame:
    """quota[bin] rows of each class and bin; a bin with too few takes rows that no bin has picked from its neighbours.

    The bins fill in the order given, each from rows not picked before, so a row is picked once. Every bin's rows go in
    one order, whoever takes them: so a pass ranks them, as far as all quotas together reach, and who gets which ranks
    follows from the number of rows of each class and bin.
    """
    names = list(dict.fromkeys([b for target in quota for b in (target, *neighbours.get(target, ()))]))
    ranked = first_rows(df.where(F.col(bin_col).isin(names)), [class_col, bin_col], order, F.lit(sum(quota.values())), rank="_rank")
    counts = ranked.groupBy(F.col(class_col).alias("_class"), F.col(bin_col).alias("_bin")).agg(F.max("_rank").alias("_n"))

    def dealt(rows: pd.DataFrame) -> pd.DataFrame:  # one class: a row a bin
        left, out = dict(zip(rows["_bin"], rows["_n"], strict=True)), []
        used = dict.fromkeys(left, 0)
        for target, wanted in quota.items():
            for b in (target, *neighbours.get(target, ())):
                take = min(wanted, left.get(b, 0) - used.get(b, 0))
                if take > 0:
                    out.append((rows["_class"].iloc[0], b, used[b], used[b] + take, target))
                    used[b], wanted = used[b] + take, wanted - take
        return pd.DataFrame(out, columns=["_class", "_bin", "_from", "_to", "picked_for"])

    kinds = f"_class {df.schema[class_col].dataType.simpleString()}, _bin {df.schema[bin_col].dataType.simpleString()}"
    shares = counts.groupBy("_class").applyInPandas(dealt, f"{kinds}, _from int, _to int, picked_for string")
    mine = F.col(class_col).eqNullSafe(F.col("_class")) & (F.col(bin_col) == F.col("_bin")) & (F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to"))
    got = ranked.join(bounded_broadcast(shares), mine).withColumn("rank", F.row_number().over(Window.partitionBy(class_col, "picked_for").orderBy(F.col(bin_col) != F.col("picked_for"), "_rank")))
    return got.select(*df.columns, "rank", "picked_for")


def configured(df: DataFrame, settings: Settings, class_col: str, size: Column, order: Sequence[Column], on: str) -> DataFrame:
    """A sample as the settings say, with bin, anchor, rank and split.

    Rows get a bin by settings.size_bins (upper borders, what is above is `long`); rows whose `on` is an anchor are all in,
    and of the others settings.quotas[class][bin] of each class and bin, in the order; of each class validation_share go
    to the validation part. order: text columns, the first a hash of the id; settings.seed belongs in it (seeded()).
    """
    borders = sorted(settings.size_bins.items(), key=lambda kv: kv[1])
    label = F.lit("long")
    for name, border in reversed(borders):
        label = F.when(size < border, name).otherwise(label)
    binned = df.withColumn("bin", label)
    spark = df.sparkSession
    quota = spark.createDataFrame([(c, b, n) for c, bins in settings.quotas.items() for b, n in bins.items()], f"{class_col} string, bin string, quota int")
    anchors = spark.createDataFrame([(a,) for a in settings.anchors], "_anchor string").select(F.col("_anchor").cast(df.schema[on].dataType).alias(on))
    taken = anchored(binned, anchors, on, [class_col, "bin"], quota, order)
    return split(taken, class_col, order, settings.validation_share)


def seeded(id_col: Column, settings: Settings) -> Column:
    """A hash of the id that is another for each seed."""
    return F.md5(F.concat(F.lit(f"{settings.seed}:"), id_col.cast("string")).cast("binary"))


def shortages(df: DataFrame, keys: Sequence[str], quota: DataFrame) -> DataFrame:
    """Strata that have fewer rows than their quota."""
    have = df.groupBy(*keys).agg(F.count("*").alias("n_available"))
    return quota.join(have, list(keys), "left").na.fill(0, ["n_available"]).where("n_available < quota")


def split(df: DataFrame, class_col: str, order: Sequence[Column], share: float = 0.1) -> DataFrame:
    """'validation' for the first max(1, floor(n x share)) rows of each class in the order, 'train' for the others.

    order: text columns, the first of them a hash in hexadecimal. Rows are counted by class and the hash's first four digits;
    running counts over those (65,536 a class at most) say which digits lie before the border, and only the rows of the
    border's own digits are ordered in a window.
    """
    part = F.substring(order[0], 1, 4)
    dealt = df.withColumn("_part", part)
    counts = dealt.groupBy(class_col, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(class_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(class_col)
    many = F.greatest(F.lit(1).cast("long"), F.floor(F.sum("_n").over(all_of) * share))
    borders = counts.withColumns({"_ahead": F.coalesce(F.sum("_n").over(ahead), F.lit(0).cast("long")), "_many": many})
    placed = dealt.join(borders, [class_col, "_part"])
    rank = F.row_number().over(Window.partitionBy(class_col, "_part").orderBy(*order))
    return placed.withColumn("split", F.when(F.col("_ahead") + rank <= F.col("_many"), "validation").otherwise("train")).drop("_part", "_n", "_ahead", "_many")


def overlaps(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """How many keys two parts share, for each pair of parts."""
    members = None
    for name, df in parts.items():
        one = df.select(F.col(key), F.lit(name).alias("part")).distinct()
        members = one if members is None else members.unionByName(one)
    names = sorted(parts)
    sets = members.groupBy(key).agg(F.collect_set("part").alias("s"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = sets.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}&{b}") for a, b in pairs])
    return counts.select(F.explode(F.create_map(*[x for a, b in pairs for x in (F.lit(f"{a}&{b}"), F.col(f"`{a}&{b}`"))])).alias("pair", "n_shared"))


def first_reason(rules: Sequence[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first rule that holds."""
    reason = F.lit(otherwise)
    for name, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return reason


def failed(lists: Sequence[Column], note: Column, sentinel: str = "ERRO") -> Column:
    """All lists empty, or a text that begins with the sentinel."""
    return (F.size(F.flatten(F.array(*lists))) == 0) | F.coalesce(F.startswith(note, F.lit(sentinel)), F.lit(False))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """old with rows replaced by new ones of the same key; keys that old does not have are ignored.

    Of several new rows of a key the one with the highest version stays.
    """
    if version:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
        new = new.withColumn("_n", last).where("_n = 1").drop("_n", version)
    new = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key], F.lit(True).alias("_hit"))
    joined = old.join(new, key, "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in new.columns else F.col(c)
    return joined.select(F.col(key), *[value(c) for c in old.columns if c != key])


def with_default(df: DataFrame, facts: DataFrame, on: str, defaults: Mapping[str, object]) -> DataFrame:
    """facts' columns beside each row, defaults where there is none."""
    return df.join(facts, on, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
