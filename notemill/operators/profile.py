"""Profiles of note tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators.cohort import bounded_broadcast
from notemill.session import checkpointed


def length_stats(df: DataFrame, size: Column) -> DataFrame:
    """Least, mean (truncated to a whole number), median and most."""
    return df.agg(F.min(size).alias("least"), F.avg(size).cast("int").alias("mean"), F.median(size).alias("median"), F.max(size).alias("most"))


def medians(df: DataFrame, by: str, value: str, slack: float = 0.002, parts: int = 4096) -> DataFrame:
    """(by, median), exact, of a column of many distinct values: no group's values meet in one buffer or task.

    A sketch gives two values between which the median lies. What lies between is counted in `parts` ranges of equal
    width, which says in which one or two of them the middle rows are and how far in; only the distinct values of these
    are ranked, some 2 x slack / parts of a group. Its two middle rows are averaged. Nulls do not count; a group of nulls
    only has none. by must not be null.
    """
    known = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    around = F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], int(4 / slack))
    borders = known.groupBy(by).agg(around.alias("_b"), F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = F.col("_n") * slack < 4  # too few for the sketch's error to fit in
    borders = checkpointed(borders.select(by, "_n", F.when(few, F.col("_least")).otherwise(F.col("_b")[0]).alias("_low"), F.when(few, F.col("_most")).otherwise(F.col("_b")[1]).alias("_high")))
    width = F.col("_high") - F.col("_low")
    part = F.when((width > 0) & (width < float("inf")), F.least(F.lit(parts - 1), F.floor((F.col("_v") - F.col("_low")) / width * parts)).cast("int")).otherwise(0)
    near = known.join(bounded_broadcast(borders), by).where("_v <= _high").withColumn("_part", F.when(F.col("_v") < F.col("_low"), -1).otherwise(part))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # parts + 1 rows a group at most
    counts = near.groupBy(by, "_n", "_part").agg(F.count("*").alias("_k")).withColumn("_ahead", F.coalesce(F.sum("_k").over(ahead), F.lit(0).cast("long")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    holds = lambda rank: (F.col("_ahead") < rank) & (rank <= F.col("_ahead") + F.col("_k"))
    chosen = checkpointed(counts.where(holds(low) | holds(high)).select(by, "_part", "_ahead"))  # two rows a group at most
    values = near.join(bounded_broadcast(chosen), [by, "_part"]).groupBy(by, "_n", "_part", "_ahead", "_v").agg(F.count("*").alias("_k"))
    upto = F.col("_ahead") + F.sum("_k").over(Window.partitionBy(by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    return ranked.groupBy(by).agg(((at(low) + at(high)) / 2).alias("median"))


def row_dicts(df: DataFrame, rows: int = 100_000) -> Iterator[dict]:
    """The rows of an export as dictionaries, partition by partition; more than `rows` are refused."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows: stay in DataFrames")
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def share(flag: Column) -> Column:
    """Per cent of rows for which flag holds, to one decimal."""
    return F.round(F.count_if(flag) / F.count("*") * 100, 1)


def shares(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    counted = [F.count("*").alias("n"), *[share(c).alias(f"pct_{k}") for k, c in flags.items()]]
    return df.groupBy(*by).agg(*counted) if by else df.agg(*counted)


def top_values(df: DataFrame, value: str, n: int, name: str = "n") -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias(name)).orderBy(F.desc(name), value).limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by a key: files have no order of their own."""
    return df.orderBy(*order).limit(n)


def extremes(df: DataFrame, size: str, tiebreak: str) -> DataFrame:
    """The longest and the shortest row."""
    row = lambda agg, kind: df.agg(agg.alias("r")).select(F.lit(kind).alias("kind"), "r.*")
    longest = F.max_by(F.struct(tiebreak, size), F.struct(F.col(size), -F.col(tiebreak)))
    shortest = F.min_by(F.struct(tiebreak, size), F.struct(F.col(size), F.col(tiebreak)))
    return row(longest, "longest").unionByName(row(shortest, "shortest"))


def correlations(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Pearson correlation of each two flags, in one pass; null where a flag has one value only."""
    names = list(flags)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    numbers = df.select(*[c.cast("int").alias(k) for k, c in flags.items()])
    wide = numbers.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def frequent_words(df: DataFrame, body: Column, stop: Sequence[str], n: int, longer_than: int = 2) -> DataFrame:
    """The n most frequent words of letters a-z, without stop words and short ones."""
    words = F.split(F.regexp_replace(F.lower(body), r"[^a-z\s]", ""), r"\s+")
    each = df.select(F.explode(words).alias("word")).where((F.length("word") > longer_than) & ~F.col("word").isin(list(stop)))
    return top_values(each, "word", n)


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)


def sensitivity(df: DataFrame, alert: Column, truth: Column) -> DataFrame:
    """How many true rows there are, how many of them the alert has, and their share in per cent."""
    return df.agg(F.count_if(truth).alias("n_true"), F.count_if(truth & alert).alias("n_found")).withColumn("sensitivity", F.round(F.try_divide(F.col("n_found"), F.col("n_true")) * 100, 1))


def agreement(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters, and the share on which they agree; null where chance explains all."""
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    chance = rows.join(cols, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("expected"))
    if not by:  # one row each, side by side
        both = total.select("n", "same", F.lit(None).cast("long").alias("expected")).unionByName(chance.select(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("same"), F.col("expected").cast("long")))
        joined = both.agg(*[F.max(c).alias(c) for c in ("n", "same", "expected")])
    else:
        joined = total.join(chance, list(by))
    observed, expected = F.col("same") / F.col("n"), F.col("expected") / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", F.round(observed, 4).alias("agreement"), F.round(F.try_divide(observed - expected, 1 - expected), 4).alias("kappa"))
