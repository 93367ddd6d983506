"""Scores of predicted entity sets against reviewed ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.operators import similarity


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 to four decimals; all 1 where both sides are empty, 0 where a part has no ground."""
    nothing = (tp + fp + fn) == 0
    p = F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    r = F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    f = F.when(nothing, 1.0).otherwise(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)}


def matched(gold: DataFrame, predicted: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Distinct items of each group and whether gold (g) and prediction (p) have them.

    Only groups of records that were predicted belong in gold; give it restricted to them.
    """
    side = lambda df, name: df.select(*by, item, F.lit(1).alias(name)).distinct()
    return side(gold, "g").join(side(predicted, "p"), [*by, item], "full_outer")


def set_scores(gold: DataFrame, predicted: DataFrame, by: Sequence[str], item: str, pooled_over: Sequence[str] = ()) -> DataFrame:
    """Exact scores by group. pooled_over: further key columns, so that items count once per record and not once in all."""
    both = matched(gold, predicted, [*by, *pooled_over], item)
    counts = both.groupBy(*by).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def for_predicted(gold: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """gold of records that were predicted; those without any prediction do not count."""
    return gold.join(predicted.select(*keys).distinct(), list(keys), "left_semi")


def span_scores(gold: DataFrame, predicted: DataFrame, id_col: str, labels: str) -> DataFrame:
    """Scores by label of the spans that two columns of B-/I- tags mark: a hit has the same record, label, start and end."""
    item = F.concat_ws(":", F.col(id_col).cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    spans = lambda df: label_spans(df, id_col, labels).select("label", item.alias("span"))
    return set_scores(spans(gold), spans(predicted), ["label"], "span")


def averages(scores: DataFrame) -> DataFrame:
    """Micro scores from the sums of counts, and the macro F1, the mean over groups."""
    sums = scores.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(F.avg("f1"), 4).alias("macro_f1"))
    return sums.withColumns({f"micro_{k}": v for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def frequent_errors(gold: DataFrame, predicted: DataFrame, by: str, record: str, item: str, k: int) -> DataFrame:
    """The k items of each group and kind that are most often wrongly found (fp) or missed (fn), counted by record."""
    both = matched(gold, predicted, [record, by], item).where("g is null or p is null")
    counts = both.groupBy(by, F.when(F.col("g").isNull(), "fp").otherwise("fn").alias("kind"), item).agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(item), F.lit(32))  # first within parts, so that no group is ordered whole in one task
    order = [F.desc("n"), F.col(item)]
    near = counts.withColumn("_p", part).withColumn("_n", F.row_number().over(Window.partitionBy(by, "kind", "_p").orderBy(*order))).where(F.col("_n") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by, "kind").orderBy(*order))).where(F.col("rank") <= k).drop("_p", "_n")


def fuzzy_scores(gold: DataFrame, predicted: DataFrame, by: str, item: str, ratio: float = 0.85) -> DataFrame:
    """Scores by group with one-to-one matches: equal items first, then similar ones, greedily in a fixed order.

    Only items without an equal partner are compared, by a similarity join (see operators/similarity.py); a group of any
    size, of which any share may be one category's, is never in one place. Null items match nothing.
    """
    both = matched(gold, predicted, [by], item)
    counts = both.groupBy(by).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("exact"), F.count_if(F.col("p").isNull()).alias("n_g"), F.count_if(F.col("g").isNull()).alias("n_p"))
    pairs = similarity.similar_pairs(both.where("p is null"), both.where("g is null"), by, item, ratio)
    hits = similarity.matching(pairs, by).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("hits"))
    counts = counts.join(hits, counts[by].eqNullSafe(hits["_by"]), "left").na.fill(0, ["hits"])
    counts = counts.select(by, (F.col("exact") + F.col("hits")).alias("tp"), (F.col("n_p") - F.col("hits")).alias("fp"), (F.col("n_g") - F.col("hits")).alias("fn"))
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def comparison(scores: DataFrame, model: str, mode: str, value: str, modes: Sequence[str]) -> DataFrame:
    """One row a model, one column a mode, '-' where there is no score."""
    wide = scores.groupBy(model).pivot(mode, list(modes)).agg(F.first(value))
    return wide.select(model, *[F.coalesce(F.format_number(m, 4), F.lit("-")).alias(m) for m in modes])


def label_spans(tagged: DataFrame, id_col: str, labels: str) -> DataFrame:
    """(id_col, label, start, end) of the spans of B-/I- tags; an I- without its own B- begins a span too."""
    each = tagged.select(id_col, F.posexplode(labels).alias("pos", "tag")).where("tag <> 'O'")
    kind, order = F.substring("tag", 3, 100), Window.partitionBy(id_col).orderBy("pos")
    each = each.withColumn("label", kind)
    begins = F.startswith("tag", F.lit("B-")) | F.lag("pos").over(order).isNull() | (F.lag("pos").over(order) < F.col("pos") - 1) | (F.lag("label").over(order) != F.col("label"))
    numbered = each.withColumn("_b", begins.cast("int")).withColumn("_span", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(id_col, "_span", "label").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_span")
