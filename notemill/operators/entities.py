"""Entity lists in long form: (record_id, category, pos, entity), one row an entity, cleaned by window functions.

Windows are partitioned by record and key, so their groups are the few entities of one record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import lexicon
from notemill.operators.cohort import bounded_broadcast, first_rows
from notemill.session import checkpointed

LONG = ("record_id", "category", "pos", "entity")
DISEASE, SYMPTOM, _, LAB, _, _ = lexicons.CATEGORIES


def long_form(records: DataFrame, id_col: str, lists: Mapping[str, Column]) -> DataFrame:
    """One row an entity; null lists are empty, null items are left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(items.cast("array<string>"), F.array().cast("array<string>")).alias("items")) for c, items in lists.items()])
    each = records.select(F.col(id_col).alias("record_id"), F.explode(parts).alias("part"))
    return each.select("record_id", "part.category", F.posexplode("part.items").alias("pos", "entity")).where("entity is not null")


def regrouped(entities: DataFrame, categories: Sequence[str] = lexicons.CATEGORIES) -> DataFrame:
    """One row a record with a list for each category, in order of pos."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("pos", "entity")))), lambda x: x["entity"])
    return entities.groupBy("record_id").agg(*[ordered(c).alias(c) for c in categories])


def _rank(order: Sequence[str]) -> Column:
    rank = F.lit(len(order))
    for i, c in reversed(list(enumerate(order))):
        rank = F.when(F.col("category") == c, i).otherwise(rank)
    return rank


def with_key(entities: DataFrame) -> DataFrame:
    return entities if "key" in entities.columns else entities.withColumn("key", text.key(F.col("entity")))


def by_record(entities: DataFrame, dealt: bool = False) -> DataFrame:
    """Keyed rows dealt out by record: all windows and groups of the steps hold the record, so this shuffle serves them all.

    dealt: they are so already, as where records were dealt out before their lists became rows.
    """
    return with_key(entities) if dealt else with_key(entities).repartition("record_id")


def _within(keyed: DataFrame) -> DataFrame:
    first = F.min(F.struct("pos", "entity")).alias("first")  # combined before a shuffle, where there is one
    return keyed.groupBy("record_id", "category", "key").agg(first).select("record_id", "category", "first.pos", "first.entity", "key")


def _best(keyed: DataFrame, order: Sequence[str]) -> DataFrame:
    best = F.min("_rank").over(Window.partitionBy("record_id", "key"))
    return keyed.withColumn("_rank", _rank(order)).withColumn("_best", best).where("_rank = _best").drop("_rank", "_best")


def _placed(keyed: DataFrame, order: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """With gone: another place of the key comes first, by precedence and position, and it is no stop term."""
    place = F.row_number().over(Window.partitionBy("record_id", "key").orderBy("_rank", "pos"))
    return keyed.withColumn("_rank", _rank(order)).withColumn("_n", place).withColumn("gone", (F.col("_n") > 1) & ~F.col("key").isin(list(stop))).drop("_rank", "_n")


def _named(keyed: DataFrame, table: DataFrame) -> DataFrame:
    named = keyed.join(bounded_broadcast(table.select("key", "name")), "key", "left")
    return named.select("record_id", "category", "pos", F.coalesce("name", "entity").alias("entity"), F.when(F.col("name").isNull(), F.col("key")).otherwise(text.key(F.col("name"))).alias("key"))


def _moved(keyed: DataFrame, pattern: str, source: str, target: str) -> DataFrame:
    moving = (F.col("category") == source) & F.col("key").rlike(pattern)
    marked = keyed.withColumn("_moves", moving).withColumn("category", F.when(F.col("_moves"), target).otherwise(F.col("category")))
    keys = Window.partitionBy("record_id", "category", "key")
    seen = marked.withColumn("_n", F.row_number().over(keys.orderBy("_moves", "pos"))).where(~F.col("_moves") | (F.col("_n") == 1))
    order = Window.partitionBy("record_id", "category").orderBy("_moves", "pos")
    return seen.withColumn("pos", F.when(F.col("category") == target, F.row_number().over(order) - 1).otherwise(F.col("pos"))).drop("_moves", "_n")


def _matching(pattern: str, category: str) -> Column:
    return (F.col("category") == category) & F.col("key").rlike(f"(?iU){pattern}")


def dedup_within(entities: DataFrame) -> DataFrame:
    """Of one key in one category of a record the first stays."""
    return _within(with_key(entities)).select(*LONG)


def exclusive(entities: DataFrame, order: Sequence[str] = lexicons.PRECEDENCE_A) -> DataFrame:
    """A key stays only in the first of its categories by precedence; repeats inside it stay too."""
    return _best(with_key(entities), order).select(*LONG)


def dedup_across(entities: DataFrame, order: Sequence[str] = lexicons.PRECEDENCE_B, stop: Sequence[str] = lexicons.STOP_TERMS) -> DataFrame:
    """One place for a key over all categories, the first by precedence and position; stop terms are exempt."""
    return _placed(with_key(entities), order, stop).where("not gone").select(*LONG)


def canonical(entities: DataFrame, table: DataFrame) -> DataFrame:
    """Entities under their canonical names (table: key, name; broadcast while it is small), then without repeats."""
    return _within(_named(with_key(entities), table)).select(*LONG)


def canonical_table(spark, names: Mapping[str, str] = lexicons.CANONICAL) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "key string, name string")


def clean(entities: DataFrame, table: DataFrame, order: Sequence[str] = lexicons.PRECEDENCE_A, dealt: bool = False) -> DataFrame:
    """Repeats, precedence, canonical names, on one shuffle: stable from its second application on."""
    return _within(_named(_best(_within(by_record(entities, dealt)), order), table)).select(*LONG)


def after_exclusive(entities: DataFrame, order: Sequence[str] = lexicons.PRECEDENCE_A) -> DataFrame:
    """Keyed rows with after: whether exclusive() keeps the row."""
    best = F.min("_rank").over(Window.partitionBy("record_id", "key"))
    return with_key(entities).withColumn("_rank", _rank(order)).withColumn("after", F.col("_rank") == best).drop("_rank")


def after_steps(entities: DataFrame, order: Sequence[str] = lexicons.PRECEDENCE_A, dealt: bool = False) -> DataFrame:
    """Keyed rows, dealt out by record, with after: whether the first two steps of clean() keep the row."""
    first = F.row_number().over(Window.partitionBy("record_id", "category", "key").orderBy("pos")) == 1
    marked = by_record(entities, dealt).withColumn("_first", first).withColumn("_rank", F.when(F.col("_first"), _rank(order)))
    best = F.min("_rank").over(Window.partitionBy("record_id", "key"))
    return marked.withColumn("after", F.col("_first") & (F.col("_rank") == best)).drop("_first", "_rank")


def recategorise(entities: DataFrame, pattern: str, source: str, target: str) -> DataFrame:
    """Entities of source whose key matches move to the end of target, unless target has the key already."""
    return _moved(with_key(entities), pattern, source, target).select(*LONG)


def imaging_pattern(terms: Sequence[str] = lexicons.IMAGING) -> str:
    """The term alone, or before a blank or comma."""
    import re

    return "^(" + "|".join(re.escape(t) for t in terms) + ")($|[ ,])"


def dropped(entities: DataFrame, pattern: str, category: str) -> DataFrame:
    """Without the entities of a category whose key matches."""
    return with_key(entities).where(~_matching(pattern, category)).select(*LONG)


def substituted(entities: DataFrame, table: Mapping[str, str] = lexicons.TRANSLATIONS) -> DataFrame:
    """Entities with phrases replaced; a key is made anew."""
    return entities.drop("key").withColumn("entity", lexicon.substitute(F.col("entity"), table))


def _with_phrases(entities: DataFrame, table: Mapping[str, str], dealt: bool = False) -> DataFrame:
    """Keyed rows dealt out by record, with _by: the entity with its phrases replaced, null where nothing is. Found before the
    shuffle, as what runs in Python would undo the dealing out."""
    by = lexicon.substitute(F.col("entity"), table)
    rows = with_key(entities).withColumn("_by", F.nullif(by, F.col("entity")))
    return rows if dealt and lexicon.built_in(table) else rows.repartition("record_id")


def _replaced(rows: DataFrame) -> DataFrame:
    key = F.when(F.col("_by").isNull(), F.col("key")).otherwise(text.key(F.col("_by")))
    return rows.withColumns({"entity": F.coalesce("_by", "entity"), "key": key}).drop("_by")


def layered(entities: DataFrame, moves: tuple[str, str, str] | None = None, drops: tuple[str, str] | None = None, table: Mapping[str, str] = lexicons.TRANSLATIONS, order: Sequence[str] = lexicons.PRECEDENCE_B, stop: Sequence[str] = lexicons.STOP_TERMS, dealt: bool = False) -> DataFrame:
    """The five layers in their order, on one shuffle: imaging findings, vital signs, language, repeats across and within categories.

    moves: pattern, source and target of the first layer; drops: pattern and category of the second.
    """
    moved = _moved(_with_phrases(entities, table, dealt), *(moves or (imaging_pattern(), DISEASE, SYMPTOM)))
    left = moved.where(~_matching(*(drops or (lexicons.VITALS, LAB))))
    return _within(_placed(_replaced(left), order, stop).where("not gone")).select(*LONG)


def totals(entities: DataFrame) -> DataFrame:
    return entities.groupBy("category").agg(F.count("*").alias("n_entities"), F.countDistinct("record_id").alias("n_records"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities that only one side has, by record and category; case and surrounding blanks do not count."""
    plain = lambda df, side: df.select("record_id", "category", F.lower(text.strip(F.col("entity"))).alias("item"), F.lit(1).alias(side)).distinct()
    both = plain(before, "b").join(plain(after, "a"), ["record_id", "category", "item"], "full_outer")
    return both.groupBy("record_id", "category").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_changes"))


def removals(marked: DataFrame) -> DataFrame:
    """changes() between all rows and those with `after`, in one pass: entities of a record and category of which no row stays."""
    items = marked.groupBy("record_id", "category", F.lower(text.strip(F.col("entity"))).alias("item")).agg(F.bool_or("after").alias("after"))
    return items.groupBy("record_id", "category").agg(F.count_if(~F.col("after")).alias("n_changes"))


def key_variants(record: Mapping[str, Sequence[Column]]) -> dict[str, Column]:
    """For each name the first of its older or foreign keys that is there; lists become lines."""
    return {name: F.coalesce(*options, F.lit("")) for name, options in record.items()}


def layer_marks(entities: DataFrame, dealt: bool = False) -> DataFrame:
    """One row for each entity that a layer touches: (layer, record_id, category, pos, entity), all on one shuffle.

    imaging: moved; vitals: dropped; language: replaced; across, within: removed as repeats. Rows that a layer removes
    stay as dead ones, which the windows of later layers put last.
    """
    moves = (F.col("category") == DISEASE) & F.col("key").rlike(imaging_pattern())
    rows = _with_phrases(entities, lexicons.TRANSLATIONS, dealt).withColumns({"_moves": moves, "_old": F.struct("category", "pos", "entity"), "category": F.when(moves, SYMPTOM).otherwise(F.col("category"))})
    number = lambda by, *order: F.row_number().over(Window.partitionBy("record_id", *by).orderBy(*order))
    rows = rows.withColumn("_live", ~F.col("_moves") | (number(["category", "key"], "_moves", "pos") == 1))
    rows = rows.withColumn("pos", F.when(F.col("category") == SYMPTOM, number(["category"], F.desc("_live"), "_moves", "pos") - 1).otherwise(F.col("pos")))
    rows = rows.withColumn("_vital", F.col("_live") & _matching(lexicons.VITALS, LAB)).withColumn("_live", F.col("_live") & ~F.col("_vital")).withColumn("_before", F.col("entity"))
    rows = _replaced(rows).withColumn("_rank", _rank(lexicons.PRECEDENCE_B))
    gone = F.col("_live") & (number(["key"], F.desc("_live"), "_rank", "pos") > 1) & ~F.col("key").isin(list(lexicons.STOP_TERMS))
    rows = rows.withColumn("_gone", gone).withColumn("_left", F.col("_live") & ~F.col("_gone"))
    rows = rows.withColumn("_again", F.col("_left") & (number(["category", "key"], F.desc("_left"), "pos") > 1))
    at = lambda layer, hit, category, pos, entity: F.when(hit, F.struct(F.lit(layer).alias("layer"), category.alias("category"), pos.alias("pos"), entity.alias("entity")))
    now = (F.col("category"), F.col("pos"))
    touched = [
        at("imaging", F.col("_moves"), *[F.col(f"_old.{c}") for c in ("category", "pos", "entity")]),
        at("vitals", F.col("_vital"), *now, F.col("_before")),
        at("language", F.col("_live") & (F.col("_before") != F.col("entity")), *now, F.col("_before")),
        at("across", F.col("_gone"), *now, F.col("entity")),
        at("within", F.col("_again"), *now, F.col("entity")),
    ]
    return rows.select("record_id", F.inline(F.array_compact(F.array(*touched))))


def layer_counts(entities: DataFrame, examples: int = 5, dealt: bool = False) -> DataFrame:
    """(layer, n, examples): how many entities each of the five layers touches, with the first few, by record, category and place.

    Rows are counted by record, once; the examples are of the first few records of each layer, whose rows are made again.
    """
    by = checkpointed(layer_marks(entities, dealt).groupBy("layer", "record_id").agg(F.count("*").alias("n")))
    counts = by.groupBy("layer").agg(F.sum("n").alias("n"))
    few = by.withColumn("_r", F.row_number().over(Window.partitionBy("layer").orderBy("record_id"))).where(F.col("_r") <= examples)
    few = checkpointed(few.select(F.col("layer").alias("_layer"), F.col("record_id").alias("_id")))  # 5 x examples rows at most
    ids = F.broadcast(few.select("_id").distinct())
    rows = layer_marks(entities.join(ids, F.col("record_id").eqNullSafe(F.col("_id")), "left_semi"), dealt)
    rows = rows.join(F.broadcast(few), (F.col("layer") == F.col("_layer")) & F.col("record_id").eqNullSafe(F.col("_id")), "left_semi")
    shown = first_rows(rows, ["layer"], [F.col("record_id"), F.col("category"), F.col("pos")], F.lit(examples)).groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("examples"))
    return counts.join(shown, "layer", "left")
