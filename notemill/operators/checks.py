"""Quality checks on entities in long form. Each gives issue rows (record_id, check, category, entity, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators.entities import by_record, with_key

ISSUE = ("record_id", "check", "category", "entity", "detail")


def _issues(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select("record_id", F.lit(check).alias("check"), "category", "entity", detail.cast("string").alias("detail"))


def repeated_keys(entities: DataFrame) -> DataFrame:
    """A key more than once in a record, in whatever categories: one issue a key."""
    each = with_key(entities).groupBy("record_id", "key", "category").agg(F.count("*").alias("n"))
    many = each.groupBy("record_id", "key").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("category")), ",").alias("detail")).where("n > 1")
    return many.select("record_id", F.lit("repeated_key").alias("check"), F.lit(None).cast("string").alias("category"), F.col("key").alias("entity"), "detail")


def leaked_tests(entities: DataFrame, marker: str, check: str, lab: str, targets: Sequence[str]) -> DataFrame:
    """Tests with a negative (or pending) result whose name is an entity of a target category as well."""
    keyed = with_key(entities)
    names = keyed.where((F.col("category") == lab) & text.has(F.col("key"), marker)).withColumn("name", text.before_marker(F.col("key"), marker)).where("name <> ''")
    known = keyed.where(F.col("category").isin(list(targets))).select("record_id", F.col("key").alias("name"), F.col("category").alias("_target")).distinct()
    return _issues(names.join(known, ["record_id", "name"]), check, F.col("_target"))


def listed(entities: DataFrame, terms: Sequence[str], check: str, category: str) -> DataFrame:
    """Entities of a category whose key is a term that does not belong there."""
    found = with_key(entities).where((F.col("category") == category) & F.col("key").isin(list(terms)))
    return _issues(found, check, F.col("key"))


def containing(entities: DataFrame, pattern: str, check: str, category: str | None = None, contexts: DataFrame | None = None, fold_context: bool = False) -> DataFrame:
    """Entities that contain the pattern; with contexts (record_id, context) not those whose key stands there.

    The context is in lower case only, its accents stay, unless fold_context.
    """
    keyed = with_key(entities).where(text.has(F.col("key"), pattern) & (F.lit(True) if category is None else F.col("category") == category))
    if contexts is not None:
        where = text.fold(F.col("context")) if fold_context else F.lower("context")
        keyed = keyed.join(contexts.select("record_id", where.alias("_context")), "record_id", "left").where(~F.coalesce(F.contains("_context", F.col("key")), F.lit(False)))
    return _issues(keyed, check, F.regexp_extract("key", f"(?iU){pattern}", 0))


def synonyms(entities: DataFrame, groups: Sequence[Sequence[str]], check: str = "synonyms") -> DataFrame:
    """More than one entity of a synonym group in one category of a record: one issue a group."""
    table = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for k in g for x in (k, i)])
    grouped = with_key(entities).withColumn("_g", F.try_element_at(table, F.col("key"))).where("_g is not null")
    many = grouped.groupBy("record_id", "category", "_g").agg(F.countDistinct("key").alias("n"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("detail")).where("n > 1")
    return many.select("record_id", F.lit(check).alias("check"), "category", F.lit(None).cast("string").alias("entity"), "detail")


CHECKS = ("repeated_key", "negative_test", "pending_test", "symptom_as_disease", "imaging_as_disease", "synonyms", "language", "vital_as_lab")


def marked(entities: DataFrame, contexts: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Entities, dealt out by record once, with `issues`: those of the eight checks, with their default lexicons.

    A test with a leaking result is there a second time under the name before its marker, so that the windows over
    (record, key) show whether an entity of a target category has that name; such rows have no entity of their own
    (real is false). An issue of several rows stands at the first of them. contexts: one row (record_id, context) a record.
    dealt: the entities are dealt out by record already.
    """
    disease, _, _, lab, _, organism = lexicons.CATEGORIES
    c = {k: F.col(k) for k in ("category", "entity", "key", "real", "probe")}
    rows = with_key(entities)
    imaging = "(" + "|".join(lexicons.CHECK_IMAGING) + ")"
    probe = lambda marker, check: F.when((c["category"] == lab) & text.has(c["key"], marker), F.struct(text.before_marker(c["key"], marker).alias("key"), F.lit(check).alias("probe")))
    own = F.struct(c["key"], F.lit(None).cast("string").alias("probe"))
    probes = F.filter(F.array(probe(lexicons.CHECK_NEGATIVE, "negative_test"), probe(lexicons.CHECK_PENDING, "pending_test")), lambda p: p.isNotNull() & (p["key"] != ""))
    rows = rows.select("record_id", "category", "pos", "entity", F.inline(F.concat(F.array(own), probes))).withColumn("real", c["probe"].isNull())
    rows = rows if dealt else rows.repartition("record_id")

    said = F.lit(False)
    if contexts is not None:
        rows = rows.join(contexts.select("record_id", F.lower("context").alias("_context")), "record_id", "left")
        said = F.coalesce(F.contains("_context", c["key"]), F.lit(False))
    of = lambda check, category, entity, detail: F.struct(F.lit(check).alias("check"), category.cast("string").alias("category"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))
    word = lambda pattern: F.regexp_extract("key", f"(?iU){pattern}", 0)
    plain = {
        "symptom_as_disease": ((c["category"] == disease) & c["key"].isin(list(lexicons.CHECK_SYMPTOMS)), c["key"]),
        "imaging_as_disease": ((c["category"] == disease) & text.has(c["key"], imaging) & ~said, word(imaging)),
        "language": (text.has(c["key"], lexicons.CHECK_ENGLISH), word(lexicons.CHECK_ENGLISH)),
        "vital_as_lab": ((c["category"] == lab) & text.has(c["key"], lexicons.CHECK_VITALS), word(lexicons.CHECK_VITALS)),
    }
    rows = rows.withColumn("_plain", F.array_compact(F.array(*[F.when(c["real"] & hit, of(check, c["category"], c["entity"], detail)) for check, (hit, detail) in plain.items()]))).drop("_context")

    table = F.create_map(*[F.lit(x) for i, g in enumerate(lexicons.CHECK_SYNONYMS) for k in g for x in (k, i)])
    rows = rows.withColumn("_g", F.when(c["real"], F.try_element_at(table, c["key"])))
    key, group = Window.partitionBy("record_id", "key"), Window.partitionBy("record_id", "category", "_g")
    first = lambda over: F.row_number().over(over) == 1
    rows = rows.withColumns({"_n": F.count_if(c["real"]).over(key), "_in": F.collect_set(F.when(c["real"], c["category"])).over(key), "_first": first(key.orderBy(F.desc("real"), "category", "pos"))})
    rows = rows.withColumns({"_keys": F.collect_set(F.when(F.col("_g").isNotNull(), c["key"])).over(group), "_lead": first(group.orderBy("key", "pos"))})
    none = F.lit(None)
    leaked = [F.when(~c["real"] & F.array_contains("_in", t), F.struct(c["probe"].alias("check"), c["category"], c["entity"], F.lit(t).alias("detail"))) for t in (disease, organism)]
    several = [
        F.when(c["real"] & F.col("_first") & (F.col("_n") > 1), of("repeated_key", none, c["key"], F.array_join(F.array_sort("_in"), ","))),
        F.when(F.col("_g").isNotNull() & F.col("_lead") & (F.size("_keys") > 1), of("synonyms", c["category"], none, F.array_join(F.array_sort("_keys"), ","))),
    ]
    return rows.select("record_id", "category", "pos", "entity", "real", F.concat("_plain", F.array_compact(F.array(*leaked, *several))).alias("issues"))


def all_checks(entities: DataFrame, contexts: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """The eight checks with their default lexicons: one issue a row."""
    return marked(entities, contexts, dealt).select("record_id", F.inline("issues"))


def report(entities: DataFrame, contexts: DataFrame | None = None, records: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """A row a record: how many entities and issues it has, how many of each check, and the issues in order.

    records (record_id): those that are to be in the report although they may have no entity.
    """
    rows = marked(entities, contexts, dealt)
    order = F.array_sort(F.flatten(F.collect_list("issues")))
    found = rows.groupBy("record_id").agg(F.count_if("real").alias("n_entities"), order.alias("issues"))
    if records is not None:
        found = records.select("record_id").distinct().join(found, "record_id", "left")
    issues = F.coalesce("issues", F.array().cast("array<struct<check:string,category:string,entity:string,detail:string>>"))
    found = found.select("record_id", F.coalesce("n_entities", F.lit(0).cast("long")).alias("n_entities"), issues.alias("issues"))
    many = F.create_map(*[x for k in CHECKS for x in (F.lit(k), F.size(F.filter("issues", _of(k))))])
    return found.select("record_id", "n_entities", F.size("issues").cast("long").alias("n_issues"), many.alias("by_check"), "issues")


def _of(check: str):
    return lambda issue: issue["check"] == check


def summed(entities: DataFrame, terms: Sequence[str], term_check: str, category: str, groups: Sequence[Sequence[str]], dealt: bool = False) -> DataFrame:
    """summary() of repeated_keys(), listed() and synonyms(), in one pass: rows are dealt out by record once and marked there."""
    table = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for k in g for x in (k, i)])
    keyed = by_record(entities, dealt).withColumn("_g", F.try_element_at(table, F.col("key")))
    key, group = Window.partitionBy("record_id", "key"), Window.partitionBy("record_id", "category", "_g")
    numbered = keyed.withColumns({"_kn": F.row_number().over(key.orderBy("category", "pos")), "_gk": F.dense_rank().over(group.orderBy("key")), "_gn": F.row_number().over(group.orderBy("key"))})
    repeated, many = F.col("_kn") == 2, F.col("_g").isNotNull() & (F.col("_gk") == 2)
    first_many = many & (F.row_number().over(Window.partitionBy("record_id", "category", "_g", "_gk").orderBy("_gn")) == 1)
    marks = {"repeated_key": repeated, term_check: (F.col("category") == category) & F.col("key").isin(list(terms)), "synonyms": first_many}
    marked = numbered.withColumns({f"_is_{i}": m.cast("long") for i, m in enumerate(marks.values())})
    by = marked.groupBy("record_id").agg(*[F.sum(f"_is_{i}").alias(f"_is_{i}") for i in range(len(marks))])
    each = by.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"_is_{i}").alias("n")) for i, k in enumerate(marks)])).alias("x")).select("x.*").where("n > 0")
    return each.groupBy("check").agg(F.sum("n").alias("n_issues"), F.count("*").alias("n_records"))


def before_and_after(marked: DataFrame, terms: Sequence[str], term_check: str, category: str) -> DataFrame:
    """compared() of repeated_keys() and listed() on all rows and on those with `after` (entities.after_steps()), in one pass."""
    hit = (F.col("category") == category) & F.col("key").isin(list(terms))
    keys = marked.groupBy("record_id", "key").agg(F.count("*").alias("n"), F.count_if("after").alias("m"), F.count_if(hit).alias("h"), F.count_if(hit & F.col("after")).alias("g"))
    sums = keys.agg(F.count_if(F.col("n") > 1).alias("rb"), F.count_if(F.col("m") > 1).alias("ra"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("lb"), F.coalesce(F.sum("g"), F.lit(0)).cast("long").alias("la"))
    row = lambda check, b, a: F.struct(F.lit(check).alias("check"), F.col(b).alias("n_before"), F.col(a).alias("n_after"), (F.col(a) - F.col(b)).alias("delta"))
    return sums.select(F.inline(F.array(row("repeated_key", "rb", "ra"), row(term_check, "lb", "la")))).where("n_before + n_after > 0")


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("check").agg(F.count("*").alias("n_issues"), F.countDistinct("record_id").alias("n_records"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues by check on both sides; a check that one side does not have counts 0."""
    side = lambda df, name: df.groupBy("check").agg(F.count("*").alias(name))
    both = side(before, "n_before").join(side(after, "n_after"), "check", "full_outer").na.fill(0, ["n_before", "n_after"])
    return both.withColumn("delta", F.col("n_after") - F.col("n_before"))
