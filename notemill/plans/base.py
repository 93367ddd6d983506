"""What the query modules share: tables, the stand-in lexicon, and entities made of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import entities
from notemill.session import ship

#: Flags on documents; patterns on folded text, so that both engines' word boundaries agree.
FLAGS = {"mail": "[a-z0-9]@[a-z0-9]", "licence": r"\blicense[ds]?\b", "secret": "password=|token =", "number": "[0-9]{4,}", "shout": "!!"}
#: Words that stand for negators and negated terms, by nothing but their frequency in the texts.
NEGATORS, TERMS = ("the", "le", "die", "el", "la", "der"), ("of", "and", "de", "in", "un")
CATEGORIES = ("c1", "c2", "c3", "c4")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: So many documents a partition where their words become rows: what a task sorts then stays the same however many there are.
DEALT = 1024


def dealt(docs: DataFrame) -> DataFrame:
    """Documents dealt out by id before their words become rows, which windows and groups by record then need not shuffle."""
    return docs.repartition(max(1, -(-docs.count() // DEALT)), "doc_id")


def flag_columns(body: Column) -> dict[str, Column]:
    return text.flags(text.fold(body), FLAGS)


def flag_sql(alias: str = "text") -> str:
    return ", ".join(f"regexp_matches(lower(strip_accents({alias})), '{p}') AS {k}" for k, p in FLAGS.items())


def words(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))


def word_entities(docs: DataFrame) -> DataFrame:
    """Each word of each document as an entity: c1 begins with a capital, c2 has an accent, c3 is short, c4 is any other."""
    each = docs.select(F.col("doc_id").alias("record_id"), F.posexplode(words(F.col("text"))).alias("pos", "entity"))
    category = F.when(F.col("entity").rlike("^[A-ZÀ-Þ]"), "c1").when(F.col("entity").rlike("[À-ÿ]"), "c2").when(F.length("entity") <= 3, "c3").otherwise("c4")
    return each.select("record_id", category.alias("category"), "pos", "entity")


#: The same in SQL, and with folded keys.
WORDS_SQL = """
    w AS (SELECT doc_id AS record_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS l FROM documents),
    u AS (SELECT record_id, unnest(l) AS entity, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM w),
    ents AS (
        SELECT record_id, CASE WHEN regexp_matches(entity, '^[A-ZÀ-Þ]') THEN 'c1' WHEN regexp_matches(entity, '[À-ÿ]') THEN 'c2'
                               WHEN length(entity) <= 3 THEN 'c3' ELSE 'c4' END AS category, pos, entity,
               lower(strip_accents(entity)) AS key
        FROM u)"""


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_entities(documents(spark, sf_dir))


def dealt_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table, dealt out by record."""
    return word_entities(dealt(documents(spark, sf_dir).select("doc_id", "text")))


__all__ = ["CATEGORIES", "FLAGS", "NEGATORS", "TERMS", "WORDS_SQL", "dealt", "dealt_entities", "documents", "entities", "entity_table", "flag_columns", "flag_sql", "table", "word_entities", "words"]
