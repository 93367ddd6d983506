"""Queries that run as streams over files of the driver's tables, and the same in SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notemill.plans.base import table
from notemill.session import shared_folder
from notemill.streaming import recovery, resumable, reviews


def _as_files(df, name: str, many: int = 6) -> str:
    """df as some files in an order of their own."""
    path = shared_folder(df.sparkSession, name)
    df.repartition(many).write.parquet(path)
    return path


def _finished(query) -> None:
    query.awaitTermination()


def stage_in_parts(spark, d):
    """A stage over files, two at a time; the second run finds nothing left."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    source, target = _as_files(orders, "orders"), shared_folder(spark, "parts")
    for _ in range(2):
        _finished(resumable.run(resumable.files(spark, source, orders.schema, 2), target, lambda part: part.withColumn("twice", F.col("o_custkey") * 2)))
    done = resumable.ledger(spark, target).agg(F.sum("n").cast("long")).first()[0]
    return resumable.results(spark, target).select("o_orderkey", "twice", F.lit(done).alias("n_rows"))


def retry_outcomes(spark, d):
    """Events as attempts of their users, in order of time: a purchase is good, three others in a row are the end."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempts = table(spark, d, "events").select("user_id", F.row_number().over(order).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))
    attempts = attempts.unionByName(attempts.where("attempt = 2"))  # some come twice
    source, target = _as_files(attempts, "attempts"), shared_folder(spark, "outcomes")
    stream = recovery.outcomes(resumable.files(spark, source, attempts.schema, 2), "user_id", "attempt", "ok", 3)
    _finished(resumable.run(stream, target, mode="update"))
    return resumable.latest(resumable.results(spark, target), ["user_id"], ["seen"]).select("user_id", "status", "failed")


def review_log(spark, d):
    """Statuses set by events that arrive in any order and twice; then all open ones of a model approved at a later time."""
    labels = table(spark, d, "labels")
    each = labels.select(F.col("doc_id").alias("record"), F.explode(F.array(F.lit("m1"), F.lit("m2"))).alias("model"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"), "quality", "toxic")
    status = F.element_at(F.array(F.lit("correto"), F.lit("parcial"), F.lit("errado")), ((F.col("record") + F.col("number") * (1 + F.col("toxic"))) % 3 + 1).cast("int"))
    at = (F.lit(100) + (F.col("record") * 7 + F.col("number") * 5) % 11).cast("long")
    events = each.select("record", "model", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("category"), at.alias("at"), "number", status.alias("status"), F.lit(None).cast("string").alias("comment"))
    events = events.unionByName(events.where("number = 2"))
    source, target = _as_files(events, "reviews"), shared_folder(spark, "statuses")
    for run in range(2):
        _finished(resumable.run(reviews.statuses(resumable.files(spark, source, events.schema, 2)), target, mode="update"))
        if run == 0:
            now = resumable.latest(resumable.results(spark, target), reviews.KEYS, ["at", "number"])
            reviews.approvals(now, (F.col("status") == "parcial") & (F.col("model") == "m2"), F.lit(1000).cast("long")).write.mode("append").parquet(source)
    return resumable.latest(resumable.results(spark, target), reviews.KEYS, ["at", "number"]).select(*reviews.KEYS, "at", "status")


QUERIES = {f.__name__: f for f in (stage_in_parts, retry_outcomes, review_log)}

ORACLE_SQL = {
    "stage_in_parts": "SELECT o_orderkey, o_custkey * 2 AS twice, (SELECT count(*) FROM orders) AS n_rows FROM orders",
    "retry_outcomes": """
        WITH a AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events QUALIFY n <= 3),
        g AS (SELECT user_id, min(n) FILTER (ok) AS good, count(*) AS m FROM a GROUP BY user_id)
        SELECT user_id, CASE WHEN good IS NOT NULL THEN 'done' WHEN m >= 3 THEN 'dead' ELSE 'due' END AS status, CAST(coalesce(good - 1, m) AS INTEGER) AS failed FROM g""",
    "review_log": """
        WITH e AS (
            SELECT doc_id AS record, model, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS category, CAST(100 + (doc_id * 7 + number * 5) % 11 AS BIGINT) AS at, number,
                   ['correto', 'parcial', 'errado'][CAST((doc_id + number * (1 + toxic)) % 3 AS INTEGER) + 1] AS status
            FROM labels, (VALUES ('m1'), ('m2')) m(model), (VALUES (1), (2), (3)) n(number)),
        l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY record, model, category ORDER BY e.at DESC, number DESC) = 1)
        SELECT record, model, category, CASE WHEN status = 'parcial' AND model = 'm2' THEN 1000 ELSE l.at END AS at,
               CASE WHEN status = 'parcial' AND model = 'm2' THEN 'correto' ELSE status END AS status FROM l""",
}
