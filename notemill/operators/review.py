"""States of manual reviews: (record, [model,] category, status)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import is_json

STATE = "map<string,struct<status:string,comment:string>>"


def entries(states: DataFrame, id_col: str, state: Column) -> DataFrame:
    """One row a category; keys that begin with _ are the form's own."""
    return states.select(id_col, F.explode(state).alias("category", "value")).where(~F.startswith("category", F.lit("_"))).select(id_col, "category", "value.status", "value.comment")


def completeness(reviewed: DataFrame, by: Sequence[str], slots: Column | int, broken: Column | None = None) -> DataFrame:
    """done, started or open by how many of the slots have a status; error where the state could not be read."""
    filled = F.count_if(F.coalesce(F.col("status"), F.lit("")) != "")
    wrong = F.lit(False) if broken is None else F.bool_or(broken)
    counts = reviewed.groupBy(*by).agg(filled.alias("n_filled"), wrong.alias("_wrong"))
    most = F.lit(slots) if isinstance(slots, int) else slots
    state = F.when(F.col("_wrong"), "error").when(F.col("n_filled") >= most, "done").when(F.col("n_filled") > 0, "started").otherwise("open")
    return counts.withColumn("state", state).drop("_wrong")


def slots(records: DataFrame, id_col: str, models: Sequence[str], per_model: int) -> DataFrame:
    """records with how many statuses all models together have room for."""
    return records.select(id_col, F.lit(len(models) * per_model).alias("n_slots"))


def consolidated(exports: DataFrame, id_col: str, raw: str) -> DataFrame:
    """One long table of all exports whose JSON can be read: (id_col, category, status, comment)."""
    return entries(parsed(exports, raw), id_col, F.col("state"))


def parsed(exports: DataFrame, raw: str) -> DataFrame:
    """Exports whose JSON can be read, with `state`; others are left out."""
    return exports.where(is_json(F.col(raw))).withColumn("state", F.from_json(raw, STATE)).where("state is not null")


def approve(reviewed: DataFrame, where: Column, status: str = "correto") -> DataFrame:
    return reviewed.withColumn("status", F.when(where, status).otherwise(F.col("status")))


def approval(reviewed: DataFrame, by: Sequence[str], status: str = "correto") -> DataFrame:
    good = F.count_if(F.col("status") == status)
    return reviewed.groupBy(*by).agg(F.count("*").alias("n"), F.round(good / F.count("*"), 4).alias("approval"))
