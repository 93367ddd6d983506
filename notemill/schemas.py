"""Record shapes, and readers' defaults: a missing list is empty, a missing text is ''."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.lexicons import CATEGORIES

SOAP = ("subjective", "objective_exam", "objective_results", "assessment", "plan", "course")
STATUSES = ("ok", "token_overflow", "error", "skipped", "not_needed")
_text = lambda name: T.StructField(name, T.StringType())

NOTE = T.StructType([_text("note_id"), T.StructField("subject_id", T.LongType()), T.StructField("hadm_id", T.LongType()), _text("text")])
ENTITIES = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in CATEGORIES])
SOAP_NOTE = T.StructType([_text(c) for c in SOAP])
AGENT_STATUS = T.StructType([_text(c) for c in ("ner_status", "soap_status", "audit_status", "ner_error", "soap_error", "audit_error")])
RECORD = T.StructType([_text("paciente_id"), _text("codigo_cid"), _text("doenca_alvo_identificada"), T.StructField("ner", ENTITIES), T.StructField("soap", SOAP_NOTE), T.StructField("agent_status", AGENT_STATUS)])
COVERAGE = T.StructType([_text("paciente_id"), _text("codigo_cid"), _text("doenca_alvo"), T.StructField("mention_count", T.IntegerType()), _text("coverage_status")])
EVENT = T.StructType([_text("ts"), _text("level"), _text("msg"), T.StructField("data", T.MapType(T.StringType(), T.StringType()))])
CHAT = T.ArrayType(T.StructType([_text("role"), _text("content")]))
PREDICTION = T.StructType([_text("paciente_id"), T.StructField("predictions", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), _text("raw_output")])


def filled(records: DataFrame) -> DataFrame:
    """Records with every category and section present."""
    lists = F.struct(*[F.coalesce(F.col(f"ner.{c}"), F.array().cast("array<string>")).alias(c) for c in CATEGORIES])
    texts = F.struct(*[F.coalesce(F.col(f"soap.{c}"), F.lit("")).alias(c) for c in SOAP])
    return records.withColumns({"ner": lists, "soap": texts})
