"""The extractor's contract: a function from texts to entity lists and sections, called in Arrow batches, that never raises."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.lexicons import CATEGORIES, OVERFLOW
from notemill.functions.text import is_json
from notemill.schemas import RECORD, SOAP

FAILED = "ERRO"
_MAP = "map<string,array<string>>"


def failure(error: Exception | str) -> str:
    """token_overflow for what has a mark of an exceeded limit, else error."""
    return "token_overflow" if re.search(OVERFLOW, str(error).lower()) else "error"


def extract(notes: DataFrame, entities: Callable[[str], dict], sections: Callable[[str], dict], audit: Callable[[str, dict], dict] | None = None, attempts: int = 2, id_col: str = "hadm_id", code_cols: tuple[str, ...] = ("icd_code", "codigo_cid"), target_col: str = "doenca_alvo") -> DataFrame:
    """Records (RECORD) of notes. Each extractor is tried `attempts` times; what fails leaves empty lists or the sentinel,
    a status and at most 500 characters of the error. The audit is skipped without entities and falls back to what it got.
    """
    codes = [F.col(c).cast("string") for c in code_cols if c in notes.columns] or [F.lit(None).cast("string")]
    target = F.col(target_col) if target_col in notes.columns else F.lit(None).cast("string")
    taken = notes.select(F.col(id_col).cast("string").alias("id"), F.coalesce(*codes).alias("code"), target.alias("target"), F.coalesce("text", F.lit("")).alias("text"))

    def tried(call: Callable, *args: object) -> tuple[dict | None, str, str | None]:
        error: Exception | None = None
        for _ in range(attempts):
            try:
                return call(*args), "ok", None
            except Exception as e:  # an extractor may fail in any way
                error = e
        return None, failure(error), str(error)[:500]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                found, ner_status, ner_error = tried(entities, row.text)
                lists = {c: [str(x) for x in (found or {}).get(c) or []] for c in CATEGORIES}
                texts, soap_status, soap_error = tried(sections, row.text)
                soap = {c: (texts or {}).get(c) or "" for c in SOAP} if texts is not None else dict.fromkeys(SOAP, FAILED)
                audit_status, audit_error = "skipped", None
                if audit is not None and any(lists.values()):
                    checked, audit_status, audit_error = tried(audit, row.text, lists)
                    lists = {c: list(checked.get(c) or []) for c in CATEGORIES} if checked is not None else lists
                out.append({"paciente_id": row.id, "codigo_cid": row.code, "doenca_alvo_identificada": row.target, "ner": lists, "soap": soap, "agent_status": {"ner_status": ner_status, "soap_status": soap_status, "audit_status": audit_status, "ner_error": ner_error, "soap_error": soap_error, "audit_error": audit_error}})
            yield pd.DataFrame(out, columns=[f.name for f in RECORD.fields])

    return taken.mapInPandas(run, RECORD)


def nested(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row, `value`: JSON objects within objects by keys, the innermost holding value; df has a row for each combination.

    Meant for dictionaries: a level's entries are gathered in one row.
    """
    inner = F.col(value)
    for i in range(len(keys) - 1, -1, -1):
        outer = keys[:i]
        entry = F.array_sort(F.collect_list(F.struct(F.col(keys[i]).cast("string").alias("k"), inner.alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        df = df.groupBy(*outer).agg(F.map_from_entries(entry).alias("_inner")) if outer else df.agg(F.map_from_entries(entry).alias("_inner"))
        inner = F.col("_inner")
    return df.select(F.to_json(inner).alias("value"))


def lexicon_extractor(table: dict[str, list[str]]) -> Callable[[str], dict]:
    """A deterministic stand-in: each category's terms that occur in the text."""
    return lambda text: {c: [t for t in terms if t in text.lower()] for c, terms in table.items()}


def repaired(text: str | None) -> dict | None:
    """The object in a text: as it is, from its first brace on, or with what is open closed; None if none of it works."""
    if not text:
        return None
    begin = text.find("{")
    if begin < 0:
        return None
    for candidate in (text, text[begin : text.rfind("}") + 1], _closed(text[begin:])):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def _closed(text: str) -> str:
    """Closes an open string and open brackets; a dangling comma, colon or key goes."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    body = (text + '"' if quoted else text).rstrip()
    if stack and stack[-1] == "}":
        body = re.sub(r'(,|(?<=\{))\s*"[^"]*"\s*:?\s*$', "", body)
    return body.rstrip().rstrip(",").rstrip() + "".join(reversed(stack))


def parse_lists(df: DataFrame, raw: str) -> DataFrame:
    """df with `parsed`, a map of lists of strings, and `how`: strict, repaired or raw.

    What the built-in parser reads never reaches Python; only the others are repaired, in Arrow batches.
    """
    strict = F.from_json(F.col(raw), _MAP, {"mode": "PERMISSIVE"})
    valid = F.coalesce(F.is_valid_utf8(F.col(raw)), F.lit(False)) & is_json(F.col(raw)) & strict.isNotNull()
    good = df.where(valid).withColumns({"parsed": strict, "how": F.lit("strict")})
    rest = df.where(~valid)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def repair(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [repaired(x) for x in batch[raw]]
            lists = [None if v is None else {k: [str(i) for i in x if i is not None] for k, x in v.items() if isinstance(x, list)} for v in values]
            yield batch.assign(parsed=lists, how=["raw" if v is None else "repaired" for v in values])

    return good.unionByName(rest.mapInPandas(repair, f"{fields}, parsed {_MAP}, how string"))
