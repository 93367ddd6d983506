"""Training-set formats of records: BIO tags, chat messages, prompts, loss masks, and their validity."""

from __future__ import annotations

import heapq
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.text import is_json


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"token": m.group(), "start": m.start(), "end": m.end()} for m in _WORD.finditer(t)])


def tokens(text: Column) -> Column:
    """Tokens between blanks as (token, start, end), end exclusive; in time linear in the text. Null stays null."""
    return F.pandas_udf(_tokens, "array<struct<token:string,start:int,end:int>>")(text)


def found_spans(text: Column, entities: Column) -> Column:
    """(start, end, label) of the first occurrence of each (entity, label), in any case; missing ones are left out."""

    def at(e: Column) -> Column:
        place = F.call_function("locate", F.lower(e["entity"]), F.lower(text))
        return F.struct((place - 1).alias("start"), (place - 1 + F.length(e["entity"])).alias("end"), e["label"].alias("label"))

    return F.filter(F.transform(F.filter(entities, lambda e: F.length(e["entity"]) > 0), at), lambda s: s["start"] >= 0)


def without_overlaps(spans: Column) -> Column:
    """Spans by start, longer first, each kept if it begins where the last kept one has ended."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    none = F.slice(spans, 1, 0)
    start = F.struct(F.lit(0).alias("last"), none.alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)
    return F.aggregate(order, start, step, lambda a: a["out"])


def swept(starts, ends, begins, stops, labels) -> list[str | None]:
    """Tags of tokens (starts, ends, ascending) by spans (begins, stops, labels): a sweep over both that holds the open spans."""
    order = sorted(range(len(begins)), key=lambda k: begins[k])
    out, held, at = [], [], 0
    for start, end in zip(starts, ends, strict=True):
        while at < len(order) and begins[order[at]] < end:
            heapq.heappush(held, order[at])
            at += 1
        while held and stops[held[0]] <= start:  # no later token can meet it
            heapq.heappop(held)
        k = held[0] if held else None
        out.append("O" if k is None else None if labels[k] is None else ("B-" if start <= begins[k] else "I-") + labels[k])
    return out


def bio(offsets: Column, spans: Column) -> Column:
    """B-, I- or O for each token: B- if it holds a span's start, I- if it lies in one; the first of spans that overlap counts.

    offsets are in order of their starts. Null offsets or spans give null.
    """

    def run(starts: pd.Series, ends: pd.Series, begins: pd.Series, stops: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else swept(*row) for row in zip(starts, ends, begins, stops, labels, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")(offsets["start"], offsets["end"], spans["start"], spans["end"], spans["label"])


def valid_labels(labels: Column) -> Column:
    return F.forall(labels, lambda x: (x == "O") | x.rlike("^[BI]-.+"))


def label_ids(labels: Column, table: Mapping[str, int]) -> Column:
    """Numbers of labels; 0 for unknown ones."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(0)))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def valid_chat(messages: Column) -> Column:
    """Three messages in order, the last one JSON."""
    role = lambda i: F.get(messages, F.lit(i))["role"]
    return F.coalesce((F.size(messages) == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant") & is_json(F.get(messages, F.lit(2))["content"]), F.lit(False))


def prompt(turns: Sequence[tuple[str, Column]], opening: str = "<start_of_turn>", closing: str = "<end_of_turn>") -> Column:
    return F.concat(*[F.concat(F.lit(f"{opening}{role}\n"), text, F.lit(f"{closing}\n")) for role, text in turns])


def valid_prompt(text: Column, markers: Sequence[str]) -> Column:
    valid = F.lit(True)
    for m in markers:
        valid = valid & F.contains(text, F.lit(m))
    return valid


def loss_labels(ids: Column, marker: Sequence[int], ignore: int = -100) -> Column:
    """ids with what stands up to and with the marker's last occurrence ignored; all of it if there is no marker."""
    width = len(marker)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ids) - width + 1)), lambda i: F.slice(ids, i, F.lit(width)) == F.array(*[F.lit(m) for m in marker]))
    end = F.coalesce(F.array_max(starts) + width - 1, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignore), end), F.slice(ids, end + 1, F.greatest(F.lit(0), F.size(ids) - end)))
