"""Large JSON arrays, a file of which is read by many tasks.

Spark's JSON reader takes an array as one record and so gives a file to one task. Here files are read as text whose lines
end with a closing brace, which Spark splits by byte ranges like any text. A first pass finds, for each split, what it
does to the state (inside a string or not, depth of brackets) from either of the two states that a split can begin in;
folding these, one row a split, gives the state in which each really begins. A second pass cuts the elements out. An
element that runs over splits is put together again from its parts by a shuffle of these parts alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row of state is kept for each split of the files read: at most so many.
MOST_SPLITS = 1_000_000
_TOKEN = re.compile(r'["{\[\]]')
_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
NEVER = 1 << 60


def _tokens(row: str, quoted: bool) -> Iterator[tuple[int, str]]:
    """(place, bracket) outside strings, and at the end ('"' or '') whether the row ends inside one."""
    at = 0
    while True:
        if quoted:
            m = _STRING.match(row, at)
            if not m:
                break
            at, quoted = m.end(), False
        m = _TOKEN.search(row, at)
        if not m:
            break
        at, quoted = m.end(), m.group() == '"'
        if not quoted:
            yield m.start(), m.group()
    yield len(row), '"' if quoted else ""


def step(row: str, quoted: bool, depth: int, least: int) -> tuple[bool, int, int]:
    """The state after a row and the brace that ends it: inside a string or not, change of depth, least change after a closing."""
    for _, c in _tokens(row, quoted):
        if c in ("{", "["):
            depth += 1
        elif c == "]":
            depth -= 1
            least = min(least, depth)
        else:
            quoted = c == '"'
    return (True, depth, least) if quoted else (False, depth - 1, min(least, depth - 1))


def cut(rows: Iterable[str], quoted: bool, depth: int, base: int) -> Iterator[tuple[str, bool, bool]]:
    """(text, begins here, ends here) of the elements at depth base, from the state in which the split begins.

    After the array's closing bracket there are none.
    """
    parts: list[str] | None = [] if depth > base else None
    own = False
    for row in rows:
        start = 0
        for at, c in _tokens(row, quoted):
            if c in ("{", "["):
                if depth == base:
                    parts, start, own = [], at, True
                depth += 1
            elif c == "]":
                depth -= 1
                if depth < base:
                    return
                if depth == base:  # an element that is an array: no record; its end, where it began before this split
                    if not own:
                        yield "".join([*(parts or []), row[start : at + 1]]), False, True
                    parts = None
            else:
                quoted = c == '"'
        if parts is not None:
            parts.append(row[start:] + "}")
        if not quoted:
            depth -= 1
            if depth < base:
                return
            if depth == base and parts is not None:
                yield "".join(parts), own, True
                parts = None
    if parts is not None:
        yield "".join(parts), own, False


def _splits(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    rows = (x for b in batches for x in zip(b["file"], b["at"], b["value"], strict=True))
    for key, group in groupby(rows, key=lambda x: (x[0], int(x[1]))):
        yield key, (x[2] for x in group)


def elements(spark: SparkSession, path: str, under: str = "notes") -> DataFrame:
    """(file, value): the objects of the JSON array that each file under path holds, as text.

    A file is an array, or an object whose first member, named under, is one; elements that are no objects are left out,
    and so is whatever follows the array. Files of another form are an error. Braces, brackets and quotes inside strings
    are text. Files may be of any size; they are read twice.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, at), rows in _splits(batches):
            out, states = {"file": file, "at": at}, [(False, 0, NEVER), (True, 0, NEVER)]
            for row in rows:
                out.setdefault("head", row.lstrip("\ufeff \t\r\n")[:200])
                states = [step(row, *s) for s in states]
            for k, state in enumerate(states):
                out |= dict(zip((f"quoted{k}", f"depth{k}", f"least{k}"), state, strict=True))
            yield pd.DataFrame([out])

    each = "quoted{0} boolean, depth{0} long, least{0} long"
    found = text.mapInPandas(summed, f"file string, at long, head string, {each.format(0)}, {each.format(1)}").limit(MOST_SPLITS + 1).collect()
    if len(found) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: read fewer files, or larger splits")
    begins: dict[tuple[str, int], tuple] = {}
    for file, splits in groupby(sorted(found, key=lambda r: (r["file"], r["at"])), key=lambda r: r["file"]):
        quoted, depth, base, owner = False, 0, None, None
        for r in splits:
            if base is None:
                base = 1 if r["head"].startswith("[") else 2 if re.match(r'\{\s*"' + re.escape(under) + r'"\s*:\s*\[', r["head"]) else 0
                if not base and r["head"]:
                    raise ValueError(f"{file} holds no array, bare or under {under!r}")
            begins[file, r["at"]] = (quoted, depth, base, owner)
            least = depth + r[f"least{quoted:d}"]
            depth, quoted = depth + r[f"depth{quoted:d}"], r[f"quoted{quoted:d}"]
            if least < base:
                quoted, depth, base = False, 0, NEVER  # the array has ended: nothing is at this depth
            if depth <= base:
                owner = None
            elif owner is None or least <= base:
                owner = r["at"]
    known = spark.sparkContext.broadcast(begins)  # MOST_SPLITS rows at most

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for (file, at), held in _splits(batches):
                quoted, depth, base, owner = known.value[file, at]
                for value, own, ends in cut(held, quoted, depth, base):
                    yield file, at if own else owner, at, own and ends, value

        batch: list[tuple] = []
        size = 0
        for r in rows():
            batch.append(r)
            size += len(r[4])
            if size > 1 << 22:
                yield pd.DataFrame(batch, columns=["file", "owner", "at", "whole", "value"])
                batch, size = [], 0
        if batch:
            yield pd.DataFrame(batch, columns=["file", "owner", "at", "whole", "value"])

    made = text.mapInPandas(pieces, "file string, owner long, at long, whole boolean, value string")
    parts = made.where("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = parts.select("file", F.array_join(F.transform("p", lambda p: p["value"]), "").alias("value"))
    return made.where("whole").select("file", "value").unionByName(joined).where(F.startswith("value", F.lit("{")))
