"""Lexicons of any size in one pass over a text: an automaton finds all terms, flags and counts are read from its hits.

Patterns that stand for finitely many strings (alternatives, optional and listed characters, word borders at their ends)
are spelt out as terms. Others keep their pattern. The automaton is built once a Python worker.
"""

from __future__ import annotations

import bisect
import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping
from re import _parser as parser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pattern is spelt out as at most so many terms.
MOST = 4096
#: A lexicon is held by every worker: at most so many terms.
MOST_TERMS = 1_000_000


class Term(NamedTuple):
    """A literal, and whether a word must begin at its start and end at its end."""

    text: str
    begins: bool = False
    ends: bool = False


BORDER = object()


def _spelt(items: Iterable) -> list[tuple] | None:
    """The sequences of characters and borders that a parsed pattern stands for, in the order in which it tries them."""
    out: list[tuple] = [()]
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            part = [(chr(value),)]
        elif name == "AT" and str(value) == "AT_BOUNDARY":
            part = [(BORDER,)]
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
            codes = [c for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
            part = [(chr(c),) for c in codes]
        elif name == "BRANCH":
            parts = [_spelt(x) for x in value[1]]
            part = None if any(p is None for p in parts) else [x for p in parts for x in p]
        elif name == "SUBPATTERN":
            part = _spelt(value[3])
        elif name == "MAX_REPEAT" and value[1] <= 8 and value[0] <= value[1]:
            once = _spelt(value[2])
            part = None if once is None else []
            for n in range(value[1], value[0] - 1, -1) if once is not None else ():  # as many as possible first
                many: list[tuple] = [()]
                for _ in range(n):
                    many = [a + b for a in many for b in once]
                    if len(many) > MOST:
                        return None
                part += many
        else:
            return None
        if part is None or len(out) * len(part) > MOST:
            return None
        out = [a + b for a in out for b in part]
    return out


def terms(pattern: str) -> list[Term] | None:
    """The terms that a pattern stands for, first choices first; null if they are not finitely many literals."""
    spelt = _spelt(parser.parse(pattern))
    if spelt is None:
        return None
    found: dict[Term, None] = {}
    for s in spelt:
        begins, ends = bool(s) and s[0] is BORDER, len(s) > 1 and s[-1] is BORDER
        while s and s[0] is BORDER:
            s = s[1:]
        while s and s[-1] is BORDER:
            s = s[:-1]
        if not s or BORDER in s:
            return None
        found[Term("".join(s), begins, ends)] = None
    return list(found)


def lowered(text: str) -> str:
    """In lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Automaton:
    """All terms of named lists; for each name the hits are those of the pattern that tries its terms in their order."""

    def __init__(self, lists: Mapping[str, Iterable[Term]]):
        import ahocorasick

        self.names = list(lists)
        self.machine = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int, bool, bool]]] = {}
        for i, name in enumerate(self.names):
            for order, t in enumerate(lists[name]):
                uses.setdefault(lowered(t.text), []).append((i, order, t.begins, t.ends))
        for word, use in uses.items():
            self.machine.add_word(word, (len(word), use))
        if uses:
            self.machine.make_automaton()
        self.any = bool(uses)

    def all(self, text: str) -> list[tuple[int, int, int, int]]:
        """(name, start, place of the term in its list, end) of every term that stands in the text."""
        if not self.any:
            return []
        low = lowered(text)
        word = [False, *[c.isalnum() or c == "_" for c in low], False]  # of the character before each place
        found = []
        for last, (size, use) in self.machine.iter(low):
            start, end = last - size + 1, last + 1
            for i, order, begins, ends in use:
                if (not begins or word[start] != word[start + 1]) and (not ends or word[end] != word[end + 1]):
                    found.append((i, start, order, end))
        return found

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(name, start, end) by name and place; of those of a name that overlap the leftmost, then the first choice."""
        out, free = [], (-1, 0)
        for i, start, _, end in sorted(self.all(text)):
            if i != free[0] or start >= free[1]:
                out.append((i, start, end))
                free = (i, end)
        return out


_built: dict[int, tuple[dict, Automaton]] = {}


def _automaton(lists: dict) -> Automaton:
    """The lists' automaton, of which a worker keeps the last one."""
    key = hash(tuple((k, tuple(v)) for k, v in lists.items()))
    if key not in _built or _built[key][0] != lists:
        _built.clear()
        _built[key] = (lists, Automaton(lists))
    return _built[key][1]


#: Hits of so many texts are held at once: they can be far larger than the texts.
AT_ONCE = 256


def _listed(machine: Automaton, texts: pa.Array) -> pa.Array:
    """The hits of each text, in flat arrays and never as an object a hit; null where the text is null."""
    names, starts, ends, borders, gone = array("i"), array("i"), array("i"), array("i", [0]), []
    for text in texts:
        said = text.as_py()
        for i, a, b in machine.hits(said) if said is not None else ():
            names.append(i)
            starts.append(a)
            ends.append(b)
        borders.append(len(starts))
        gone.append(said is None)
    ints = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
    named = pa.array(machine.names, pa.string()).take(ints(names)) if machine.names else pa.array([], pa.string())
    rows = pa.StructArray.from_arrays([named, ints(starts), ints(ends)], ["name", "start", "end"])
    return pa.ListArray.from_arrays(ints(borders), rows, mask=pa.array(gone, pa.bool_()))


def hits(df: DataFrame, text_col: str, lists: Mapping[str, Iterable[Term | str]], name: str = "hits") -> DataFrame:
    """df with an array of (name, start, end) of the terms in its text, in any case; null where the text is null.

    start and end count characters from 0, end exclusive. A string in a list is a term between word borders. Empty terms
    are left out. Rows stay where they are. Letters and digits of all scripts and _ are word characters.
    """
    made = {k: [t if isinstance(t, Term) else Term(t, True, True) for t in v if (t.text if isinstance(t, Term) else t)] for k, v in lists.items()}
    if (many := sum(map(len, made.values()))) > MOST_TERMS:
        raise ValueError(f"{many} terms are more than {MOST_TERMS}: every worker would hold them")
    shared = df.sparkSession.sparkContext.broadcast(made)  # MOST_TERMS at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                found = _listed(machine, batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], name])

    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    one = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(one))])
    return df.withColumn(name, F.col(text_col).cast("string")).mapInArrow(run, schema)


def feeding(table: Mapping[str, str]) -> list[tuple[str, str]]:
    """(phrase, other) where what replaces a phrase could make another that is replaced later, alone or with the words beside it."""
    words = lambda t: re.findall(r"\w+", t.lower())
    inside = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))

    def makes(by: list[str], other: list[str]) -> bool:
        return inside(by, other) or inside(other, by) or any(by[-k:] == other[:k] or by[:k] == other[-k:] for k in range(1, min(len(by), len(other))))

    order = sorted(table, key=lambda k: -len(k))
    return [(k, other) for i, k in enumerate(order) for other in order[i + 1 :] if makes(words(table[k]), words(other))]


def substituted(text: str, machine: Automaton, phrases: list[str], table: Mapping[str, str]) -> str:
    """text with all phrases replaced at once: where some overlap the longest, then the first of the table, then the leftmost."""
    found = sorted((-len(phrases[order]), order, start, end) for _, start, order, end in machine.all(text))
    if not found:
        return text
    taken: list[tuple[int, int, int]] = []
    for _, order, start, end in found:
        at = bisect.bisect(taken, (start, end, order))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end, order))
    parts, last = [], 0
    for start, end, order in taken:
        parts += [text[last:start], table[phrases[order]]]
        last = end
    return "".join([*parts, text[last:]])


@functools.cache
def _cases() -> dict[str, str]:
    """The characters that lowered() makes into a character, for each that is not only its own."""
    upper: dict[str, str] = {}
    for c in map(chr, range(0x110000)):
        if (low := c.lower()) != c and len(low) == 1:
            upper[low] = upper.get(low, low) + c
    return upper


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _pattern(phrase: str) -> str:
    """A pattern of the built-in functions that matches where the automaton finds the phrase between word borders."""
    letters = "".join(f"[{_cases()[c]}]" if c in _cases() else re.escape(c) for c in lowered(phrase))
    ahead, behind = ("(?<!" if _word(phrase[0]) else "(?<="), ("(?!" if _word(phrase[-1]) else "(?=")
    return rf"{ahead}[\p{{L}}\p{{N}}_]){letters}{behind}[\p{{L}}\p{{N}}_])"


#: At most so many phrases are replaced by built-in functions, one after the other.
FEW = 64


def built_in(table: Mapping[str, str]) -> bool:
    """Whether substitute() replaces the table's phrases without Python: they are few, one after the other gives the same,
    and neither phrases nor what replaces them change where words end."""
    found = {k: v for k, v in table.items() if k}
    edges = all(v and _word(k[0]) == _word(v[0]) and _word(k[-1]) == _word(v[-1]) for k, v in found.items())
    return 0 < len(found) <= FEW and edges and not feeding(found) and not any(c in "σς" for k in found for c in lowered(k))


def _chained(text: Column, table: Mapping[str, str]) -> Column:
    phrases = sorted((k for k in table if k), key=lambda k: -len(k))
    out = text
    for k in phrases:
        out = F.regexp_replace(out, _pattern(k), table[k].replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(text.rlike("|".join(map(_pattern, phrases))), out).otherwise(text)  # most texts have none of them


def substitute(text: Column, table: Mapping[str, str]) -> Column:
    """Whole phrases replaced in one pass, longest first, in any case; null stays null.

    The same as replacing one phrase after the other, longest first, as long as no replacement helps to make a phrase
    (feeding() lists those that do): here a replacement is never replaced again.
    """
    if built_in(table):
        return _chained(text, table)
    phrases = [k for k in table if k]
    lists = {"": [Term(k, True, True) for k in phrases]}

    def run(texts: pd.Series) -> pd.Series:
        machine = _automaton(lists)
        return texts.map(lambda t: None if t is None else substituted(t, machine, phrases, table))

    return F.pandas_udf(run, "string")(text)


def _named(name: str) -> Callable[[Column], Column]:
    return lambda hit: hit["name"] == name


def flags(found: Column, names: Iterable[str], prefix: str = "") -> dict[str, Column]:
    """Whether a hit of each name is there, under the names that text.flags() gives; null without a text."""
    return {prefix + n.replace(" ", "_").lower(): F.exists(found, _named(n)) for n in names}


def counts(found: Column, names: Iterable[str]) -> dict[str, Column]:
    """How many hits of each name there are; 0 without a text."""
    return {n: F.coalesce(F.size(F.filter(found, _named(n))), F.lit(0)) for n in names}


def split(patterns: Mapping[str, str]) -> tuple[dict[str, list[Term]], dict[str, str]]:
    """(lists of the patterns that are terms, the other patterns)."""
    lists = {k: terms(p) for k, p in patterns.items()}
    return {k: v for k, v in lists.items() if v is not None}, {k: p for k, p in patterns.items() if lists[k] is None}
