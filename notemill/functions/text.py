"""String expressions. All are built-in column expressions; patterns are literals, so that they are compiled once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words before whose full stop no sentence ends.
ABBREVIATIONS = ("dr", "dra", "mr", "mrs", "ms", "prof", "sr", "sra", "st", "vs", "approx", "no", "nr", "fig", "dept", "pt", "pts", "hx", "dx", "tx", "rx", "sx", "abd", "resp", "neuro", "ext", "temp", "i.e", "e.g", "etc", "cf", "p.o", "p.r.n", "q.d", "b.i.d", "t.i.d", "q.i.d", "i.v", "i.m", "s.c", "a.m", "p.m", "h.s")


def _fold_map() -> tuple[str, str]:
    """Letters of the Latin blocks whose NFKD form is one letter and combining marks."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_FROM, _TO = _fold_map()


def _ascii(text: Column) -> Column:
    """Whether all characters are ASCII: then there are no accents, and the dear Unicode classes of patterns are the plain ones."""
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Without accents and in lower case."""
    return F.lower(F.when(_ascii(text), text).otherwise(F.translate(text, _FROM, _TO)))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def key(text: Column) -> Column:
    """What two spellings of one entity share: folded, stripped, runs of white space as one space."""
    return F.when(text.rlike(r"\s"), F.regexp_replace(fold(strip(text)), r"\s+", " ")).otherwise(fold(text))


def _firsts(items: Iterable) -> set[str] | None:
    """The characters with which a match of a parsed pattern can begin, if they are listed ASCII ones."""
    for kind, value in items:
        name = str(kind)
        if name == "AT" and str(value) == "AT_BOUNDARY":
            continue
        if name == "LITERAL":
            found = {chr(value)}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            found = {chr(v) for _, v in value}
        elif name == "BRANCH":
            parts = [_firsts(x) for x in value[1]]
            found = set().union(*parts) if all(parts) else set()
        elif name == "SUBPATTERN":
            found = _firsts(value[3]) or set()
        elif name == "MAX_REPEAT" and value[0] > 0:
            found = _firsts(value[2]) or set()
        else:
            return None
        return found if found and all(c.isascii() for c in found) else None
    return None


def _eager(pattern: str) -> str:
    """The pattern for ASCII texts in any case; most places fail at the first letter where that can be listed."""
    try:
        found = _firsts(parser.parse(pattern))
    except re.error:  # what only Spark's patterns know
        found = None
    ahead = "".join(re.escape(c) for c in sorted({x for c in found for x in (c.lower(), c.upper())})) if found else ""
    return f"(?i)(?=[{ahead}])(?:{pattern})" if ahead else f"(?i){pattern}"


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs, in any case, with letters of all scripts as word characters. Null stays null."""
    return F.when(_ascii(text), text.rlike(_eager(pattern))).otherwise(text.rlike(f"(?iU){pattern}"))


def count(text: Column, pattern: str) -> Column:
    counted = lambda made: F.regexp_count(text, F.lit(made))
    return F.coalesce(F.when(_ascii(text), counted(_eager(pattern))).otherwise(counted(f"(?iU){pattern}")), F.lit(0))


def section(text: Column, header: str, following: Iterable[str]) -> Column:
    """What stands between a header and the first of the headers that may follow, stripped; null if it is not there."""
    pattern = "(?is)" + re.escape(header) + "(.*?)(?:" + "|".join(map(re.escape, following)) + ")"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def sections(text: Column, table: Mapping[str, tuple[str, Iterable[str]]]) -> Column:
    """A map of all of table's sections, each as section() gives it, from one cut of the text at all headers.

    The text is cut where any header or following header begins, overlapping ones included; sections are runs of pieces.
    Select it as a column of its own, so that all that read it share the cut. A header must not hold the beginning of
    another within itself. Null without a text.
    """
    wanted = {name: (header.lower(), [f.lower() for f in following]) for name, (header, following) in table.items()}
    tokens = sorted({t for header, following in wanted.values() for t in (header, *following)}, key=lambda t: (-len(t), t))
    for header, _ in wanted.values():
        if any(header[k:].startswith(t[: len(header) - k]) for k in range(1, len(header)) for t in tokens):
            raise ValueError(f"another header begins within {header!r}")
    starting = lambda with_: [t for t in tokens if any(t.startswith(w) for w in with_)]  # noqa: E731  the longest is what a cut is known by
    letters = "".join(re.escape(c) for c in sorted({t[0] for t in tokens}))
    begins = f"(?i)(?=[{letters}])(?=({'|'.join(map(re.escape, tokens))}))"  # most places fail at the first letter
    marked = F.concat(F.lit("\n"), text)  # a cut at the very beginning would be none

    def found(cut: Column, header: str, following: list[str]) -> Column:
        flags = lambda with_: F.transform(cut["heads"], lambda h: h.isin(*starting(with_)))
        first = F.array_position(flags([header]), True).cast("int")
        rest = F.slice(flags(following), first + 1, F.size(cut["heads"]))
        many = F.array_position(rest, True).cast("int")
        body = F.substring(F.array_join(F.slice(cut["pieces"], first + 1, many), ""), len(header) + 1, 2**31 - 1)
        return F.when((first > 0) & (many > 0), strip(body))

    heads = F.transform(F.regexp_extract_all(marked, F.lit(begins), F.lit(1)), F.lower)
    cut = F.array(F.struct(heads.alias("heads"), F.split(marked, begins, -1).alias("pieces")))
    made = F.transform(cut, lambda c: F.create_map(*[x for name, (header, following) in wanted.items() for x in (F.lit(name), found(c, header, following))]))
    return F.when(text.isNotNull(), F.get(made, F.lit(0)))


def capture(text: Column, pattern: str) -> Column:
    """The first group of the first match; null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def flags(text: Column, lexicon: Mapping[str, str], prefix: str = "") -> dict[str, Column]:
    """A boolean column for each entry, its name in lower case with _ for spaces."""
    return {prefix + name.replace(" ", "_").lower(): has(text, pattern) for name, pattern in lexicon.items()}


def negated(text: Column, negators: Iterable[str], terms: Iterable[str], reach: int = 3) -> Column:
    """Whether a term follows a negator at most `reach` words later, anywhere in the text."""
    return has(text, rf"\b({'|'.join(negators)})\b(?:\s+\w+){{0,{reach}}}\s+({'|'.join(terms)})\b")


def mentioned(text: Column, terms: Iterable[str]) -> Column:
    return has(text, rf"\b({'|'.join(terms)})\b")


def without_first_block(text: Column) -> Column:
    """Without the first block between two lines that begin with ===."""
    return F.regexp_replace(text, r"(?ms)\A(.*?)^={3,}.*?^={3,}(.*)\z", "$1$2")


def canonical(name: Column, aliases: Mapping[str, str]) -> Column:
    """The alias' canonical name, or the name as it is."""
    table = F.create_map(*[F.lit(x) for kv in {**aliases, **{v.lower(): v for v in aliases.values()}}.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), name)


def head_tail(text: Column, most: int, mark: str = "\n[...]\n") -> Column:
    """Texts of over `most` characters as their first and last (most - 20) // 2, with a mark between."""
    half = (most - 20) // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def phrases(text: Column, table: Mapping[str, str]) -> Column:
    """Whole phrases replaced one after the other, longest first, in any case."""
    for phrase, by in sorted(table.items(), key=lambda kv: -len(kv[0])):
        text = F.regexp_replace(text, rf"(?iU)\b{re.escape(phrase)}\b", by.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def before_marker(text: Column, marker: str) -> Column:
    """What stands before the first marker, without blanks, dashes and colons at its ends."""
    return F.btrim(F.get(F.split(text, f"(?iU){marker}", 2), F.lit(0)), F.lit(" -–—:"))


def contains_word(longer: Column, shorter: Column) -> Column:
    return F.rlike(longer, F.concat(F.lit(r"(?U)\b\Q"), shorter, F.lit(r"\E\b")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of more than `least` characters, split after . ! ? or at line ends: a rule in place of a model."""
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > least)


def clinical_sentences(text: Column, least: int = 10, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """Sentences of more than `least` characters of a clinical text.

    One ends at a line's end, and after . ! or ? (with closing quotes or brackets) before a blank and what can begin the
    next: a capital, a digit, an opening quote or bracket. Not after an abbreviation, an initial (one capital), or the
    number of a list item at a line's beginning; decimals hold no blank. Wrapped lines go on where the next line begins
    in lower case.
    """
    short = "|".join(re.escape(a) for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    stop = r"(?:(?<=[.!?])|(?<=[.!?][\"')\]]))"
    not_after = rf"(?<!(?i:(?:^|[^\p{{L}}\p{{N}}.])(?:{short}))\.)(?<!(?:^|[^\p{{L}}\p{{N}}])\p{{Lu}}\.)(?<!(?:^|\n)[ \t]{{0,8}}\d{{1,2}}\.)"
    parts = F.split(text, rf"{stop}{not_after}[ \t]+(?=[\p{{Lu}}\p{{N}}\"'(\[])|[ \t]*\n+(?![ \t]*\p{{Ll}})|\n{{2,}}")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(strip(s), r"\s*\n\s*", " ")), lambda s: F.length(s) > least)


def chunks(items: Column, size: int, overlap: int) -> Column:
    """Windows of `size` items that share `overlap`; the last is the first that reaches the end."""
    step = size - overlap
    many = F.greatest(F.lit(1), F.ceil((F.size(items) - overlap) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(items, i * step + 1, F.lit(size)))
    return F.when(F.size(items) > 0, windows).otherwise(F.slice(F.array(items), 1, 0))


def filled(text: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else: the built-in parsers would take one with anything behind it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def json_length(value: Column) -> Column:
    """Length of compact JSON with a blank after each comma and colon between items, outside strings."""
    bare = F.regexp_replace(value, r'"(?:[^"\\]|\\.)*+"', "s")
    return F.length(value) + F.regexp_count(bare, F.lit("[,:]"))
