"""Personal data: rule-checked base spans, and further ones that boosted trees select from overlapping candidates.

DataFrame functions only. Base spans are matches of four formats that pass their checks. High-recall generators propose
more spans; each has small integer features of its format and of the words before it. The trees are grown on a table of
sentences in which spans and their look-alikes are planted, so that a candidate's label is what was planted and no
function of its features; half of the table grows them, the other half calibrates them and sets a threshold for each
generator. They are applied as an expression, in the same narrow pass that finds the spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import boosting
from notemill.llm.common import cut

#: As specified, and written so that no run of characters is scanned twice: a match that starts inside a run would start
#: at the run's beginning (or where the last match ended), and possessive parts never give back what cannot help.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATES = {
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+",
    "key": r"(?<![A-Za-z0-9])[A-Z0-9]{16,64}(?![A-Za-z0-9])",
    "number": r"(?<![0-9])[0-9(][0-9\x20().-]{7,24}[0-9](?![0-9])",
    "mail": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}",
}
CONTEXT = 24
CONTEXTS = (r"pass|pwd|token|secret|key|auth", r"tel|phone|call|fax|contact|m[oó]vil", r"card|visa|iban|account|konto|carte|tarjeta", r"version|licen[sc]|chapter|page|vol")
FEATURES = ("gen", "long", "digits", "upper", "lower", "parts", "varied", "ending", "context")
ENDINGS = r"(?:com|org|net|edu|gov|info|de|fr|es|io)$"
#: Sentences of the planted table; half of them grow the trees.
PLANTED = 8_000
_CHUNK = 256


def _found(df: DataFrame, text: str, patterns: dict[str, str], applies: dict[str, Column]) -> DataFrame:
    """Adds for each pattern an array of (start, end, value, before): its leftmost non-overlapping matches, in code points.

    A match's end is the sum of the gaps and matches up to it; before is the end of what stands between it and the match
    ahead of it, that match included. Ends are summed in chunks, so that a text with very many matches costs no more than
    a few passes over their lengths.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_m_{k}": F.when(applies[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.slice(F.split(text, p, -1), F.lit(1), F.size(f"_m_{k}"))).otherwise(none) for k, p in patterns.items()})

    def ends(steps: Column) -> Column:
        def chunk(c: Column) -> Column:
            before = F.aggregate(F.slice(steps, F.lit(1), c * _CHUNK), F.lit(0), lambda a, x: a + x)
            start = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
            return F.aggregate(F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)), start, step, lambda a: a["out"])

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), chunk))

    df = df.withColumns({f"_n_{k}": F.zip_with(f"_g_{k}", f"_m_{k}", lambda g, m: F.length(g) + F.length(m)) for k in patterns})
    df = df.withColumns({f"_e_{k}": F.when(F.size(f"_m_{k}") > 0, ends(F.col(f"_n_{k}"))).otherwise(F.array().cast("array<int>")) for k in patterns})

    def span(k: str) -> Callable[[Column, Column], Column]:
        def of(e: Column, i: Column) -> Column:
            m = F.get(F.col(f"_m_{k}"), i)
            ahead = F.when(i > 0, F.get(F.col(f"_m_{k}"), i - 1)).otherwise("")
            before = F.right(F.concat(F.right(ahead, F.lit(CONTEXT)), F.get(F.col(f"_g_{k}"), i)), F.lit(CONTEXT))
            return F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"), before.alias("before"))

        return of

    spans = {f"_s_{k}": F.transform(f"_e_{k}", span(k)) for k in patterns}
    return df.withColumns(spans).drop(*[f"_{x}_{k}" for k in patterns for x in "mgne"])


def _mask(spans: Column) -> Column:
    """A byte a character up to the last of ordered spans that do not overlap: 1 inside of them. Empty without spans."""
    gap = lambda x, i: x["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    return F.array_join(F.transform(spans, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.repeat(F.lit("1"), x["end"] - x["start"]))), "").cast("binary")


def _covered(masks: list[str]) -> Callable[[Column], Column]:
    """Whether a span holds a character that a mask has: one look at its own bytes of each mask."""

    def of(s: Column) -> Column:
        hit = F.lit(False)
        for m in masks:
            hit = hit | F.contains(F.substring(F.col(m), s["start"] + 1, s["end"] - s["start"]), F.lit(b"1"))
        return hit

    return of


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Of 13 to 19 digits; leading zeros to 19 places leave the sum as it is."""
    padded = F.lpad(_digits(value), 19, "0")
    digit = lambda i: F.ascii(F.substring(padded, i, F.lit(1))) - 48
    summed = F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return F.length(_digits(value)).between(13, 19) & (summed % 10 == 0)


def _octets(value: Column) -> Column:
    """Each part is at most 255, whatever zeros lead it."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


VALID = {"email": lambda v: F.lit(True), "ip": _octets, "card": _luhn, "phone": lambda v: F.length(_digits(v)).between(9, 15)}


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: VALID[kind](span["value"])


def _base(df: DataFrame) -> DataFrame:
    number = F.col("_t").rlike("[0-9]")
    applies = {k: (number if k != "email" else F.lit(True)) & (F.contains("_t", F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True)) for k in BASE}
    found = _found(df, "_t", BASE, applies)
    return found.withColumns({f"_s_{k}": F.filter(f"_s_{k}", _checked(k)) for k in BASE})


def _featured(df: DataFrame) -> DataFrame:
    """Adds for each generator k _c_k, its candidates outside base spans as (gen, start, end, features)."""
    low = F.lower("_t")
    number = F.col("_t").rlike("[0-9]")
    applies = {"secret": low.rlike("passw|pwd|token|secret|key"), "key": F.col("_t").rlike("[A-Z0-9]{16}"), "number": number, "mail": low.contains("dot")}
    df = _found(df, "_t", CANDIDATES, applies).withColumns({f"_b_{k}": _mask(F.col(f"_s_{k}")) for k in BASE})
    free = _covered([f"_b_{k}" for k in BASE])

    def facts(i: int, k: str) -> Callable[[Column], Column]:
        def of(s: Column) -> Column:
            value = F.regexp_extract(s["value"], r"[^\s\"'=:]+$", 0) if k == "secret" else s["value"]
            size, digits = F.length(value), F.length(_digits(value))
            before = F.lower(F.concat(s["before"], F.left(s["value"], F.length(s["value"]) - size)))
            context = F.lit(0)
            for j, p in reversed(list(enumerate(CONTEXTS, 1))):
                context = F.when(before.rlike(p), j).otherwise(context)
            parts = size - F.length(F.regexp_replace(value, r"[\s().-]", ""))
            distinct = F.size(F.array_distinct(F.split(value, "")))
            return F.struct(
                F.lit(i).alias("gen"), (s["end"] - size).alias("start"), s["end"].alias("end"),
                F.when(size < 12, 0).when(size < 17, 1).when(size < 25, 2).otherwise(3).alias("long"), F.when(digits == 0, 0).when(digits * 2 < size, 1).when(digits < size, 2).otherwise(3).alias("digits"),
                value.rlike("[A-Z]").cast("int").alias("upper"), value.rlike("[a-z]").cast("int").alias("lower"), F.when(parts == 0, 0).when(parts < 3, 1).otherwise(2).alias("parts"),
                F.when(distinct < 6, 0).when(distinct < 9, 1).when(distinct < 13, 2).otherwise(3).alias("varied"), F.lower(value).rlike(ENDINGS).cast("int").alias("ending"), context.alias("context"),
            )

        return of

    return df.withColumns({f"_c_{k}": F.filter(F.transform(f"_s_{k}", facts(i, k)), lambda s: ~free(s)) for i, k in enumerate(CANDIDATES)})


def planted(spark: SparkSession, rows: int = PLANTED, seed: int = 1) -> DataFrame:
    """(_t, _start, _end, _real): sentences with a span or a look-alike each, made from hashes of the row's number.

    Contexts go with what is real only five times in six, and forms are drawn from ranges that overlap.
    """
    draw = lambda *k: F.xxhash64(F.col("id"), F.lit(seed), *k)
    below = lambda n, k: F.pmod(draw(F.lit(k)), F.lit(n)).cast("int")
    one_of = lambda k, *options: F.element_at(F.array(*[F.lit(o) for o in options]), below(len(options), k) + 1)

    def letters(alphabet: str, many: Column | int, k: str) -> Column:
        many = F.lit(many) if isinstance(many, int) else many
        pick = lambda i: F.substring(F.lit(alphabet), F.pmod(draw(F.lit(k), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), many), pick), "")

    low, high, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def any_shape(k: str, *shapes: str) -> Column:
        """One of the shapes, with the row's digits for d."""
        digits = letters(digit, 24, k + "d")
        return F.array_join(F.transform(F.split(one_of(k, *shapes), ""), lambda c, i: F.when(c == "d", F.substring(digits, i + 1, F.lit(1))).otherwise(c)), "")

    kind, real = below(4, "kind"), below(2, "real") == 1
    usual = F.when(below(6, "noise") == 0, ~real).otherwise(real)
    word = lambda k: letters(low, 3 + below(6, k + "n"), k)
    secret = F.when(real, F.when(below(3, "s") == 0, letters(low + digit, 8 + below(24, "sn"), "sa")).otherwise(letters(low + high + digit + "_-!$", 8 + below(24, "sn"), "sb"))).otherwise(F.when(below(4, "s") == 0, any_shape("sd", "dddddd")).otherwise(letters(low, 6 + below(8, "sn"), "sc")))
    key = F.when(real, letters(high + digit, 16 + below(32, "kn"), "ka")).otherwise(F.when(below(2, "k") == 0, letters(high, 16 + below(10, "kn"), "kb")).otherwise(letters(digit, 16 + below(10, "kn"), "kc")))
    number = F.when(real, any_shape("np", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "0dd dddd dddd", "ddd-dd-dddd", "00dd ddd ddddddd")).otherwise(any_shape("nn", "d.dd.ddd.dd", "dddd-dd-dd dd.dd", "ddd-ddd (dddd)", "d ddd ddd", "dd.dd.dddd", "ddd ddd.dd"))
    ending = F.when(real, one_of("me", "com", "org", "net", "edu", "de", "fr", "es", "io")).otherwise(letters(low, 2 + below(6, "mn"), "mx"))
    mail = F.concat(word("ma"), one_of("at", " at ", "[at]", "(at)"), word("mb"), one_of("dot", " dot ", "[dot]", "(dot)"), ending)
    lead = F.when(kind == 0, F.concat(one_of("c0", "password", "passwd", "token", "secret", "api_key", "access-key"), one_of("c1", "=", ": ", " = ", ":")))
    lead = lead.when((kind == 1) & usual, one_of("c2", "key ", "auth token ", "access ", "secret key ", "")).when(kind == 1, one_of("c3", "version ", "the ", "page ", ""))
    lead = lead.when((kind == 2) & usual, one_of("c4", "call ", "tel ", "phone: ", "contact ", "fax ", "")).when(kind == 2, one_of("c5", "version ", "page ", "vol ", "chapter ", "in ", ""))
    lead = lead.when(usual, one_of("c6", "mail ", "contact ", "write to ", "")).otherwise(one_of("c7", "we met ", "look ", "then ", ""))
    span = F.when(kind == 0, secret).when(kind == 1, key).when(kind == 2, number).otherwise(mail)
    made = spark.range(rows).select(F.concat(word("w0"), F.lit(" "), word("w1"), F.lit(" "), lead).alias("_lead"), span.alias("_span"), word("w2").alias("_tail"), real.alias("_real"))
    start = F.length("_lead")
    return made.select(F.concat("_lead", "_span", F.lit(" "), "_tail").alias("_t"), start.alias("_start"), (start + F.length("_span")).alias("_end"), "_real")


def examples(spark: SparkSession, rows: int = PLANTED, seed: int = 1) -> list[tuple[int, tuple[int, ...], float, float]]:
    """(half, features, hits, candidates) of the planted table's candidates: at most a row for each, and few are distinct."""
    seen = _featured(_base(cut(planted(spark, rows, seed)).withColumn("_half", F.pmod(F.xxhash64("_t"), F.lit(2)).cast("int"))))
    each = seen.select("_half", "_start", "_end", "_real", F.inline(F.concat(*[F.col(f"_c_{k}") for k in CANDIDATES])))
    hit = F.col("_real") & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end"))
    counts = each.groupBy("_half", *FEATURES).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).collect()  # at most PLANTED x 4 rows
    return sorted((r["_half"], tuple(r[f] for f in FEATURES), float(r["hits"]), float(r["n"])) for r in counts)


#: Models by their parameters: the planted table is the same whatever is searched.
_fitted: dict[tuple[float, int], tuple[boosting.Boosted, list[float]]] = {}


def fitted(spark: SparkSession, precision: float = 0.95, trees: int = 25) -> tuple[boosting.Boosted, list[float]]:
    """The calibrated trees and each generator's least probability, from the planted table."""
    if (precision, trees) not in _fitted:
        _fitted[precision, trees] = _fit(spark, precision, trees)
    return _fitted[precision, trees]


def _fit(spark: SparkSession, precision: float, trees: int) -> tuple[boosting.Boosted, list[float]]:
    counts = examples(spark)
    grown, check = ([r[1:] for r in counts if r[0] == half] for half in (0, 1))
    model = boosting.calibrate(boosting.boost(grown, trees), check)
    return model, [boosting.threshold(model, [r for r in check if r[0][0] == g], precision) for g in range(len(CANDIDATES))]


def _spanned(docs: DataFrame, text_col: str, precision: float, trees: int) -> DataFrame:
    """(_doc, _t, base, added): docs' rows, their texts and spans, in one narrow pass."""
    model, least = fitted(docs.sparkSession, precision, trees)
    start = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    found, masks, added = _featured(_base(start)), [], []

    def kept(at: float, before: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: (model.column([x[f] for f in FEATURES]) >= F.lit(at)) & ~before(x)

    for i, k in enumerate(CANDIDATES):  # of overlapping candidates the first generator's stays
        chosen = F.filter(f"_c_{k}", kept(least[i], _covered(list(masks))))
        found = found.withColumn(f"_k_{k}", F.when(F.size(f"_c_{k}") > 0, chosen).otherwise(F.col(f"_c_{k}"))).withColumn(f"_km_{k}", _mask(F.col(f"_k_{k}")))
        masks.append(f"_km_{k}")
        added.append(_slim(F.col(f"_k_{k}"), k))
    return found.select("_doc", "_t", F.concat(*[_slim(F.col(f"_s_{k}"), k) for k in BASE]).alias("base"), F.concat(*added).alias("added"))


def _slim(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def spans(docs: DataFrame, precision: float = 0.95, trees: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, added) of every row: arrays of (kind, start, end), in code points, end exclusive.

    Null texts count as empty; texts of any length are read whole; rows repeated with one id are searched each; null ids
    are as good as others; other columns are not read; an empty table gives an empty result. Added spans have kinds of
    their own (secret, key, number, mail), do not overlap base spans, and of overlapping ones the first generator's stays.
    """
    return _spanned(docs.select(id_col, text_col), text_col, precision, trees).select(F.col("_doc")[id_col].alias(id_col), "base", "added")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their checksum, and all spans as text."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, precision: float = 0.95, trees: int = 25, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    Spans are found and replaced in one pass over the rows, so ids may be null or repeated; null texts stay null. The
    parts between spans are cut out one by one, which costs a text's length for each of its spans.
    """
    found = _spanned(docs, text_col, precision, trees)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"], x["end"], x["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(F.col("_t"), a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        mark = F.when(s["start"] >= a["at"], F.array(F.concat(between, F.lit("["), s["kind"], F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], mark).alias("out"))

    done = F.aggregate("_order", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("_t"), a["at"] + 1, F.length("_t"))))
    text = F.when(F.size("_order") > 0, done).otherwise(F.col("_doc")[text_col])
    return found.withColumn("_order", order).select(*[text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
