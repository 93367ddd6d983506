"""Queries with the default lexicons, over notes and entity lists in which their terms are planted.

A note has the usual sections; what stands in them follows from the document's id, and its course is the document's
whole text. Both engines build it from one template.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import checks, cohort, entities, features, lexicon
from notemill.plans.base import dealt, documents, table

TEXT = object()
#: Literal parts, the document's text, and choices (factor, options): the option at id x factor modulo their number.
TEMPLATE = (
    "=== visit\nhiv tb rpr\n=== end\n",
    (1, ("History of Present Illness:\n", "History of Present Illness:\n", "History of Present Illness:\n", "Interval history:\n")),
    (3, ("fever with headache and chills. ", "no complaint, some nausea. ", "joint pain and a rash. ", "febrile, myalgia. ", "fatigue. ", "denies any fever or vomiting. ", "")),
    (5, ("Recently traveled to the tropics.\n", "No trip.\n", "At home.\n")),
    "Past Medical History:\n",
    (1, ("diabetes and htn", "hypertension", "dm2, low platelets", "none", "diabetic foot")),
    "\nSocial History: none\nPhysical Exam:\n",
    (1, ("Temp: 101.2", "T 99.1", "T=100.9, later 98.0", "afebrile", "temp 97.5")),
    "\nBrief Hospital Course:\n",
    TEXT,
    (1, ("\nplts were 90, pending", "\nCD4 low on truvada; tuberculosis ruled out", "\nrpr and vdrl negative, no growth", "\nquantiferon indeterminate, 5 mg oral bid, 1 tablet daily prn", "\nsyphilis possible, awaiting afb, treponemal test", "")),
    "\nMedications on Admission:\n",
    (1, ("tylenol", "chloroquine and advil", "doxycycline", "none")),
    "\nDischarge Medications: none\nDischarge Diagnosis:\n",
    (1, ("HIV infection", "pulmonary tuberculosis", "neurosyphilis", "viral meningitis", "dengue", "malaria", "hepatitis C", "measles", "fracture", "chagas disease", "yellow fever")),
    "\nDischarge Condition: good\n",
)
#: What a course ends with, and its last sentence.
SAID = (
    "Seen by Dr. Silva at 9 a.m. today. Given 2.5 mg p.o. b.i.d. for pain.",
    "Temp. 38.2 at night. Pt. A. Costa vs. control.",
    "1. Aspirin 100 mg daily.",
    "He was stable (see note.) Discharged home, e.g. on foot.",
)
TARGETS = ("hiv", "Tuberculosis", "Sifilis", "syphilis", "dengue", "HIV")
DISEASE, SYMPTOM, DRUG, LAB, PROCEDURE, ORGANISM = lexicons.CATEGORIES
#: Entity lists by id modulo their number.
LISTS = (
    ((DISEASE, ("Hipertensão", "HAS", "Derrame pleural", "diabetes", "Diabetes Mellitus")), (SYMPTOM, ("Febre", "rash", "dor")), (LAB, ("HIV negativo", "SpO2 97%", "hemoglobina"))),
    ((DISEASE, ("HIV", "febre", "Tuberculose")), (DRUG, ("Tylenol", "paracetamol", "Tylenol")), (LAB, ("hiv - negativo", "tuberculose: pendente", "Temperatura 38"))),
    ((DISEASE, ("Nódulo pulmonar", "hiperlipidemia", "dislipidemia")), (SYMPTOM, ("nausea", "chest pain", "nausea")), (PROCEDURE, ("radiografia",)), (ORGANISM, ("HBV", "hbv"))),
    ((DISEASE, ("sífilis",)), (ORGANISM, ("Treponema pallidum", "sifilis")), (LAB, ("Treponema pallidum not detected", "FC 80", "pa 120"))),
    ((SYMPTOM, ("paciente", "tosse seca", "cough")), (DISEASE, ("paciente", "Atelectasia", "opacidade, leve"))),
)


def _pick(factor: int, options: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.col("doc_id") * factor, F.lit(len(options))) + 1).cast("int"))


def notes(spark, d, even=False):
    """(doc_id, target, note), in letters that both engines' word boundaries know. even: documents are dealt out for work
    that takes far longer than a shuffle, as files may have fewer row groups than there are cores."""
    course = F.replace(text.fold(F.coalesce("text", F.lit(""))), F.lit("ß"), F.lit("ss"))
    parts = [course if p is TEXT else F.lit(p) if isinstance(p, str) else _pick(*p) for p in TEMPLATE]
    docs = documents(spark, d).select("doc_id", "text")
    return (dealt(docs) if even else docs).select("doc_id", _pick(1, TARGETS).alias("target"), F.concat(*parts).alias("note"))


def cut_notes(spark, d):
    """The notes with all their sections, found in one pass."""
    return notes(spark, d).withColumn("cut", features.sections(F.col("note")))


def symptom_alert(spark, d):
    flags = features.symptoms(F.col("note"))
    flagged = notes(spark, d).select("doc_id", *[c.alias(k) for k, c in flags.items()])
    return flagged.withColumn("alert", features.alert({k: F.col(k) for k in flags}))


def disease_labels(spark, d):
    return notes(spark, d).select("doc_id", *[c.alias(k) for k, c in features.labels(F.col("note")).items()])


def clinical_context(spark, d):
    return cut_notes(spark, d).select("doc_id", *[c.alias(k) for k, c in features.context(F.col("note"), F.col("cut")).items()])


def laboratory_features(spark, d):
    return notes(spark, d).select("doc_id", *[c.alias(k) for k, c in features.laboratory(F.col("note")).items()])


def note_sections(spark, d):
    """Each section of each note."""
    cut = cut_notes(spark, d).select("doc_id", F.explode("cut").alias("section", "body"))
    return cut.select("doc_id", "section", F.length("body").alias("size"), F.md5(F.col("body").cast("binary")).alias("digest"))


#: Lexicons that are looked up in whole notes together, and what their columns begin with.
TOGETHER = {**{f"s_{k}": p for k, p in lexicons.SYMPTOMS.items()}, **{f"d_{k}": p for k, p in lexicons.LABELS.items()}}
COUNTED = {**lexicons.MENTIONS, **{k: lexicons.COMPLEXITY[k] for k in ("negations", "pending", "differentials")}}


def note_lexicons(spark, d):
    """Flags of all symptoms and diseases and counts of mentions, over whole notes in one pass."""
    lists, other = lexicon.split({**TOGETHER, **COUNTED})
    found = lexicon.hits(notes(spark, d).select("doc_id", "note"), "note", lists)
    flagged = lexicon.flags(F.col("hits"), [k for k in TOGETHER if k in lists]) | text.flags(F.col("note"), {k: p for k, p in other.items() if k in TOGETHER})
    counted = lexicon.counts(F.col("hits"), [k for k in COUNTED if k in lists]) | {k: text.count(F.col("note"), p) for k, p in other.items() if k in COUNTED}
    return found.select("doc_id", *[c.alias(k) for k, c in flagged.items()], *[c.cast("int").alias(f"n_{k}") for k, c in counted.items()])


def vocabulary_hits(spark, d):
    """Where the words of all passages stand in the documents: a lexicon of thousands of terms, in one pass."""
    plain = lambda c: F.regexp_replace(text.fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]", " ")
    words = table(spark, d, "benchmark").select(F.explode(F.split(plain(F.col("text")), " +")).alias("w")).where("w <> ''").distinct()
    held = [r["w"] for r in words.orderBy("w").limit(lexicon.MOST_TERMS + 1).collect()]  # hits() refuses more
    found = lexicon.hits(documents(spark, d).select("doc_id", plain(F.col("text")).alias("t")), "t", {"word": held})
    places = F.transform("hits", lambda h: F.concat_ws(":", h["start"].cast("string"), h["end"].cast("string")))
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.md5(F.array_join(places, ",").cast("binary")).alias("places"))


def target_coverage(spark, d):
    counted = notes(spark, d).select("doc_id", text.canonical(F.col("target"), lexicons.ALIASES).alias("target"), features.target_mentions(F.col("note"), F.col("target")).cast("int").alias("n"))
    return counted.withColumn("coverage", cohort.coverage(F.col("n")))


def note_complexity(spark, d):
    return notes(spark, d, even=True).select("doc_id", F.length("note").alias("size"), features.complexity(F.col("note")).alias("score"))


POOL = tuple((c, e) for lists in LISTS for c, items in lists for e in items)
WORDS = "[A-Z][a-z]+"


def clinical_entities(spark, d):
    """Each document's capitalised words as its entities, long: half of them, by length, letter and place, stand for a term of POOL."""
    terms = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(e).alias("entity")) for c, e in POOL])
    own = F.array(*[F.lit(c) for c in lexicons.CATEGORIES])
    docs = dealt(documents(spark, d).select("doc_id", "text"))
    each = docs.select(F.col("doc_id").alias("record_id"), F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("pos", "word"))
    at = (F.length("word") * 31 + F.ascii("word") * 7 + F.col("pos")) % (2 * len(POOL))
    term = F.get(terms, at)
    category = F.coalesce(term["category"], F.get(own, at % len(lexicons.CATEGORIES)))
    return each.select("record_id", category.alias("category"), "pos", F.coalesce(term["entity"], F.lower("word")).alias("entity"))


def _contexts(spark, d):
    return documents(spark, d).select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("context"))


def qc_eight_checks(spark, d):
    return checks.all_checks(clinical_entities(spark, d), _contexts(spark, d), dealt=True).distinct()


def qc_runner(spark, d):
    """Issues and records by check, over all eight."""
    return checks.summary(checks.all_checks(clinical_entities(spark, d), _contexts(spark, d), dealt=True))


def note_sentences(spark, d):
    """Sentences of the notes' courses, with clinical phrases between the document's own sentences."""
    phrase = _pick(7, SAID)
    body = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ,.!?\n]", ""), F.lit("\n\n"), phrase)
    split = documents(spark, d).select("doc_id", F.posexplode(text.clinical_sentences(body, 0)).alias("n", "sentence"))
    return split.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max_by("sentence", "n").alias("last"), F.sum(F.length("sentence")).alias("chars"))


def qc_report(spark, d):
    """A report for each document: its entities, its issues by check, and the issues themselves."""
    ids = documents(spark, d).select(F.col("doc_id").alias("record_id"))
    made = checks.report(clinical_entities(spark, d), _contexts(spark, d), ids, dealt=True)
    line = lambda i: F.concat_ws("|", i["check"], F.coalesce(i["category"], F.lit("-")), F.coalesce(i["entity"], F.lit("-")), i["detail"])
    listed = F.array_join(F.array_sort(F.transform("issues", line)), ";")
    return made.select("record_id", "n_entities", "n_issues", *[F.element_at("by_check", k).cast("long").alias(f"n_{k}") for k in checks.CHECKS], F.md5(listed.cast("binary")).alias("issues"))


def clinical_layers(spark, d):
    return entities.layered(clinical_entities(spark, d), dealt=True)


def clinical_steps(spark, d):
    return entities.clean(clinical_entities(spark, d), entities.canonical_table(spark), dealt=True)


def layer_stats(spark, d):
    """What each of the five layers touches, with five examples."""
    counted = entities.layer_counts(clinical_entities(spark, d), dealt=True)
    return counted.select("layer", "n", F.array_join("examples", "; ").alias("examples"))


QUERIES = {f.__name__: f for f in (symptom_alert, disease_labels, clinical_context, laboratory_features, note_sections, note_lexicons, vocabulary_hits, target_coverage, note_complexity, qc_eight_checks, qc_runner, note_sentences, qc_report, clinical_layers, clinical_steps, layer_stats)}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pick_sql(factor: int, options: tuple[str, ...]) -> str:
    return f"[{', '.join(_quoted(o).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) for o in options)}][CAST(doc_id * {factor} % {len(options)} AS INTEGER) + 1]"


_COURSE = "replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss')"
_NOTE = "concat(" + ", ".join(_COURSE if p is TEXT else _quoted(p).replace("\n", "' || chr(10) || '") if isinstance(p, str) else _pick_sql(*p) for p in TEMPLATE) + ")"
_NOTES = f"n AS (SELECT doc_id, {_pick_sql(1, TARGETS)} AS target, {_NOTE} AS note FROM documents)"


def _section(name: str) -> str:
    header, following = lexicons.SECTIONS[name]
    pattern = _quoted(f"(?is){header}(.*?)(?:{'|'.join(following)})")
    return f"CASE WHEN regexp_matches(note, {pattern}) THEN regexp_replace(regexp_extract(note, {pattern}, 1), '^\\s+|\\s+$', '', 'g') END"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted('(?i)' + pattern)})"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_quoted('(?i)' + pattern)}))"


_CUTS = f"{_NOTES}, s AS (SELECT doc_id, target, note, " + ", ".join(f"{_section(k)} AS {k}" for k in ("hpi", "diagnosis", "admission_context", "exam_context", "past_history")) + " FROM n)"
_LABEL = lambda name: "diag_" + name.replace(" ", "_").lower()
_TEMPERATURE = _quoted("(?i)" + lexicons.TEMPERATURE)
_TARGET = "coalesce(CASE lower(trim(target)) " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in {**lexicons.ALIASES, **{v.lower(): v for v in lexicons.ALIASES.values()}}.items()) + " END, target)"
_POOL = ", ".join(f"({i}, {_quoted(c)}, {_quoted(e)})" for i, (c, e) in enumerate(POOL))
_ENTITIES = f"""pool AS (SELECT * FROM (VALUES {_POOL}) v(slot, term_category, term)),
    words AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS l FROM documents)),
    placed AS (SELECT *, (length(word) * 31 + ascii(word) * 7 + pos) % {2 * len(POOL)} AS slot FROM words),
    named AS (SELECT doc_id AS record_id, coalesce(term_category, [{", ".join(map(_quoted, lexicons.CATEGORIES))}][placed.slot % {len(lexicons.CATEGORIES)} + 1]) AS category, CAST(pos AS INTEGER) AS pos, coalesce(term, lower(word)) AS entity FROM placed LEFT JOIN pool USING (slot)),
    ents AS (SELECT *, trim(regexp_replace(lower(strip_accents(entity)), '\\s+', ' ', 'g')) AS key FROM named)"""


def _rank(order: tuple[str, ...]) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order)) + " END"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_quoted, values)) + ")"


def _leaked(marker: str, check: str) -> str:
    return f"""SELECT l.record_id, '{check}' AS "check", l.category, l.entity, e.category AS detail
        FROM (SELECT *, trim(regexp_replace(key, {_quoted("(?s)" + marker + ".*$")}, ''), ' -–—:') AS name FROM ents WHERE category = '{LAB}' AND {_has("key", marker)}) l
        JOIN (SELECT DISTINCT record_id, key, category FROM ents WHERE category IN ('{DISEASE}', '{ORGANISM}')) e ON e.record_id = l.record_id AND e.key = l.name WHERE l.name <> ''"""


_GROUP = "CASE " + " ".join(f"WHEN key IN {_in(g)} THEN {i}" for i, g in enumerate(lexicons.CHECK_SYNONYMS)) + " END"
_IMAGING = "(" + "|".join(lexicons.CHECK_IMAGING) + ")"
_CHECKS = f"""
    SELECT record_id, 'repeated_key' AS "check", NULL::VARCHAR AS category, key AS entity, array_to_string(list_sort(list(DISTINCT category)), ',') AS detail FROM ents GROUP BY record_id, key HAVING count(*) > 1
    UNION ALL {_leaked(lexicons.CHECK_NEGATIVE, "negative_test")}
    UNION ALL {_leaked(lexicons.CHECK_PENDING, "pending_test")}
    UNION ALL SELECT record_id, 'symptom_as_disease', category, entity, key FROM ents WHERE category = '{DISEASE}' AND key IN {_in(lexicons.CHECK_SYMPTOMS)}
    UNION ALL SELECT record_id, 'imaging_as_disease', category, entity, regexp_extract(key, {_quoted(_IMAGING)}) FROM ents JOIN documents ON doc_id = record_id
        WHERE category = '{DISEASE}' AND {_has("key", _IMAGING)} AND NOT contains(lower(coalesce(text, '')), key)
    UNION ALL SELECT record_id, 'synonyms', category, NULL, array_to_string(list_sort(list(DISTINCT key)), ',') FROM (SELECT *, {_GROUP} AS g FROM ents) WHERE g IS NOT NULL GROUP BY record_id, category, g HAVING count(DISTINCT key) > 1
    UNION ALL SELECT record_id, 'language', category, entity, regexp_extract(key, {_quoted(lexicons.CHECK_ENGLISH)}) FROM ents WHERE {_has("key", lexicons.CHECK_ENGLISH)}
    UNION ALL SELECT record_id, 'vital_as_lab', category, entity, regexp_extract(key, {_quoted(lexicons.CHECK_VITALS)}) FROM ents WHERE category = '{LAB}' AND {_has("key", lexicons.CHECK_VITALS)}"""
_IMAGING_KEY = _quoted(entities.imaging_pattern().replace("\\ ", " "))
_KEY = lambda e: f"trim(regexp_replace(lower(strip_accents({e})), '\\s+', ' ', 'g'))"


def _translated(column: str) -> str:
    for phrase, by in sorted(lexicons.TRANSLATIONS.items(), key=lambda kv: -len(kv[0])):
        column = f"regexp_replace({column}, {_quoted(rf'(?i)\b{phrase}\b')}, {_quoted(by)}, 'g')"
    return column


_LAYERS = f"""mk AS (SELECT record_id, pos, entity, key, category = '{DISEASE}' AND regexp_matches(key, {_IMAGING_KEY}) AS moves, category AS old, CASE WHEN category = '{DISEASE}' AND regexp_matches(key, {_IMAGING_KEY}) THEN '{SYMPTOM}' ELSE category END AS category FROM ents),
    mn AS (SELECT * FROM mk QUALIFY NOT moves OR row_number() OVER (PARTITION BY record_id, category, key ORDER BY moves, pos) = 1),
    mv AS (SELECT record_id, category, CASE WHEN category = '{SYMPTOM}' THEN (row_number() OVER (PARTITION BY record_id, category ORDER BY moves, pos) - 1)::INTEGER ELSE pos END AS pos, entity, key FROM mn),
    vt AS (SELECT *, category = '{LAB}' AND regexp_matches(key, {_quoted(lexicons.VITALS)}) AS vital FROM mv),
    tr AS (SELECT record_id, category, pos, entity AS before, {_translated("entity")} AS entity FROM vt WHERE NOT vital),
    tk AS (SELECT *, {_KEY("entity")} AS key FROM tr),
    cx AS (SELECT *, row_number() OVER (PARTITION BY record_id, key ORDER BY {_rank(lexicons.PRECEDENCE_B)}, pos) > 1 AND key NOT IN {_in(lexicons.STOP_TERMS)} AS gone FROM tk),
    ix AS (SELECT *, row_number() OVER (PARTITION BY record_id, category, key ORDER BY pos) > 1 AS again FROM cx WHERE NOT gone)"""
_CANON = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(n)})" for k, n in lexicons.CANONICAL.items()) + ") v(key, name))"

ORACLE_SQL = {
    "symptom_alert": f"WITH {_CUTS}, f AS (SELECT doc_id, " + ", ".join(f"{_has('hpi', p)} AS {k}" for k, p in lexicons.SYMPTOMS.items()) + " FROM s) SELECT *, fever AND (headache OR myalgia OR arthralgia OR rash) AS alert FROM f",
    "disease_labels": f"WITH {_CUTS} SELECT doc_id, " + ", ".join(f'{_has("diagnosis", p)} AS "{_LABEL(k)}"' for k, p in lexicons.LABELS.items()) + " FROM s",
    "clinical_context": f"""WITH {_CUTS}, c AS (SELECT doc_id, {_has("hpi", lexicons.TRAVEL)} AS travel, {_has("admission_context", lexicons.ANTIPYRETIC)} AS antipyretic, {_has("admission_context", lexicons.ANTIMALARIAL)} AS antimalarial,
        try_cast(nullif(regexp_extract(exam_context, {_TEMPERATURE}, 1), '') AS DOUBLE) AS measured FROM s) SELECT *, measured > 100.4 AS objective_fever FROM c""",
    "laboratory_features": f"WITH {_CUTS} SELECT doc_id, {_has('past_history', lexicons.DIABETES)} AS diabetes, {_has('past_history', lexicons.HYPERTENSION)} AS hypertension, {_has('note', lexicons.PLATELETS)} AS platelets FROM s",
    "note_lexicons": f"WITH {_NOTES} SELECT doc_id, " + ", ".join([*[f'{_has("note", p)} AS "{k.replace(" ", "_").lower()}"' for k, p in TOGETHER.items()], *[f'CAST({_count("note", p)} AS INTEGER) AS "n_{k}"' for k, p in COUNTED.items()]]) + " FROM n",
    "vocabulary_hits": r"""
        WITH known AS (SELECT DISTINCT unnest(string_split_regex(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', ' ', 'g'), ' +')) AS word FROM benchmark),
        cut AS (
            SELECT doc_id, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS i
            FROM (SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]', ' ', 'g') AS t FROM documents)),
        placed AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM cut),
        hit AS (SELECT * FROM placed SEMI JOIN known USING (word) WHERE word <> '')
        SELECT doc_id, count(h.i) AS n_hits, md5(coalesce(string_agg(start || ':' || (start + length(word)), ',' ORDER BY i), '')) AS places
        FROM documents LEFT JOIN hit h USING (doc_id) GROUP BY doc_id""",
    "note_sections": f"WITH {_NOTES}, s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS section, {_section(k)} AS body FROM n" for k in lexicons.SECTIONS) + ") SELECT doc_id, section, CAST(length(body) AS INTEGER) AS size, md5(body) AS digest FROM s",
    "target_coverage": f"""WITH {_NOTES}, t AS (SELECT doc_id, {_TARGET} AS target, regexp_replace(note, '(?ms)\\A(.*?)^={{3,}}.*?^={{3,}}(.*)\\z', '\\1\\2') AS body FROM n),
        m AS (SELECT doc_id, target, CAST(CASE target {" ".join(f"WHEN {_quoted(k)} THEN {_count('body', p)}" for k, p in lexicons.MENTIONS.items())} ELSE 0 END AS INTEGER) AS n FROM t)
        SELECT *, CASE WHEN n = 0 THEN 'zero' WHEN n <= 2 THEN 'minimal' ELSE 'adequate' END AS coverage FROM m""",
    "note_complexity": f"""WITH {_NOTES} SELECT doc_id, length(note)::INTEGER AS size, CAST({_count("note", lexicons.COMPLEXITY["negations"])} * 2 + {_count("note", lexicons.COMPLEXITY["pending"])} * 3 + {_count("note", lexicons.COMPLEXITY["differentials"])} * 2
        + {_count("note", lexicons.COMPLEXITY["medications"])} // 5 + CASE WHEN {_has("note", lexicons.COMPLEXITY["haart"])} THEN 10 ELSE 0 END + CASE WHEN {_has("note", lexicons.COMPLEXITY["tb_tests"])} THEN 10 ELSE 0 END
        + CASE WHEN length(note) > 15000 THEN 5 ELSE 0 END + CASE WHEN length(note) > 10000 THEN 3 ELSE 0 END AS BIGINT) AS score FROM n""",
    "qc_eight_checks": f"WITH {_ENTITIES} SELECT DISTINCT * FROM ({_CHECKS})",
    "qc_runner": f'WITH {_ENTITIES} SELECT "check", count(*) AS n_issues, count(DISTINCT record_id) AS n_records FROM ({_CHECKS}) GROUP BY "check"',
    # full stops that end nothing are marked first, as these patterns cannot look back
    "note_sentences": rf"""
        WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z ,.!?\n]', '', 'g') || chr(10) || chr(10) || {_pick_sql(7, SAID)} AS t FROM documents),
        k AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(^|[^A-Za-z0-9.])((?i:{"|".join(re.escape(a) for a in sorted(text.ABBREVIATIONS, key=len, reverse=True))}))\.', '\1\2' || chr(1), 'g'),
            '(^|[^A-Za-z0-9])([A-Z])\.', '\1\2' || chr(1), 'g'), '(^|\n)([0-9]{{1,2}})\.', '\1\2' || chr(1), 'g') AS t FROM b),
        m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([.!?][)]?)[ \t]+([A-Z0-9(])', '\1' || chr(30) || '\2', 'g'), '\n{{2,}}', chr(30), 'g'), '[ \t]*\n[ \t]*([a-z])', ' \1', 'g') AS t FROM k),
        p AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split_regex(t, '[\n' || chr(30) || ']') AS l FROM m)),
        c AS (SELECT doc_id, n, regexp_replace(replace(s, chr(1), '.'), '^\s+|\s+$', '', 'g') AS s FROM p)
        SELECT doc_id, count(*) AS n_sentences, arg_max(s, n) AS last, CAST(sum(length(s)) AS BIGINT) AS chars FROM c WHERE s <> '' GROUP BY doc_id""",
    "qc_report": f"""WITH {_ENTITIES}, issues AS ({_CHECKS}),
        listed AS (SELECT record_id, count(*) AS n_issues, {", ".join(f"""count(*) FILTER ("check" = '{k}') AS n_{k}""" for k in checks.CHECKS)},
            array_to_string(list_sort(list(concat_ws('|', "check", coalesce(category, '-'), coalesce(entity, '-'), detail))), ';') AS t FROM issues GROUP BY record_id),
        many AS (SELECT record_id, count(*) AS n FROM ents GROUP BY record_id)
        SELECT doc_id AS record_id, coalesce(n, 0) AS n_entities, coalesce(n_issues, 0) AS n_issues, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in checks.CHECKS)}, md5(coalesce(t, '')) AS issues
        FROM documents LEFT JOIN listed ON doc_id = listed.record_id LEFT JOIN many ON doc_id = many.record_id""",
    "clinical_layers": f"WITH {_ENTITIES}, {_LAYERS} SELECT record_id, category, pos, entity FROM ix WHERE NOT again",
    "clinical_steps": f"""WITH {_ENTITIES}, {_CANON}, a AS (SELECT * FROM ents QUALIFY row_number() OVER (PARTITION BY record_id, category, key ORDER BY pos) = 1),
        b AS (SELECT * FROM a QUALIFY {_rank(lexicons.PRECEDENCE_A)} = min({_rank(lexicons.PRECEDENCE_A)}) OVER (PARTITION BY record_id, key)),
        c AS (SELECT record_id, category, pos, coalesce(name, entity) AS entity FROM b LEFT JOIN names USING (key)), e AS (SELECT *, {_KEY("entity")} AS key FROM c)
        SELECT record_id, category, pos, entity FROM e QUALIFY row_number() OVER (PARTITION BY record_id, category, key ORDER BY pos) = 1""",
    "layer_stats": f"""WITH {_ENTITIES}, {_LAYERS}, l AS (
        SELECT 'imaging' AS layer, record_id, old AS category, pos, entity FROM mk WHERE moves UNION ALL SELECT 'vitals', record_id, category, pos, entity FROM vt WHERE vital
        UNION ALL SELECT 'language', record_id, category, pos, before FROM tr WHERE before <> entity UNION ALL SELECT 'across', record_id, category, pos, entity FROM cx WHERE gone
        UNION ALL SELECT 'within', record_id, category, pos, entity FROM ix WHERE again),
        r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY record_id, category, pos) AS k FROM l)
        SELECT layer, count(*) AS n, string_agg(entity, '; ' ORDER BY k) FILTER (k <= 5) AS examples FROM r GROUP BY layer""",
}
