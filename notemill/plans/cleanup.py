"""Queries on entities in long form (words of documents stand in for them), their cleanup and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import checks, entities
from notemill.plans.base import CATEGORIES, WORDS_SQL, dealt_entities, documents, entity_table, table

ORDER_A, ORDER_B = ("c3", "c2", "c4", "c1"), ("c2", "c1", "c4", "c3")
STOP = ("the", "de", "die")
NAMES = {k: name for name, keys in (("ARTICLE", ("the", "der", "die", "das", "le", "la", "el")), ("LINK", ("and", "und", "et", "y")), ("OF", ("of", "von", "du", "del"))) for k in keys}
PHRASES = {"th": "TH", "tion": "CION", "en": "in"}
MOVES, DROPS = "^(an|th)", "^(in|er)$"


def entities_long(spark, d):
    return entity_table(spark, d)


def dedup_intra(spark, d):
    return entities.dedup_within(dealt_entities(spark, d))


def mutual_exclusive(spark, d):
    return entities.exclusive(dealt_entities(spark, d), ORDER_A)


def cross_dedup(spark, d):
    return entities.dedup_across(dealt_entities(spark, d), ORDER_B, STOP)


def canonical_map(spark, d):
    return entities.canonical(dealt_entities(spark, d), entities.canonical_table(spark, NAMES))


def cleanup_steps(spark, d):
    return entities.clean(dealt_entities(spark, d), entities.canonical_table(spark, NAMES), ORDER_A, dealt=True)


def recategorise(spark, d):
    return entities.recategorise(dealt_entities(spark, d), MOVES, "c1", "c4")


def drop_class(spark, d):
    return entities.dropped(entity_table(spark, d), DROPS, "c3")


def _plain(ents):
    """Folded entities: SQL's word boundaries know ASCII only."""
    return ents.withColumn("entity", F.replace(text.fold(F.col("entity")), F.lit("ß"), F.lit("ss")))


def phrase_subst(spark, d):
    return entities.substituted(_plain(entity_table(spark, d)), PHRASES)


def cleanup_layers(spark, d):
    plain = _plain(dealt_entities(spark, d))
    return entities.totals(entities.layered(plain, (MOVES, "c1", "c4"), (DROPS, "c3"), PHRASES, ORDER_B, STOP, dealt=True))


def entity_totals(spark, d):
    return entities.totals(entity_table(spark, d))


def change_count(spark, d):
    return entities.removals(entities.after_exclusive(dealt_entities(spark, d), ORDER_A)).where("n_changes > 0")


def regrouped_lists(spark, d):
    lists = entities.regrouped(entities.dedup_within(dealt_entities(spark, d)), CATEGORIES)
    return lists.select("record_id", *[F.size(c).alias(f"n_{c}") for c in CATEGORIES], *[F.md5(F.array_join(c, "|").cast("binary")).alias(c) for c in CATEGORIES])


def qc_repeated_keys(spark, d):
    return checks.repeated_keys(dealt_entities(spark, d))


def _titled(spark, d):
    """Two-word entities: what stands on both sides of a marker word."""
    pairs = F.regexp_extract_all("text", F.lit("[a-z]+ (?:the|der|le|el) "), F.lit(0))
    each = documents(spark, d).select(F.col("doc_id").alias("record_id"), F.posexplode(pairs).alias("pos", "entity"))
    labs = each.select("record_id", F.lit("c4").alias("category"), "pos", F.trim("entity").alias("entity"))
    return labs.unionByName(entity_table(spark, d).where("category <> 'c4'"))


def qc_leaked_tests(spark, d):
    return checks.leaked_tests(_titled(spark, d), " (the|der|le|el)$", "negative_test", "c4", ("c2", "c3")).distinct()


def qc_listed(spark, d):
    return checks.listed(entity_table(spark, d), ("the", "of", "la", "de"), "symptom_as_disease", "c3")


def qc_containing(spark, d):
    """Words whose only place in the text is the word itself are in the context as well, so that is the text's odd lines."""
    lines = F.filter(F.split("text", "\n"), lambda _, i: i % 2 == 1)
    contexts = documents(spark, d).select(F.col("doc_id").alias("record_id"), F.array_join(lines, "\n").alias("context"))
    return checks.containing(entity_table(spark, d), "(tion|heit)", "imaging_as_disease", "c1", contexts)


def qc_synonyms(spark, d):
    return checks.synonyms(dealt_entities(spark, d), (("the", "this", "that"), ("und", "der", "die"), ("le", "la", "les")))


def qc_language(spark, d):
    return checks.containing(entity_table(spark, d), r"\b(the|and|with|that)\b", "language").groupBy("record_id", "detail").agg(F.count("*").alias("n"))


def qc_summary(spark, d):
    return checks.summed(dealt_entities(spark, d), ("the", "of"), "symptom_as_disease", "c3", (("the", "this"),), dealt=True)


def before_after(spark, d):
    return checks.before_and_after(entities.after_steps(dealt_entities(spark, d), ORDER_A, dealt=True), ("the", "of"), "symptom_as_disease", "c3")


def key_variant_coalesce(spark, d):
    props = F.from_json("props", "map<string,string>")
    variants = {"first": [F.try_element_at(props, F.lit("nothing")), F.try_element_at(props, F.lit("k"))], "second": [F.try_element_at(props, F.lit("none"))]}
    return table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in entities.key_variants(variants).items()])


def json_length(spark, d):
    return table(spark, d, "events").select("event_id", text.json_length(F.col("props")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (entities_long, dedup_intra, mutual_exclusive, cross_dedup, canonical_map, cleanup_steps, recategorise, drop_class, phrase_subst, cleanup_layers, entity_totals, change_count, regrouped_lists, qc_repeated_keys, qc_leaked_tests, qc_listed, qc_containing, qc_synonyms, qc_language, qc_summary, before_after, key_variant_coalesce, json_length)
}

_RANK = lambda order: "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order)) + " END"
_E = "record_id, category, pos, entity"
_FIRST = lambda rel, name: f"{name} AS (SELECT {_E}, key FROM {rel} QUALIFY row_number() OVER (PARTITION BY record_id, category, key ORDER BY pos) = 1)"
_EXCL = lambda rel, name: f"{name} AS (SELECT {_E}, key FROM {rel} QUALIFY {_RANK(ORDER_A)} = min({_RANK(ORDER_A)}) OVER (PARTITION BY record_id, key))"
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}')" for k, n in NAMES.items()) + ") v(key, name))"
_CANON = lambda rel, name: f"{name}_0 AS (SELECT record_id, category, pos, coalesce(name, entity) AS entity FROM {rel} LEFT JOIN names USING (key)), {name}_1 AS (SELECT *, lower(strip_accents(entity)) AS key FROM {name}_0), {_FIRST(name + '_1', name)}"
_MOVED = f"""mk AS (SELECT record_id, pos, entity, key, category = 'c1' AND regexp_matches(key, '{MOVES}') AS moves, CASE WHEN category = 'c1' AND regexp_matches(key, '{MOVES}') THEN 'c4' ELSE category END AS category FROM ents),
    mn AS (SELECT * FROM mk QUALIFY NOT moves OR row_number() OVER (PARTITION BY record_id, category, key ORDER BY moves, pos) = 1),
    mv AS (SELECT record_id, category, CASE WHEN category = 'c4' THEN (row_number() OVER (PARTITION BY record_id, category ORDER BY moves, pos) - 1)::INTEGER ELSE pos END AS pos, entity, key FROM mn)"""
_DROPPED = lambda rel, name: f"{name} AS (SELECT * FROM {rel} WHERE NOT (category = 'c3' AND regexp_matches(key, '{DROPS}')))"
_SUBST = lambda e: f"regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents({e})), 'ß', 'ss'), '(?i)\\btion\\b', 'CION', 'g'), '(?i)\\bth\\b', 'TH', 'g'), '(?i)\\ben\\b', 'in', 'g')"
_CROSS = lambda rel, name: f"{name} AS (SELECT {_E}, key FROM {rel} QUALIFY row_number() OVER (PARTITION BY record_id, key ORDER BY {_RANK(ORDER_B)}, pos) = 1 OR key IN ({', '.join(repr(s) for s in STOP)}))"
_REPEATED = lambda rel: f"SELECT record_id, 'repeated_key' AS \"check\", NULL::VARCHAR AS category, key AS entity, array_to_string(list_sort(list(DISTINCT category)), ',') AS detail FROM {rel} GROUP BY record_id, key HAVING count(*) > 1"
_SYN = lambda groups, rel="ents": "SELECT record_id, 'synonyms' AS \"check\", category, NULL::VARCHAR AS entity, array_to_string(list_sort(list(DISTINCT key)), ',') AS detail FROM (SELECT *, CASE " + " ".join(f"WHEN key IN ({', '.join(repr(k) for k in g)}) THEN {i}" for i, g in enumerate(groups)) + f" END AS g FROM {rel}) WHERE g IS NOT NULL GROUP BY record_id, category, g HAVING count(DISTINCT key) > 1"

ORACLE_SQL = {
    "entities_long": f"WITH {WORDS_SQL} SELECT {_E} FROM ents",
    "dedup_intra": f"WITH {WORDS_SQL}, {_FIRST('ents', 'a')} SELECT {_E} FROM a",
    "mutual_exclusive": f"WITH {WORDS_SQL}, {_EXCL('ents', 'a')} SELECT {_E} FROM a",
    "cross_dedup": f"WITH {WORDS_SQL}, {_CROSS('ents', 'a')} SELECT {_E} FROM a",
    "canonical_map": f"WITH {WORDS_SQL}, {_NAMES}, {_CANON('ents', 'a')} SELECT {_E} FROM a",
    "cleanup_steps": f"WITH {WORDS_SQL}, {_NAMES}, {_FIRST('ents', 'a')}, {_EXCL('a', 'b')}, {_CANON('b', 'c')} SELECT {_E} FROM c",
    "recategorise": f"WITH {WORDS_SQL}, {_MOVED} SELECT {_E} FROM mv",
    "drop_class": f"WITH {WORDS_SQL}, {_DROPPED('ents', 'a')} SELECT {_E} FROM a",
    "phrase_subst": f"WITH {WORDS_SQL} SELECT record_id, category, pos, {_SUBST('entity')} AS entity FROM ents",
    "cleanup_layers": f"""WITH {WORDS_SQL}, {_MOVED}, {_DROPPED('mv', 'dr')}, s0 AS (SELECT record_id, category, pos, {_SUBST('entity')} AS entity FROM dr),
        s AS (SELECT *, lower(strip_accents(entity)) AS key FROM s0), {_CROSS('s', 'x')}, {_FIRST('x', 'y')} SELECT category, count(*) AS n_entities, count(DISTINCT record_id) AS n_records FROM y GROUP BY category""",
    "entity_totals": f"WITH {WORDS_SQL} SELECT category, count(*) AS n_entities, count(DISTINCT record_id) AS n_records FROM ents GROUP BY category",
    "change_count": f"""WITH {WORDS_SQL}, {_EXCL('ents', 'x')}, b AS (SELECT DISTINCT record_id, category, lower(entity) AS item FROM ents), a AS (SELECT DISTINCT record_id, category, lower(entity) AS item FROM x)
        SELECT record_id, category, count(*) AS n_changes FROM ((SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY ALL""",
    "regrouped_lists": f"WITH {WORDS_SQL}, {_FIRST('ents', 'a')} SELECT record_id, " + ", ".join(f"(count(*) FILTER (category = '{c}'))::INTEGER AS n_{c}, md5(coalesce(string_agg(entity, '|' ORDER BY pos) FILTER (category = '{c}'), '')) AS {c}" for c in CATEGORIES) + " FROM a GROUP BY record_id",
    "qc_repeated_keys": f"WITH {WORDS_SQL} {_REPEATED('ents')}",
    "qc_leaked_tests": f"""WITH {WORDS_SQL}, t AS (SELECT doc_id AS record_id, trim(unnest(regexp_extract_all(text, '[a-z]+ (?:the|der|le|el) '))) AS entity FROM documents),
        n AS (SELECT record_id, entity, regexp_replace(entity, ' (the|der|le|el)$', '') AS name FROM t)
        SELECT DISTINCT n.record_id, 'negative_test' AS "check", 'c4' AS category, n.entity, e.category AS detail FROM n JOIN ents e ON n.record_id = e.record_id AND n.name = e.key AND e.category IN ('c2', 'c3')""",
    "qc_listed": f"WITH {WORDS_SQL} SELECT record_id, 'symptom_as_disease' AS \"check\", category, entity, key AS detail FROM ents WHERE category = 'c3' AND key IN ('the', 'of', 'la', 'de')",
    "qc_containing": f"""WITH {WORDS_SQL} SELECT e.record_id, 'imaging_as_disease' AS "check", category, entity, regexp_extract(key, '(tion|heit)') AS detail
        FROM ents e JOIN (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 0), chr(10)) AS context FROM documents) d ON e.record_id = d.doc_id
        WHERE category = 'c1' AND regexp_matches(key, '(tion|heit)') AND NOT contains(lower(context), key)""",
    "qc_synonyms": f"WITH {WORDS_SQL} " + _SYN((("the", "this", "that"), ("und", "der", "die"), ("le", "la", "les"))),
    "qc_language": f"WITH {WORDS_SQL} SELECT record_id, key AS detail, count(*) AS n FROM ents WHERE key IN ('the', 'and', 'with', 'that') GROUP BY ALL",
    "qc_summary": f"""WITH {WORDS_SQL}, i AS ({_REPEATED('ents')} UNION ALL SELECT record_id, 'symptom_as_disease', category, entity, key FROM ents WHERE category = 'c3' AND key IN ('the', 'of') UNION ALL {_SYN((('the', 'this'),))})
        SELECT "check", count(*) AS n_issues, count(DISTINCT record_id) AS n_records FROM i GROUP BY "check" """,
    "before_after": f"""WITH {WORDS_SQL}, {_FIRST('ents', 'f')}, {_EXCL('f', 'x')},
        b AS ({_REPEATED('ents')} UNION ALL SELECT record_id, 'symptom_as_disease', category, entity, key FROM ents WHERE category = 'c3' AND key IN ('the', 'of')),
        a AS ({_REPEATED('x')} UNION ALL SELECT record_id, 'symptom_as_disease', category, entity, key FROM x WHERE category = 'c3' AND key IN ('the', 'of')),
        bb AS (SELECT "check", count(*) AS n FROM b GROUP BY ALL), aa AS (SELECT "check", count(*) AS n FROM a GROUP BY ALL)
        SELECT coalesce(bb."check", aa."check") AS "check", coalesce(bb.n, 0) AS n_before, coalesce(aa.n, 0) AS n_after, coalesce(aa.n, 0) - coalesce(bb.n, 0) AS delta FROM bb FULL JOIN aa ON bb."check" = aa."check" """,
    "key_variant_coalesce": "SELECT event_id, coalesce(json_extract_string(props, '$.nothing'), json_extract_string(props, '$.k'), '') AS first, coalesce(json_extract_string(props, '$.none'), '') AS second FROM events",
    "json_length": r"""SELECT event_id, (length(props) + len(regexp_extract_all(regexp_replace(props, '"(?:[^"\\]|\\.)*"', 's', 'g'), '[,:]')))::INTEGER AS chars FROM events""",
}
