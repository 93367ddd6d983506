"""Queries on readers and writers (written to the shared folder and read back), exports, samples, reviews and span scores."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from notemill import config, schemas
from notemill.functions import text
from notemill.operators import cohort, contract, entities, profile, review, scoring
from notemill.plans.base import documents, table
from notemill.session import shared_folder
from notemill.sources import pages, readers, stored, writers

MODELS = ("m1", "m2", "m3")
#: Files of a folder, which one task lists and reads.
PER_FOLDER = 1000


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def csv_round_trip(spark, d):
    """Whole texts with quotes and line breaks, written as CSV and read with a schema."""
    path = shared_folder(spark, "csv")
    writers.csv(documents(spark, d).select("doc_id", "lang", F.concat(F.lit('"'), F.regexp_replace("text", "\r", "")).alias("text")), path, allow_text=True)
    return readers.csv(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))


def csv_inferred(spark, d):
    """Types found by reading."""
    path = shared_folder(spark, "inferred")
    writers.csv(_orders(spark, d), path)
    return readers.csv(spark, path, lines=False).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").cast("long").alias("last"), F.round(F.max("o_totalprice"), 2).alias("most"))


def csv_as_parquet(spark, d):
    """CSV turned into Parquet once; the second call leaves what is there."""
    source, target = shared_folder(spark, "source"), shared_folder(spark, "target")
    writers.csv(_orders(spark, d), source)
    for _ in range(2):
        writers.csv_to_parquet(spark, {source: target}, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    return readers.parquet(spark, target, ["o_orderkey", "o_orderstatus"])


def ndjson_round_trip(spark, d):
    path = shared_folder(spark, "ndjson")
    writers.ndjson(documents(spark, d).select("doc_id", "text", "source"), path, allow_text=True)
    return readers.ndjson(spark, path, "doc_id long, text string, source string").select("doc_id", "source", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


def event_log(spark, d):
    """Log lines written as text, every fourth of them broken, read as NDJSON without the broken ones."""
    path = shared_folder(spark, "log")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("ts"), F.lit("INFO").alias("level"), F.col("event_type").alias("msg")))
    broken = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    table(spark, d, "events").select(broken.alias("value")).write.text(path)
    return readers.events(spark, path).groupBy("msg").agg(F.count("*").alias("n"))


def _records(spark, d):
    """Records whose lists follow from the label."""
    lists = F.struct(*[(F.array(F.lit(c), F.col("toxic").cast("string")) if i < 2 else F.lit(None).cast("array<string>")).alias(c) for i, c in enumerate(schemas.CATEGORIES)])
    texts = F.struct(*[(F.lit("ok") if i == 0 else F.lit(None).cast("string")).alias(c) for i, c in enumerate(schemas.SOAP)])
    status = F.lit(None).cast(schemas.AGENT_STATUS)
    return table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("paciente_id"), F.col("quality").cast("string").alias("codigo_cid"), F.lit(None).cast("string").alias("doenca_alvo_identificada"), lists.alias("ner"), texts.alias("soap"), status.alias("agent_status"))


def record_array(spark, d):
    """Records as a JSON array and as NDJSON, both read back with every list present."""
    array, lines = shared_folder(spark, "array"), shared_folder(spark, "records")
    writers.json_array(_records(spark, d), array, rows=10_000_000)
    writers.ndjson(_records(spark, d), lines)
    both = readers.records(spark, array).withColumn("form", F.lit("array")).unionByName(readers.records(spark, lines, lines=True).withColumn("form", F.lit("lines")))
    filled = F.size(F.filter(F.array(*[F.col(f"ner.{c}").isNotNull() for c in schemas.CATEGORIES]), lambda x: x))
    return both.groupBy("form", "codigo_cid").agg(F.count("*").alias("n"), F.sum(filled).alias("n_lists"), F.sum(F.size("ner.sign_or_symptom")).alias("n_items"))


def large_arrays(spark, d):
    """Records with whole texts as JSON arrays, bare and under notes, each file read by as many tasks as it has splits."""
    made = _records(spark, d).join(documents(spark, d).select(F.col("doc_id").cast("string").alias("paciente_id"), F.coalesce("text", F.lit("")).alias("course")), "paciente_id")
    made = made.withColumn("soap", F.col("soap").withField("course", F.col("course"))).drop("course")
    bare, wrapped = shared_folder(spark, "arrays"), shared_folder(spark, "wrapped")
    writers.json_arrays(made, bare)
    writers.json_arrays(made, wrapped, under="notes")
    both = readers.array_records(spark, bare).withColumn("form", F.lit("bare")).unionByName(readers.array_records(spark, wrapped).withColumn("form", F.lit("wrapped")))
    return both.select("form", F.col("paciente_id").cast("long").alias("doc_id"), "codigo_cid", F.size("ner.organism_or_virus").alias("n_last"), F.md5(F.col("soap.course").cast("binary")).alias("digest"))


def stored_upsert(spark, d):
    """A stored table updated by key: replaced, added and repeated rows; the second time nothing is left to change."""
    path = shared_folder(spark, "stored")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored.create(orders, path, "o_orderkey", buckets=16)
    dear = orders.where("o_totalprice > 300000")
    new = dear.select("o_orderkey", F.lit("Y").alias("o_orderstatus"), F.lit(2).alias("v")).unionByName(dear.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("v")))
    new = new.unionByName(dear.where("o_totalprice > 400000").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1).alias("v")))
    first = stored.upsert(new, path, order="v", insert=True)
    again = stored.upsert(new, path, order="v", insert=True)
    return stored.read(spark, path).select("*", F.lit(again["written"]).alias("n_again"), F.lit(again["version"] - first["version"]).alias("n_versions"))


def configured_sample(spark, d):
    """Anchors, quotas by language and size, and a split, all as a settings file says."""
    path = shared_folder(spark, "settings")
    given = {"seed": 7, "validation_share": 0.25, "size_bins": {"short": 1000, "medium": 3000}, "quotas": {x: {"short": 8, "medium": 4, "long": 2} for x in ("en", "fr", "de", "es")}, "anchors": {str(i): "kept" for i in (3, 30, 133)}}
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(path)
    settings = config.read(spark, path)
    docs = documents(spark, d).select("doc_id", "lang", F.length("text").alias("size"))
    order = [cohort.seeded(F.col("doc_id"), settings), F.col("doc_id")]
    return cohort.configured(docs, settings, "lang", F.col("size"), order, "doc_id").select("doc_id", "lang", "bin", "anchor", "split")


def batch_resume(spark, d):
    """A stage in parts; the second run finds them all done."""
    path = shared_folder(spark, "batches")
    for _ in range(2):
        writers.in_batches(table(spark, d, "orders").select("o_orderkey", "o_custkey"), path, lambda df: df.withColumn("twice", F.col("o_custkey") * 2), "o_orderkey", 4)
    return readers.parquet(spark, path).select("o_orderkey", "twice")


def text_corpus(spark, d):
    """Pages as HTML, a row each, and a page that links them (page_files() writes them as files)."""
    path = shared_folder(spark, "texts")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("title"), "url")
    made = writers.html_pages(rows, "title", ["url"])
    writers.parquet(made.select("page_id", "html"), path)
    pieces = writers.index_pieces(made.select("title", F.concat("title", F.lit(".html")).alias("file")), "title", "file", "Pages")
    index = writers.digest(pieces).select(F.lit(-1).cast("long").alias("page_id"), "digest")
    return readers.parquet(spark, path).select("page_id", F.md5(F.col("html").cast("binary")).alias("digest")).unionByName(index)


def page_files(spark, d):
    """Pages as files, read again whole, and how often the parts of the index link each."""
    path = shared_folder(spark, "pages")
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("title"), "url")
    made = writers.html_pages(rows, "title", ["url"]).withColumn("file", F.concat("title", F.lit(".html")))
    pages.write(made, path, "file", "title", "html", instructions="Open a page to review it.", pages_per_part=100, per_folder=PER_FOLDER)
    number = F.regexp_extract("name", r"^page_(\d+)\.html$", 1)
    files = pages.read(spark, path).select(number.cast("long").alias("page_id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    links = pages.read(spark, path, index=True).select(F.explode(F.regexp_extract_all("text", F.lit(r'href="[^"/]+/page_(\d+)\.html"'), F.lit(1))).alias("page_id"))
    counted = links.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.count("*").alias("n_links"))
    return files.join(counted, "page_id", "left").select("page_id", "digest", "n_links")


def note_files(spark, d):
    """Documents as text files whose names say what they are, read again with their names taken apart; empty files are not read."""
    path = shared_folder(spark, "notes")
    name = F.concat(F.lit("note_"), F.col("lang"), F.lit("_A"), (F.col("doc_id") % 90).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    pages.write(documents(spark, d).select(name.alias("name"), "text"), path, "name", "name", "text", per_folder=PER_FOLDER)
    read = readers.named_parts(pages.read(spark, path))
    return read.select(F.col("id").cast("long").alias("doc_id"), F.col("target").alias("lang"), "code", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


def named_files(spark, d):
    names = documents(spark, d).select("doc_id", F.concat(F.lit("note_"), F.col("lang"), F.lit("_A"), (F.col("doc_id") % 90).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".csv").otherwise(".txt")).alias("name"))
    return readers.named_parts(names).select("doc_id", "target", "code", "id")


def first_rows_by_key(spark, d):
    return profile.head(documents(spark, d).select("doc_id", "lang", "source"), 5, "doc_id")


def smoke_sample(spark, d):
    return cohort.smoke(documents(spark, d).select("doc_id", "lang"), [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")], 3)


def anchored_sample(spark, d):
    """Poor toxic documents always, and quotas of the others by language."""
    docs = documents(spark, d).select("doc_id", "lang")
    anchors = table(spark, d, "labels").where("toxic = 1 and quality = 0").select("doc_id")
    quota = spark.createDataFrame([("en", 3), ("fr", 2), ("de", 2), ("es", 1)], "lang string, quota int")
    return cohort.anchored(docs, anchors, "doc_id", ["lang"], quota, [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")])


def vocabulary(spark, d):
    return cohort.with_flag(table(spark, d, "part").select("p_name", "p_size"), "p_name", "p_size")


def dictionary_export(spark, d):
    """Counts by language and source as one nested JSON object."""
    counts = documents(spark, d).groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))
    return contract.nested(counts, ["lang", "source"], "n")


def contains_word(spark, d):
    return documents(spark, d).select("doc_id", *[text.contains_word(text.fold(F.col("text")), F.lit(w)).alias(f"has_{i}") for i, w in enumerate(("the", "a.b", "license", "de la"))])


def type_guards(spark, d):
    """Only texts of a list that is there at all; the empty and missing ones give nothing."""
    lists = F.when(F.col("quality") == 1, F.array(F.lit("a"), F.lit(None), F.col("toxic").cast("string")))
    return entities.long_form(table(spark, d, "labels").select("doc_id", lists.alias("x")), "doc_id", {"c1": F.col("x"), "c2": F.lit(None).cast("array<string>")})


def span_scores(spark, d):
    """Tags by two rules for tokens of the passages: the second rule misses some spans and cuts others short."""
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    vowel = lambda t: t.rlike("^[aeiou]")
    tag = lambda more: F.transform(tokens, lambda t: F.when(t == "the", "B-A").when(vowel(t) & (F.length(t) > more), "I-A").when(t.rlike("^b"), "B-B").otherwise("O"))
    rows = table(spark, d, "benchmark")
    return scoring.span_scores(rows.select("item_id", tag(2).alias("tags")), rows.select("item_id", tag(4).alias("tags")), "item_id", "tags")


def scores_of_predicted(spark, d):
    """Gold sources of labelled documents; documents without a prediction do not count."""
    docs = documents(spark, d).where("source is not null")
    gold = docs.select("doc_id", "lang", F.col("source").alias("item"))
    predicted = docs.join(table(spark, d, "labels"), "doc_id").where("quality = 1").select("doc_id", "lang", F.when(F.col("toxic") == 1, "none").otherwise(F.col("source")).alias("item"))
    return scoring.set_scores(scoring.for_predicted(gold, predicted, ["doc_id"]), predicted, ["lang"], "item", ["doc_id"])


def _reviewed(spark, d):
    """A status for each of three models and two categories; some are open."""
    rows = table(spark, d, "labels").withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    status = lambda c: F.when((F.col(c) == 1) & (F.col("doc_id") % 3 != F.length("model") + F.ascii(F.substring("model", 2, 1)) % 3), "correto")
    return rows.select("doc_id", "model", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c), status(c)) for c in ("quality", "toxic")]))).alias("category", "status"))


def review_by_model(spark, d):
    return review.completeness(_reviewed(spark, d), ["doc_id", "model"], 2)


def review_of_models(spark, d):
    return review.completeness(_reviewed(spark, d), ["doc_id"], len(MODELS) * 2)


def bulk_approved(spark, d):
    """All categories of one model set to approved at once."""
    done = review.approve(_reviewed(spark, d), F.col("model") == "m2")
    return review.approval(done, ["model"])


def review_export(spark, d):
    """States of all records in one table; exports that are no JSON are left out."""
    state = F.concat(F.lit('{"a": {"status": "'), F.col("quality").cast("string"), F.lit('", "comment": null}, "_general": {"status": "x"}, "b": {"status": "'), F.col("toxic").cast("string"), F.lit('"}}'))
    exports = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(state, F.lit("}}"))).otherwise(state).alias("raw"))
    return review.consolidated(exports, "doc_id", "raw").groupBy("category", "status").agg(F.count("*").alias("n"))


def audited_records(spark, d):
    """An audit that removes an entity, is skipped without any, and falls back to what it got where it fails."""
    find = contract.lexicon_extractor({"disease_or_syndrome": ["the "], "sign_or_symptom": ["license"]})

    def audit(body: str, lists: dict) -> dict:
        if "%%%" in body:
            raise ValueError("no answer")
        return {**lists, "disease_or_syndrome": []}

    notes = documents(spark, d).select(F.col("doc_id").alias("hadm_id"), "text")
    records = contract.extract(notes, find, lambda body: {"plan": ""}, audit)
    return records.groupBy("agent_status.audit_status").agg(F.count("*").alias("n"), F.sum(F.size("ner.disease_or_syndrome")).alias("n_diseases"), F.sum(F.size("ner.sign_or_symptom")).alias("n_symptoms"))


QUERIES = {
    f.__name__: f
    for f in (csv_round_trip, csv_inferred, csv_as_parquet, ndjson_round_trip, event_log, record_array, large_arrays, stored_upsert, configured_sample, batch_resume, text_corpus, page_files, note_files, named_files, first_rows_by_key, smoke_sample, anchored_sample, vocabulary, dictionary_export, contains_word, type_guards, span_scores, scores_of_predicted, review_by_model, review_of_models, bulk_approved, review_export, audited_records)
}

_SPANS = lambda name, more: f"""{name}_t AS (SELECT item_id, pos, CASE WHEN t = 'the' THEN 'B-A' WHEN regexp_matches(t, '^[aeiou]') AND length(t) > {more} THEN 'I-A' WHEN regexp_matches(t, '^b') THEN 'B-B' ELSE 'O' END AS tag FROM tok),
    {name}_b AS (SELECT *, tag[3:] AS label, CASE WHEN tag[1] = 'B' OR lag(pos) OVER w IS NULL OR lag(pos) OVER w < pos - 1 OR lag(tag[3:]) OVER w <> tag[3:] THEN 1 ELSE 0 END AS b FROM {name}_t WHERE tag <> 'O' WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
    {name}_s AS (SELECT *, sum(b) OVER (PARTITION BY item_id ORDER BY pos) AS span FROM {name}_b),
    {name} AS (SELECT item_id, label, min(pos) AS a, max(pos) AS z FROM {name}_s GROUP BY item_id, span, label)"""  # noqa: E731
_SCORE = "round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) END, 4) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) END, 4) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END, 4) AS f1"
_REVIEWED = "r AS (SELECT doc_id, model, category, CASE WHEN value = 1 AND doc_id % 3 <> 2 + ascii(model[2]) % 3 THEN 'correto' END AS status FROM (SELECT doc_id, 'quality' AS category, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels), (VALUES ('m1'), ('m2'), ('m3')) m(model))"
_STATE = lambda n: f"CASE WHEN count(status) >= {n} THEN 'done' WHEN count(status) > 0 THEN 'started' ELSE 'open' END AS state"
_HTML = "concat('<html><body><h1>page_', page_id, '</h1><h2>url</h2><p>', replace(replace(replace(replace(replace(coalesce(url, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '</p></body></html>')"

ORACLE_SQL = {
    "csv_round_trip": "SELECT doc_id, lang, md5('\"' || replace(text, chr(13), '')) AS digest FROM documents",
    "csv_inferred": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last, round(max(o_totalprice), 2) AS most FROM orders GROUP BY o_orderstatus",
    "csv_as_parquet": "SELECT o_orderkey, o_orderstatus FROM orders",
    "ndjson_round_trip": "SELECT doc_id, source, length(text)::INTEGER AS size, md5(text) AS digest FROM documents",
    "event_log": "SELECT event_type AS msg, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY event_type",
    "record_array": "SELECT form, quality::VARCHAR AS codigo_cid, count(*) AS n, (6 * count(*))::BIGINT AS n_lists, (2 * count(*))::BIGINT AS n_items FROM labels, (VALUES ('array'), ('lines')) f(form) GROUP BY ALL",
    "large_arrays": """SELECT form, doc_id, CAST(quality AS VARCHAR) AS codigo_cid, CAST(0 AS INTEGER) AS n_last, md5(coalesce(text, '')) AS digest
        FROM labels JOIN documents USING (doc_id), (VALUES ('bare'), ('wrapped')) f(form)""",
    "configured_sample": """
        WITH b AS (SELECT doc_id, lang, CASE WHEN length(text) < 1000 THEN 'short' WHEN length(text) < 3000 THEN 'medium' ELSE 'long' END AS bin, md5('7:' || doc_id) AS o, doc_id IN (3, 30, 133) AS anchor FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, bin, anchor ORDER BY o, doc_id) AS k FROM b),
        t AS (SELECT * FROM r WHERE anchor OR k <= CASE bin WHEN 'short' THEN 8 WHEN 'medium' THEN 4 ELSE 2 END)
        SELECT doc_id, lang, bin, anchor, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.25)) THEN 'validation' ELSE 'train' END AS split FROM t""",
    "stored_upsert": """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, 0 AS n_again, 0 AS n_versions FROM orders
        UNION ALL SELECT -o_orderkey, 'N', NULL, 0, 0 FROM orders WHERE o_totalprice > 400000""",
    "batch_resume": "SELECT o_orderkey, o_custkey * 2 AS twice FROM orders",
    "text_corpus": f"""SELECT page_id, md5({_HTML}) AS digest FROM pages UNION ALL
        SELECT -1, md5('<html><body><h1>Pages</h1><ul>' || string_agg('<li><a href="page_' || page_id || '.html">page_' || page_id || '</a></li>', '' ORDER BY page_id::VARCHAR) || '</ul></body></html>') FROM pages""",
    "page_files": f"SELECT page_id, md5({_HTML}) AS digest, 1 AS n_links FROM pages",
    "note_files": "SELECT doc_id, lang, 'A' || doc_id % 90 AS code, CAST(length(coalesce(text, '')) AS INTEGER) AS size, md5(coalesce(text, '')) AS digest FROM documents WHERE text <> ''",
    "named_files": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS target, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'A' || doc_id % 90 END AS code, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE doc_id::VARCHAR END AS id FROM documents",
    "first_rows_by_key": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5",
    "smoke_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 3",
    "anchored_sample": """WITH a AS (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0),
        r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS rank FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a))
        SELECT doc_id, lang, true AS anchor, 0 AS rank FROM documents WHERE doc_id IN (SELECT doc_id FROM a)
        UNION ALL SELECT doc_id, lang, false, rank FROM r WHERE rank <= CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 1 ELSE 0 END""",
    "vocabulary": "SELECT DISTINCT p_name FROM part WHERE p_size = 1",
    "dictionary_export": """WITH c AS (SELECT coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, count(*) AS n FROM documents GROUP BY ALL),
        l AS (SELECT lang, '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' AS v FROM c GROUP BY lang) SELECT '{' || string_agg('"' || lang || '":' || v, ',' ORDER BY lang) || '}' AS value FROM l""",
    "contains_word": r"WITH t AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents) SELECT doc_id, regexp_matches(t, '\bthe\b') AS has_0, regexp_matches(t, '\ba\.b\b') AS has_1, regexp_matches(t, '\blicense\b') AS has_2, regexp_matches(t, '\bde la\b') AS has_3 FROM t",
    "type_guards": "SELECT doc_id AS record_id, 'c1' AS category, 0 AS pos, 'a' AS entity FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'c1', 2, toxic::VARCHAR FROM labels WHERE quality = 1 AND toxic IS NOT NULL",
    "span_scores": rf"""WITH sp AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM benchmark), tok AS (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM sp),
        {_SPANS("g", 2)}, {_SPANS("p", 4)}, m AS (SELECT coalesce(g.label, p.label) AS label, g.a IS NOT NULL AS g, p.a IS NOT NULL AS p FROM g FULL JOIN p ON g.item_id = p.item_id AND g.label = p.label AND g.a = p.a AND g.z = p.z),
        c AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM m GROUP BY label) SELECT *, {_SCORE} FROM c""",
    "scores_of_predicted": f"""WITH x AS (SELECT lang, toxic FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND quality = 1),
        c AS (SELECT lang, count(*) FILTER (toxic IS DISTINCT FROM 1) AS tp, count(*) FILTER (toxic = 1) AS fp, count(*) FILTER (toxic = 1) AS fn FROM x GROUP BY lang) SELECT *, {_SCORE} FROM c""",
    "review_by_model": f"WITH {_REVIEWED} SELECT doc_id, model, count(status) AS n_filled, {_STATE(2)} FROM r GROUP BY doc_id, model",
    "review_of_models": f"WITH {_REVIEWED} SELECT doc_id, count(status) AS n_filled, {_STATE(6)} FROM r GROUP BY doc_id",
    "bulk_approved": f"WITH {_REVIEWED} SELECT model, count(*) AS n, round(count(*) FILTER (status = 'correto' OR model = 'm2') / count(*)::DOUBLE, 4) AS approval FROM r GROUP BY model",
    "review_export": "SELECT category, status, count(*) AS n FROM (SELECT 'a' AS category, quality::VARCHAR AS status FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT 'b', toxic::VARCHAR FROM labels WHERE doc_id % 7 <> 0) GROUP BY ALL",
    "audited_records": """WITH x AS (SELECT contains(lower(text), 'the ') AS d, contains(lower(text), 'license') AS s, contains(text, '%%%') AS f FROM documents),
        y AS (SELECT CASE WHEN NOT (d OR s) THEN 'skipped' WHEN f THEN 'error' ELSE 'ok' END AS audit_status, d, s FROM x)
        SELECT audit_status, count(*) AS n, count(*) FILTER (d AND audit_status = 'error') AS n_diseases, count(*) FILTER (s) AS n_symptoms FROM y GROUP BY audit_status""",
}
