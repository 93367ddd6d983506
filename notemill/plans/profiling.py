"""Queries that profile texts: lengths, sections, flags, negation, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import cohort, profile
from notemill.plans.base import FLAGS, NEGATORS, TERMS, documents, flag_columns, flag_sql, table

PAGE_SECTIONS = {"title": ("<title>", ("</title>",)), "nav": ("<nav>", ("</nav>",)), "body": ("<main>", ("</main>",)), "article": ("<article>", ("</article>",))}
STOP = ("the", "and", "that", "for", "with", "was", "this", "are")


def length_stats(spark, d):
    return profile.length_stats(documents(spark, d), F.length("text"))


def length_filter(spark, d):
    return documents(spark, d).where(F.length("text") > 1000).select("doc_id", "lang", "source", F.length("text").alias("size"))


def top_sources(spark, d):
    return profile.top_values(documents(spark, d), "source", 10)


def longest_shortest(spark, d):
    return profile.extremes(documents(spark, d).select("doc_id", F.length("text").alias("size")), "size", "doc_id")


def section_extract(spark, d):
    cut = {k: text.section(F.col("html"), *s) for k, s in PAGE_SECTIONS.items()}
    return table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in cut.items()])


def section_success_rate(spark, d):
    found = section_extract(spark, d)
    return profile.shares(found, {k: F.col(k).isNotNull() for k in PAGE_SECTIONS})


def _flagged(spark, d, *columns):
    return documents(spark, d).select("doc_id", *columns, *[c.alias(k) for k, c in flag_columns(F.col("text")).items()])


def lexicon_flags(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in flag_columns(F.col("text")).items()])


def prevalence(spark, d):
    flagged = documents(spark, d).select("lang", *[c.alias(k) for k, c in flag_columns(F.col("text")).items()])
    return profile.shares(flagged, {k: F.col(k) for k in FLAGS}, ["lang"])


def _alert() -> Column:
    return F.col("number") & profile.any_of(F.col("mail"), F.col("secret"), F.col("licence"))


def cooccur_alert(spark, d):
    return lexicon_flags(spark, d).select("doc_id", _alert().alias("alert")).groupBy("alert").agg(F.count("*").alias("n"))


def alert_topk_label(spark, d):
    first = text.collapse(F.lower(F.regexp_extract("text", r"^([^\n.]*)", 1))).alias("opening")
    return profile.top_values(_flagged(spark, d, "text").where(_alert()).select(first), "opening", 10)


def label_matrix(spark, d):
    long = _flagged(spark, d, "lang").unpivot(["doc_id", "lang"], list(FLAGS), "label", "hit")
    return long.groupBy("lang", "label").agg(F.count_if("hit").alias("n"))


def alert_sensitivity(spark, d):
    joined = lexicon_flags(spark, d).join(table(spark, d, "labels"), "doc_id")
    return profile.sensitivity(joined, _alert(), F.col("quality") == 1)


def false_negatives(spark, d):
    missed = lexicon_flags(spark, d).join(table(spark, d, "labels"), "doc_id").where((F.col("toxic") == 1) & ~_alert()).select("doc_id")
    return cohort.keep_in(documents(spark, d), missed, "doc_id").select("doc_id", F.length("text").alias("size"), F.left("text", F.lit(80)).alias("shown"))


def context_join(spark, d):
    docs, labels = documents(spark, d), table(spark, d, "labels")
    number = text.capture(F.col("text"), r"\b([0-9]{2,3}\.[0-9]{1,3})\.[0-9]").try_cast("double")
    facts = docs.select("doc_id", "lang", number.alias("measured"), text.has(F.col("text"), r"\blicense\b").alias("licence"))
    joined = facts.join(labels, "doc_id")
    return joined.select("doc_id", "lang", "quality", "licence", "measured", (F.col("measured") > 50.0).alias("high"))


def negation(spark, d):
    folded = documents(spark, d).select("doc_id", F.replace(text.fold(F.col("text")), F.lit("ß"), F.lit("ss")).alias("t"))  # SQL's word boundaries know ASCII only
    found = folded.select("doc_id", text.mentioned(F.col("t"), TERMS).alias("found"), text.negated(F.col("t"), NEGATORS, TERMS).alias("negated"))
    return found.withColumn("affirmed", F.col("found") & ~F.col("negated"))


def word_freq(spark, d):
    return profile.frequent_words(documents(spark, d), F.col("text"), STOP, 15)


def flag_correlation(spark, d):
    rounded = profile.correlations(documents(spark, d), flag_columns(F.col("text")))
    return rounded.select("a", "b", F.round("r", 9).alias("r"))


def sentences(spark, d):
    split = documents(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))
    return split.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).alias("longest"), F.sum(F.length("sentence")).alias("chars"))


def filename_parse(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(url.rlike("^https?://([^/]+)/"), F.regexp_extract(url, "^https?://([^/]+)/", 1)).otherwise("unknown").alias("host"), F.when(url.rlike("([0-9]+)[^0-9]*$"), F.regexp_extract(url, "([0-9]+)[^0-9]*$", 1)).otherwise("unknown").alias("number"))


def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (length_stats, length_filter, top_sources, longest_shortest, section_extract, section_success_rate, lexicon_flags, prevalence, cooccur_alert, alert_topk_label, label_matrix, alert_sensitivity, false_negatives, context_join, negation, word_freq, flag_correlation, sentences, filename_parse, html_escape)}

_F = f"f AS (SELECT doc_id, lang, text, {flag_sql()} FROM documents)"
_ALERT = "(number AND (mail OR secret OR licence))"
_SECTION = lambda a, b: f"CASE WHEN regexp_matches(html, '(?is){a}(.*?){b}') THEN regexp_replace(regexp_extract(html, '(?is){a}(.*?){b}', 1), '^\\s+|\\s+$', '', 'g') END"
_PAGES = "p AS (SELECT page_id, " + ", ".join(f"{_SECTION(a, b[0])} AS {k}" for k, (a, b) in PAGE_SECTIONS.items()) + " FROM pages)"
_PCT = lambda c: f"round(count(*) FILTER ({c}) / count(*)::DOUBLE * 100, 1)"

ORACLE_SQL = {
    "length_stats": "SELECT min(length(text))::INTEGER AS least, trunc(avg(length(text)))::INTEGER AS mean, median(length(text)) AS median, max(length(text))::INTEGER AS most FROM documents",
    "length_filter": "SELECT doc_id, lang, source, length(text)::INTEGER AS size FROM documents WHERE length(text) > 1000",
    "top_sources": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "longest_shortest": """SELECT * FROM (SELECT 'longest' AS kind, doc_id, length(text)::INTEGER AS size FROM documents ORDER BY size DESC, doc_id LIMIT 1)
        UNION ALL SELECT * FROM (SELECT 'shortest' AS kind, doc_id, length(text)::INTEGER AS size FROM documents ORDER BY size, doc_id LIMIT 1)""",
    "section_extract": f"WITH {_PAGES} SELECT * FROM p",
    "section_success_rate": f"WITH {_PAGES} SELECT count(*) AS n, {', '.join(f'{_PCT(k + ' IS NOT NULL')} AS pct_{k}' for k in PAGE_SECTIONS)} FROM p",
    "lexicon_flags": f"WITH {_F} SELECT doc_id, {', '.join(FLAGS)} FROM f",
    "prevalence": f"WITH {_F} SELECT lang, count(*) AS n, {', '.join(f'{_PCT(k)} AS pct_{k}' for k in FLAGS)} FROM f GROUP BY lang",
    "cooccur_alert": f"WITH {_F} SELECT {_ALERT} AS alert, count(*) AS n FROM f GROUP BY alert",
    "alert_topk_label": rf"""WITH {_F} SELECT trim(regexp_replace(lower(regexp_extract(text, '^([^\n.]*)', 1)), '\s+', ' ', 'g')) AS opening, count(*) AS n FROM f WHERE {_ALERT} GROUP BY opening ORDER BY n DESC, opening LIMIT 10""",
    "label_matrix": f"WITH {_F} SELECT lang, label, count(*) FILTER (hit) AS n FROM (UNPIVOT (SELECT doc_id, lang, {', '.join(FLAGS)} FROM f) ON {', '.join(FLAGS)} INTO NAME label VALUE hit) GROUP BY lang, label",
    "alert_sensitivity": f"WITH {_F}, s AS (SELECT count(*) FILTER (quality = 1) AS n_true, count(*) FILTER (quality = 1 AND {_ALERT}) AS n_found FROM f JOIN labels USING (doc_id)) SELECT *, round(n_found / nullif(n_true, 0)::DOUBLE * 100, 1) AS sensitivity FROM s",
    "false_negatives": f"WITH {_F} SELECT doc_id, length(text)::INTEGER AS size, left(text, 80) AS shown FROM f JOIN labels USING (doc_id) WHERE toxic = 1 AND NOT {_ALERT}",
    "context_join": r"""WITH x AS (SELECT doc_id, lang, try_cast(nullif(regexp_extract(text, '\b([0-9]{2,3}\.[0-9]{1,3})\.[0-9]', 1), '') AS DOUBLE) AS measured, regexp_matches(text, '(?i)\blicense\b') AS licence FROM documents)
        SELECT doc_id, lang, quality, licence, measured, measured > 50.0 AS high FROM x JOIN labels USING (doc_id)""",
    "negation": rf"""WITH t AS (SELECT doc_id, replace(lower(strip_accents(text)), 'ß', 'ss') AS t FROM documents),
        n AS (SELECT doc_id, regexp_matches(t, '\b({"|".join(TERMS)})\b') AS found, regexp_matches(t, '\b({"|".join(NEGATORS)})\b(?:\s+\w+){{0,3}}\s+({"|".join(TERMS)})\b') AS negated FROM t)
        SELECT doc_id, found, negated, found AND NOT negated AS affirmed FROM n""",
    "word_freq": rf"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '\s+')) AS word FROM documents)
        SELECT word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY word ORDER BY n DESC, word LIMIT 15""",
    "flag_correlation": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}::INT, {b}::INT) / nullif(stddev_pop({a}::INT) * stddev_pop({b}::INT), 0), 9) AS r FROM f" for i, a in enumerate(FLAGS) for b in list(FLAGS)[i + 1 :]),
    "sentences": r"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g') AS t FROM documents),
        s AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(t, '\n+')), '^\s+|\s+$', '', 'g') AS sentence FROM m)
        SELECT doc_id, count(*) AS n_sentences, max(length(sentence))::INTEGER AS longest, sum(length(sentence))::BIGINT AS chars FROM s WHERE length(sentence) > 10 GROUP BY doc_id""",
    "filename_parse": """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([^/]+)/') THEN regexp_extract(url, '^https?://([^/]+)/', 1) ELSE 'unknown' END AS host,
        CASE WHEN regexp_matches(url, '([0-9]+)[^0-9]*$') THEN regexp_extract(url, '([0-9]+)[^0-9]*$', 1) ELSE 'unknown' END AS number FROM pages""",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""",
}
