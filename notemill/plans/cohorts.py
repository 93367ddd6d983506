"""Queries on cohorts: coverage, complexity, strata, samples, splits, exclusions, merges."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import cohort, profile
from notemill.plans.base import documents, table

PATTERNS = {"en": r"\b(the|and|of)\b", "fr": r"\b(le|la|de)\b", "de": r"\b(der|die|das)\b", "es": r"\b(el|la|de)\b"}
EDGES = (0, 1, 2, 3, 5, 10, 20, 50, 100, 500)
HARD = {"negations": r"\b(no|not|sin|ne|nicht)\b", "pending": r"\b(in|en)\b", "differentials": r"\b(on|un)\b", "medications": r"\b(the|der|el|le)\b"}
PRESENT = {"haart": r"license", "tb_tests": r"[a-z0-9]@[a-z0-9]"}


def _plain(c: str = "text") -> Column:
    return F.replace(text.fold(F.col(c)), F.lit("ß"), F.lit("ss"))


def _order(c: str = "doc_id") -> Column:
    """A fixed shuffle that both engines compute."""
    return F.md5(F.col(c).cast("string").cast("binary"))


def mention_coverage(spark, d):
    counted = documents(spark, d).withColumn("t", _plain()).select("doc_id", "lang", cohort.mentions(text.without_first_block(F.col("t")), F.col("lang"), PATTERNS).cast("int").alias("n"))
    return counted.withColumn("coverage", cohort.coverage(F.col("n")))


def coverage_stats(spark, d):
    return cohort.described(mention_coverage(spark, d), ["lang"], "n")


def coverage_hist(spark, d):
    return cohort.histogram(mention_coverage(spark, d), "n", EDGES, "500+").select("bin", "n")


def coverage_percent(spark, d):
    found = mention_coverage(spark, d)
    return profile.shares(found, {c: F.col("coverage") == c for c in ("zero", "minimal", "adequate")}, ["lang"])


def include_semi(spark, d):
    return cohort.keep_in(documents(spark, d), table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang", "source")


def exclude_anti(spark, d):
    return cohort.keep_out(documents(spark, d), table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source")


def complexity_score(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", F.length("text").alias("size"), _plain().alias("t"))
    counts = {k: text.count(F.col("t"), p) for k, p in HARD.items()}
    present = {k: text.has(F.col("t"), p) for k, p in PRESENT.items()}
    return docs.select("doc_id", "lang", "size", cohort.complexity(counts, present, F.col("size")).alias("score"))


def topn_per_stratum(spark, d):
    scored = complexity_score(spark, d)
    strata = {"long": F.col("size") > 10000, "short": F.col("size") < 500, "english": F.col("lang") == "en", "other": F.col("lang") != "en", "hard": F.col("score") > 100, "easy": F.col("score") <= 10}
    top = cohort.top_per_stratum(scored, strata, [F.desc("score"), F.col("doc_id")], 5, F.col("size").between(1000, 5000))
    return top.select("stratum", "rank", "doc_id", "score")


def strat_sample(spark, d):
    binned = documents(spark, d).select("doc_id", "lang", cohort.size_bin(F.length("text")).alias("bin"))
    quota = spark.createDataFrame([(x, b, n) for x in ("en", "fr", "de", "es") for b, n in (("short", 6), ("medium", 3), ("long", 1))], "lang string, bin string, quota int")
    return cohort.stratified(binned, ["lang", "bin"], quota, [_order(), F.col("doc_id")]).select("lang", "bin", "doc_id", "rank")


def sample_shortage(spark, d):
    binned = documents(spark, d).select("doc_id", "lang", cohort.size_bin(F.length("text")).alias("bin"))
    quota = spark.createDataFrame([(x, b, n) for x in ("en", "fr", "de", "es") for b, n in (("short", 60), ("medium", 30), ("long", 10))], "lang string, bin string, quota int")
    return cohort.shortages(binned, ["lang", "bin"], quota)


def neighbour_fill(spark, d):
    rows = documents(spark, d).select("doc_id", "lang", cohort.size_bin(F.length("text")).alias("bin"), F.col("doc_id").alias("_id"))
    near = {"short": ("medium", "long"), "medium": ("long", "short"), "long": ("medium", "short")}
    got = cohort.filled_from_neighbours(rows, "lang", "bin", {"short": 4, "medium": 4, "long": 4}, near, [_order(), F.col("doc_id")])
    return got.groupBy("lang", "picked_for").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"))


def train_val_split(spark, d):
    labelled = documents(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return cohort.split(labelled, "lang", [_order(), F.col("doc_id")])


def leakage(spark, d):
    parts = train_val_split(spark, d)
    gold = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return cohort.overlaps({"train": parts.where("split = 'train'"), "validation": parts.where("split = 'validation'"), "gold": gold}, "doc_id")


def size_bins(spark, d):
    return documents(spark, d).groupBy(cohort.size_bin(F.length("text")).alias("bin")).agg(F.count("*").alias("n"))


def token_budget(spark, d):
    return documents(spark, d).select("doc_id", cohort.token_budget(F.length("text")).alias("budget"))


def error_class(spark, d):
    message = F.concat(F.col("event_type"), F.when(F.col("value") > 50, ": maximum length").otherwise(""))
    return table(spark, d, "events").groupBy(cohort.error_class(message).alias("class")).agg(F.count("*").alias("n"))


def exclusion_reasons(spark, d):
    joined = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    rules = [("unlabelled", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("size", ~F.length("text").between(200, 20000))]
    return joined.groupBy(cohort.first_reason(rules).alias("reason")).agg(F.count("*").alias("n"))


def failure_pending(spark, d):
    t = F.col("text")
    lists = [F.regexp_extract_all(t, F.lit("[A-Za-z0-9.]+@[a-z0-9.]+"), F.lit(0)), F.regexp_extract_all(t, F.lit("[0-9]{4,}"), F.lit(0))]
    return documents(spark, d).where(cohort.failed(lists, t, "The")).select("doc_id")


def upsert_merge(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.select(F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(1).alias("version"))
    return cohort.upsert(orders, new.unionByName(new.withColumns({"o_orderstatus": F.lit("Y"), "version": F.lit(2)})), "o_orderkey", "version")


def default_lookup(spark, d):
    docs = documents(spark, d).select("doc_id", "lang")
    return cohort.with_default(docs, table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


def skip_missing(spark, d):
    return table(spark, d, "labels").join(documents(spark, d).where(text.filled(F.col("text"))).select("doc_id", "source"), "doc_id")


def multi_model_align(spark, d):
    labels, docs = table(spark, d, "labels"), documents(spark, d).select("doc_id", F.length("text").alias("size"))
    models = {"m1": F.col("size") > 500, "m2": F.col("size") > 1500, "m3": F.col("size") % 2 == 0}
    out = labels.select("doc_id", "quality")
    for name, rule in models.items():
        out = out.join(docs.where(rule).select("doc_id", F.lit(1).alias(name)), "doc_id", "left")
    return out.na.fill(0, list(models))


def union_append(spark, d):
    docs = documents(spark, d).select("doc_id", F.length("text").alias("size"))
    return docs.where("size > 5000").withColumn("part", F.lit("long")).unionByName(docs.where("size < 300").withColumn("part", F.lit("short")))


def map_merge(spark, d):
    first = F.create_map(F.lit("en"), F.lit(1), F.lit("fr"), F.lit(2))
    second = F.create_map(F.lit("fr"), F.lit(20), F.lit("de"), F.lit(30))
    merged = lambda k: F.coalesce(F.try_element_at(second, k), F.try_element_at(first, k))  # noqa: E731  the later map wins
    return documents(spark, d).groupBy("lang", merged(F.col("lang")).alias("code")).agg(F.count("*").alias("n"))


def prefix_primary_filter(spark, d):
    part = table(spark, d, "part").where(F.col("p_type").rlike("^(STANDARD|PROMO|A)")).select("p_partkey", "p_type")
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_partkey")
    return first.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count("*").alias("n"))


def kappa(spark, d):
    rated = documents(spark, d).join(table(spark, d, "labels"), "doc_id").select("lang", "quality", F.when(F.col("text").rlike("[%#!]{2}"), 0).otherwise(1).alias("second"))
    return profile.agreement(rated, ["lang"], "quality", "second")


def approval_rate(spark, d):
    rated = table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "category", "status")
    return rated.groupBy("category").agg(F.round(F.count_if(F.col("status") == 1) / F.count("*"), 4).alias("approval"))


def log_metrics(spark, d):
    e = table(spark, d, "events")
    rest = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.count_if(F.col("value") > 50).alias("n_large"))
    return rest.join(profile.medians(e, "event_type", "value"), "event_type", "left").withColumn("median", F.round("median", 6))


def monthly_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


def spread_top_customers(spark, d):
    """A multi-way join with a ranked result: spending by nation."""
    orders, customer, nation = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    spent = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    best = spent.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "c_custkey"))).where("rank <= 3")
    return best.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "rank", "c_custkey", "spent")


QUERIES = {
    f.__name__: f
    for f in (mention_coverage, coverage_stats, coverage_hist, coverage_percent, include_semi, exclude_anti, complexity_score, topn_per_stratum, strat_sample, sample_shortage, neighbour_fill, train_val_split, leakage, size_bins, token_budget, error_class, exclusion_reasons, failure_pending, upsert_merge, default_lookup, skip_missing, multi_model_align, union_append, map_merge, prefix_primary_filter, kappa, approval_rate, log_metrics, monthly_counts, spread_top_customers)
}

_PLAIN = "replace(lower(strip_accents(text)), 'ß', 'ss')"
_COUNT = lambda col, p: f"len(regexp_extract_all({col}, '{p}'))"
_MENTIONS = f"""t AS (SELECT doc_id, lang, regexp_replace({_PLAIN}, '(?ms)\\A(.*?)^={{3,}}.*?^={{3,}}(.*)\\z', '\\1\\2') AS t FROM documents),
    m AS (SELECT doc_id, lang, CAST(CASE lang {' '.join(f"WHEN '{k}' THEN {_COUNT('t', p)}" for k, p in PATTERNS.items())} ELSE 0 END AS INTEGER) AS n FROM t),
    c AS (SELECT *, CASE WHEN n = 0 THEN 'zero' WHEN n <= 2 THEN 'minimal' ELSE 'adequate' END AS coverage FROM m)"""
_BIN = "CASE WHEN length(text) < 8000 THEN 'short' WHEN length(text) < 20000 THEN 'medium' ELSE 'long' END"
_SCORE = f"""t AS (SELECT doc_id, lang, length(text)::INTEGER AS size, {_PLAIN} AS t FROM documents),
    s AS (SELECT doc_id, lang, size, CAST({_COUNT('t', HARD['negations'])} * 2 + {_COUNT('t', HARD['pending'])} * 3 + {_COUNT('t', HARD['differentials'])} * 2 + {_COUNT('t', HARD['medications'])} // 5
        + CASE WHEN regexp_matches(t, '{PRESENT['haart']}') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(t, '{PRESENT['tb_tests']}') THEN 10 ELSE 0 END
        + CASE WHEN size > 15000 THEN 5 ELSE 0 END + CASE WHEN size > 10000 THEN 3 ELSE 0 END AS BIGINT) AS score FROM t)"""
_SPLIT = """l AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn, greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.1)) AS many FROM l),
    x AS (SELECT doc_id, lang, CASE WHEN rn <= many THEN 'validation' ELSE 'train' END AS split FROM r)"""
_EDGE_CASES = " ".join(f"WHEN n >= {a} AND n < {b} THEN '{f'{a}-{b - 1}' if b - a > 1 else a}'" for a, b in zip(EDGES, EDGES[1:], strict=False))

ORACLE_SQL = {
    "mention_coverage": f"WITH {_MENTIONS} SELECT doc_id, lang, n, coverage FROM c",
    "coverage_stats": f"WITH {_MENTIONS} SELECT lang, count(*) AS n, round(avg(n), 1) AS mean, round(median(n), 1) AS median, min(n) AS least, max(n) AS most, round(coalesce(stddev_samp(n), 0), 1) AS deviation FROM c GROUP BY lang",
    "coverage_hist": f"WITH {_MENTIONS} SELECT CASE {_EDGE_CASES} ELSE '500+' END AS bin, count(*) AS n FROM c GROUP BY bin",
    "coverage_percent": f"WITH {_MENTIONS} SELECT lang, count(*) AS n, " + ", ".join(f"round(count(*) FILTER (coverage = '{k}') / count(*)::DOUBLE * 100, 1) AS pct_{k}" for k in ("zero", "minimal", "adequate")) + " FROM c GROUP BY lang",
    "include_semi": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "exclude_anti": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "complexity_score": f"WITH {_SCORE} SELECT doc_id, lang, size, score FROM s",
    "topn_per_stratum": f"""WITH {_SCORE},
        k AS (SELECT *, unnest(list_filter([CASE WHEN size > 10000 THEN 'long' END, CASE WHEN size < 500 THEN 'short' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN lang <> 'en' THEN 'other' END, CASE WHEN score > 100 THEN 'hard' END, CASE WHEN score <= 10 THEN 'easy' END], lambda x: x IS NOT NULL)) AS stratum FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CASE WHEN size BETWEEN 1000 AND 5000 THEN 0 ELSE 1 END, score DESC, doc_id)::INTEGER AS rank FROM k)
        SELECT stratum, rank, doc_id, score FROM r WHERE rank <= 5""",
    "strat_sample": f"""WITH b AS (SELECT doc_id, lang, {_BIN} AS bin FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, bin ORDER BY md5(doc_id::VARCHAR), doc_id)::INTEGER AS rank FROM b)
        SELECT lang, bin, doc_id, rank FROM r WHERE rank <= CASE bin WHEN 'short' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END AND lang IN ('en', 'fr', 'de', 'es')""",
    "sample_shortage": f"""WITH q AS (SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es')) l(lang), (VALUES ('short', 60), ('medium', 30), ('long', 10)) b(bin, quota)),
        h AS (SELECT lang, {_BIN} AS bin, count(*) AS n FROM documents GROUP BY ALL)
        SELECT q.lang, q.bin, quota, coalesce(n, 0) AS n_available FROM q LEFT JOIN h USING (lang, bin) WHERE coalesce(n, 0) < quota""",
    "neighbour_fill": f"""WITH b AS (SELECT doc_id, lang, {_BIN} AS bin, md5(doc_id::VARCHAR) AS o FROM documents),
        p1 AS (SELECT doc_id, lang, 'short' AS picked_for FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CASE bin WHEN 'short' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o, doc_id) <= 4),
        p2 AS (SELECT doc_id, lang, 'medium' AS picked_for FROM b WHERE doc_id NOT IN (SELECT doc_id FROM p1) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CASE bin WHEN 'medium' THEN 0 WHEN 'long' THEN 1 ELSE 2 END, o, doc_id) <= 4),
        p3 AS (SELECT doc_id, lang, 'long' AS picked_for FROM b WHERE doc_id NOT IN (SELECT doc_id FROM p1 UNION ALL SELECT doc_id FROM p2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CASE bin WHEN 'long' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o, doc_id) <= 4)
        SELECT lang, picked_for, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY ALL""",
    "train_val_split": f"WITH {_SPLIT} SELECT doc_id, lang, split FROM x",
    "leakage": f"""WITH {_SPLIT}, p AS (SELECT doc_id, split AS part FROM x UNION SELECT doc_id, 'gold' FROM labels WHERE toxic = 1)
        SELECT v.a || '&' || v.b AS pair, (SELECT count(*) FROM (SELECT doc_id FROM p WHERE part = v.a INTERSECT SELECT doc_id FROM p WHERE part = v.b)) AS n_shared
        FROM (VALUES ('gold', 'train'), ('gold', 'validation'), ('train', 'validation')) v(a, b)""",
    "size_bins": f"SELECT {_BIN} AS bin, count(*) AS n FROM documents GROUP BY bin",
    "token_budget": "SELECT doc_id, CASE WHEN length(text) < 15000 THEN 16384 WHEN length(text) < 30000 THEN 24576 WHEN length(text) < 45000 THEN 32768 ELSE 49152 END AS budget FROM documents",
    "error_class": "SELECT CASE WHEN event_type = '' OR event_type IS NULL THEN 'ok' WHEN regexp_matches(lower(event_type || CASE WHEN value > 50 THEN ': maximum length' ELSE '' END), 'length|max_tokens|maximum|token limit|finish_reason|lengthfinishreason') THEN 'token_overflow' ELSE 'error' END AS class, count(*) AS n FROM events GROUP BY class",
    "exclusion_reasons": "SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN length(text) NOT BETWEEN 200 AND 20000 THEN 'size' ELSE 'kept' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY reason",
    "failure_pending": "SELECT doc_id FROM documents WHERE starts_with(text, 'The') OR NOT (regexp_matches(text, '[A-Za-z0-9.]+@[a-z0-9.]+') OR regexp_matches(text, '[0-9]{4,}'))",
    "upsert_merge": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders",
    "default_lookup": "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "skip_missing": "SELECT doc_id, quality, toxic, source FROM labels JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S')",
    "multi_model_align": "SELECT doc_id, quality, (length(text) > 500)::INTEGER AS m1, (length(text) > 1500)::INTEGER AS m2, (length(text) % 2 = 0)::INTEGER AS m3 FROM labels JOIN documents USING (doc_id)",
    "union_append": "SELECT doc_id, length(text)::INTEGER AS size, CASE WHEN length(text) > 5000 THEN 'long' ELSE 'short' END AS part FROM documents WHERE length(text) > 5000 OR length(text) < 300",
    "map_merge": "SELECT lang, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 20 WHEN 'de' THEN 30 END::INTEGER AS code, count(*) AS n FROM documents GROUP BY lang",
    "prefix_primary_filter": "SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND regexp_matches(p_type, '^(STANDARD|PROMO|A)') GROUP BY p_type",
    "kappa": """WITH r AS (SELECT lang, quality AS a, CASE WHEN regexp_matches(text, '[%#!]{2}') THEN 0 ELSE 1 END AS b FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS po,
              (count(*) FILTER (a = 1) * count(*) FILTER (b = 1) + count(*) FILTER (a = 0) * count(*) FILTER (b = 0)) / (count(*) * count(*))::DOUBLE AS pe FROM r GROUP BY lang)
        SELECT lang, n, round(po, 4) AS agreement, round((po - pe) / nullif(1 - pe, 0), 4) AS kappa FROM s""",
    "approval_rate": "SELECT category, round(avg((status = 1)::INT), 4) AS approval FROM (SELECT 'quality' AS category, quality AS status FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY category",
    "log_metrics": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS most, count(*) FILTER (value > 50) AS n_large FROM events GROUP BY event_type",
    "monthly_counts": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL",
    "spread_top_customers": """WITH s AS (SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey)::INTEGER AS rank FROM s)
        SELECT n_name, rank, c_custkey, spent FROM r JOIN nation ON c_nationkey = n_nationkey WHERE rank <= 3""",
}
