"""Queries on scores, training formats, JSON, reviews and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions import text
from notemill.operators import contract, review, scoring, similarity, training
from notemill.plans.base import documents, table, words
from notemill.streaming import windows

SYSTEM = "Extract the entities as JSON."
MARKERS = ("<start_of_turn>user", "<start_of_turn>model", "<end_of_turn>")


def _gold_and_predicted(spark, d) -> tuple[DataFrame, DataFrame]:
    """Reviewed and predicted word sets: the words of each document's odd lines and of its even ones."""
    lines = documents(spark, d).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    each = lines.select("doc_id", "lang", "n", F.explode(words(F.lower("line"))).alias("item"))
    return each.where("n % 2 = 0").drop("n"), each.where("n % 2 = 1").drop("n")


def set_prf(spark, d):
    gold, predicted = _gold_and_predicted(spark, d)
    return scoring.set_scores(gold, predicted, ["lang"], "item")


def set_prf_per_record(spark, d):
    gold, predicted = _gold_and_predicted(spark, d)
    return scoring.set_scores(gold, predicted, ["lang"], "item", ["doc_id"])


def micro_macro(spark, d):
    return scoring.averages(set_prf(spark, d))


def error_topk(spark, d):
    gold, predicted = _gold_and_predicted(spark, d)
    return scoring.frequent_errors(gold, predicted, "lang", "doc_id", "item", 5)


def model_comparison(spark, d):
    """Two ways to count; a language has no score by record where none of its documents is labelled good."""
    gold, predicted = _gold_and_predicted(spark, d)
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    some = scoring.set_scores(gold.join(good, "doc_id"), predicted.join(good, "doc_id"), ["lang"], "item", ["doc_id"])
    both = set_prf(spark, d).withColumn("mode", F.lit("pooled")).unionByName(some.withColumn("mode", F.lit("per_record")))
    return scoring.comparison(both, "lang", "mode", "f1", ["pooled", "per_record"])


def _titles_and_addresses(spark, d) -> tuple[DataFrame, DataFrame]:
    """Words of the pages' titles and of their addresses, by page: some differ in a few letters."""
    pages = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), F.lower("url").alias("url"))
    gold = pages.select("page_id", F.explode(F.split("title", r"\s+")).alias("item"))
    predicted = pages.select("page_id", F.explode(F.split(F.regexp_replace("url", "[^a-z0-9]+", " "), r"\s+")).alias("item"))
    return gold.where("item <> ''"), predicted.where("item <> ''")


def fuzzy_prf(spark, d):
    return scoring.fuzzy_scores(*_titles_and_addresses(spark, d), "page_id", "item")


def contained_items(spark, d):
    """Pairs of a title's pieces and its address' parts, in plain letters, one of which stands as words in the other."""
    plain = lambda c: F.regexp_replace(text.fold(c), "[^a-z0-9 -]+", "")
    pages = table(spark, d, "pages").select("page_id", plain(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), F.regexp_replace(F.lower("url"), "[^a-z0-9/-]+", "").alias("url"))
    gold = pages.select("page_id", F.explode(text.chunks(F.split("title", " +"), 2, 1)).alias("w")).select("page_id", F.array_join("w", " ").alias("item"))
    predicted = pages.select("page_id", F.explode(F.split("url", "[-/]")).alias("item"))
    return similarity.similar_pairs(gold, predicted, "page_id", "item").where("stands").select("page_id", "l", "r")


def chunks(spark, d):
    cut = documents(spark, d).select("doc_id", F.posexplode(text.chunks(words(F.col("text")), 512, 50)).alias("chunk", "words"))
    return cut.select("doc_id", "chunk", F.size("words").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest"))


def head_tail_truncate(spark, d):
    cut = text.head_tail(F.col("text"), 1000)
    return documents(spark, d).select("doc_id", F.length(cut).alias("size"), F.md5(cut.cast("binary")).alias("digest"))


def chat_messages(spark, d):
    """Each user turn with the assistant turn after it, as system, user and assistant messages."""
    turns = table(spark, d, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("u"))
    answer = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("a"))
    messages = training.chat(F.lit(SYSTEM), F.col("u"), F.to_json(F.struct(F.length("a").alias("size"))))
    made = user.join(answer, ["conv_id", "turn"])
    content = F.concat_ws("\x1f", F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1e"), m["content"])))
    return made.select("conv_id", "turn", F.md5(content.cast("binary")).alias("digest"), training.valid_chat(messages).alias("valid"))


def chat_valid(spark, d):
    turns = table(spark, d, "conversations").withColumn("m", training.chat(F.lit(SYSTEM), F.col("role"), F.col("text")))
    return turns.groupBy(training.valid_chat(F.col("m")).alias("valid")).agg(F.count("*").alias("n"))


def prompt_format(spark, d):
    made = training.prompt([("user", F.coalesce(F.col("text"), F.lit(""))), ("model", F.col("role"))])
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(made.cast("binary")).alias("digest"), training.valid_prompt(made, MARKERS).alias("valid"))


def bio_labels(spark, d):
    """The benchmark's passages with spans of a few frequent words."""
    found = F.array(*[F.struct(F.lit(w).alias("entity"), F.lit(k).alias("label")) for w, k in (("the", "A"), ("of the", "B"), ("and", "C"), ("thand", "D"))])
    spans = training.without_overlaps(training.found_spans(F.col("text"), found))
    tagged = table(spark, d, "benchmark").select("item_id", training.tokens(F.col("text")).alias("t"), spans.alias("s"))
    labels = training.bio(F.col("t"), F.col("s"))
    return tagged.select("item_id", F.size("t").alias("n_tokens"), F.size("s").alias("n_spans"), F.array_join(labels, " ").alias("labels"), training.valid_labels(labels).alias("valid"))


def label_numbers(spark, d):
    ids = training.label_ids(F.split("labels", " "), {"O": 0, "B-A": 1, "I-A": 2, "B-B": 3, "I-B": 4})
    return bio_labels(spark, d).select("item_id", F.aggregate(ids, F.lit(0), lambda a, x: a + x).alias("total"))


def span_table(spark, d):
    tagged = bio_labels(spark, d).select("item_id", F.split("labels", " ").alias("tags"))
    return scoring.label_spans(tagged, "item_id", "tags")


def loss_mask(spark, d):
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    masked = training.loss_labels(ids, [46])  # after the last full stop
    return table(spark, d, "benchmark").select("item_id", F.size(F.filter(masked, lambda x: x != -100)).alias("n_trained"), F.size(masked).alias("n"))


def json_parse(spark, d):
    """Objects, half of them broken off in an array, and some without any."""
    whole = F.concat(F.lit('{"a": ["x", "'), F.col("event_type"), F.lit('"], "b": []}'))
    raw = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("Answer: "), F.left(whole, F.length(whole) - 12))).when(F.col("event_id") % 4 == 3, "none").otherwise(whole)
    parsed = contract.parse_lists(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw")
    return parsed.groupBy("how").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(F.try_element_at("parsed", F.lit("a"))), F.lit(0))).alias("n_items"))


def review_completeness(spark, d):
    rated = table(spark, d, "labels").select("doc_id", F.explode(F.create_map(F.lit("quality"), F.when(F.col("quality") == 1, "ok"), F.lit("toxic"), F.when(F.col("toxic") == 1, "bad"), F.lit("_general"), F.lit("x"))).alias("category", "status"))
    return review.completeness(rated.where("category not like '\\\\_%'"), ["doc_id"], 2)


def extraction_records(spark, d):
    """The extractor's contract with a deterministic stand-in that fails on some texts."""
    find = contract.lexicon_extractor({"disease_or_syndrome": ["the "], "sign_or_symptom": ["tion"]})

    def entities(body: str) -> dict:
        if "%%%" in body:
            raise ValueError("maximum length")
        return find(body)

    notes = documents(spark, d).select(F.col("doc_id").alias("hadm_id"), F.col("lang").alias("icd_code"), "text")
    records = contract.extract(notes, entities, lambda body: {"plan": body[:10]})
    return records.groupBy("codigo_cid", "agent_status.ner_status").agg(F.count("*").alias("n"), F.sum(F.size("ner.disease_or_syndrome") + F.size("ner.sign_or_symptom")).alias("n_entities"))


def events_tumbling(spark, d):
    return windows.counts(table(spark, d, "events"), "ts", "1 day")


def events_sliding(spark, d):
    return windows.counts(table(spark, d, "events"), "ts", "2 days", "1 day")


def events_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


QUERIES = {
    f.__name__: f
    for f in (set_prf, set_prf_per_record, micro_macro, error_topk, model_comparison, fuzzy_prf, contained_items, chunks, head_tail_truncate, chat_messages, chat_valid, prompt_format, bio_labels, label_numbers, span_table, loss_mask, json_parse, review_completeness, extraction_records, events_tumbling, events_sliding, events_sessions)
}

_SETS = r"""li AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
    ln AS (SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM li),
    it AS (SELECT doc_id, lang, n % 2 AS side, unnest(regexp_extract_all(lower(line), '[A-Za-zÀ-ÿ]+')) AS item FROM ln)"""
_PRF = "round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) END, 4) AS precision, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) END, 4) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) END, 4) AS f1"
_SCORES = lambda keys: f"m AS (SELECT {keys}, item, bool_or(side = 0) AS g, bool_or(side = 1) AS p FROM it GROUP BY ALL), c AS (SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM m GROUP BY lang), s AS (SELECT *, {_PRF} FROM c)"
_WINDOW = "SELECT {start}::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {rel} GROUP BY ALL"

_BIO = r"""b0 AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, regexp_extract_all(text, '(\s+|^)\S', 1) AS g FROM benchmark),
    b1 AS (SELECT item_id, unnest(w) AS t, unnest(g) AS gap, generate_subscripts(w, 1) AS i FROM b0),
    tok AS (SELECT item_id, i, t, sum(length(gap) + length(t)) OVER (PARTITION BY item_id ORDER BY i) - length(t) AS s, sum(length(gap) + length(t)) OVER (PARTITION BY item_id ORDER BY i) AS e FROM b1),
    c0 AS (SELECT item_id, instr(lower(text), w) - 1 AS s, instr(lower(text), w) - 1 + length(w) AS e, l FROM benchmark, (VALUES ('the', 'A'), ('of the', 'B'), ('and', 'C'), ('thand', 'D')) v(w, l) WHERE instr(lower(text), w) > 0),
    c1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s, e DESC) AS k FROM c0),
    c2 AS (SELECT item_id, k, s, e, l, e AS last, true AS kept FROM c1 WHERE k = 1
           UNION ALL SELECT c1.item_id, c1.k, c1.s, c1.e, c1.l, CASE WHEN c1.s >= c2.last THEN c1.e ELSE c2.last END, c1.s >= c2.last FROM c1 JOIN c2 ON c1.item_id = c2.item_id AND c1.k = c2.k + 1),
    sp AS (SELECT * FROM c2 WHERE kept),
    hit AS (SELECT tok.item_id, tok.i, arg_min(CASE WHEN tok.s <= sp.s THEN 'B-' ELSE 'I-' END || sp.l, sp.k) AS tag FROM tok JOIN sp ON tok.item_id = sp.item_id AND tok.s < sp.e AND sp.s < tok.e GROUP BY tok.item_id, tok.i),
    tags AS (SELECT tok.item_id, tok.i, coalesce(hit.tag, 'O') AS tag FROM tok LEFT JOIN hit ON tok.item_id = hit.item_id AND tok.i = hit.i)"""

ORACLE_SQL = {
    "contained_items": r"""
        WITH p AS (
            SELECT page_id, string_split_regex(regexp_replace(lower(strip_accents(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))), '[^a-z0-9 -]+', '', 'g'), ' +') AS w,
                   string_split_regex(regexp_replace(lower(url), '[^a-z0-9/-]+', '', 'g'), '[-/]') AS u FROM pages),
        g AS (SELECT DISTINCT page_id, array_to_string(w[i:i + 1], ' ') AS l FROM (SELECT page_id, w, unnest(range(1, greatest(2, len(w)))) AS i FROM p WHERE len(w) > 0)),
        r AS (SELECT DISTINCT page_id, unnest(u) AS r FROM p)
        SELECT page_id, l, r FROM g JOIN r USING (page_id)
        WHERE l <> r AND l <> '' AND r <> '' AND length(l) <> length(r)
              AND regexp_matches(CASE WHEN length(l) > length(r) THEN l ELSE r END, '\b' || regexp_escape(CASE WHEN length(l) > length(r) THEN r ELSE l END) || '\b')""",
    "chat_messages": """SELECT u.conv_id, u.turn, md5('system' || chr(30) || 'Extract the entities as JSON.' || chr(31) || 'user' || chr(30) || coalesce(u.text, '') || chr(31) || 'assistant' || chr(30) || '{"size":' || length(coalesce(a.text, '')) || '}') AS digest, true AS valid
        FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "bio_labels": f"""WITH RECURSIVE {_BIO} SELECT t.item_id, count(*)::INTEGER AS n_tokens, coalesce(any_value(n.n), 0)::INTEGER AS n_spans, string_agg(tag, ' ' ORDER BY i) AS labels, true AS valid
        FROM tags t LEFT JOIN (SELECT item_id, count(*) AS n FROM sp GROUP BY item_id) n ON n.item_id = t.item_id GROUP BY t.item_id""",
    "label_numbers": f"WITH RECURSIVE {_BIO} SELECT item_id, sum(CASE tag WHEN 'B-A' THEN 1 WHEN 'I-A' THEN 2 WHEN 'B-B' THEN 3 WHEN 'I-B' THEN 4 ELSE 0 END)::INTEGER AS total FROM tags GROUP BY item_id",
    "span_table": f"""WITH RECURSIVE {_BIO}, b AS (SELECT *, CASE WHEN tag[1] = 'B' OR lag(i) OVER w IS NULL OR lag(i) OVER w < i - 1 OR lag(tag[3:]) OVER w <> tag[3:] THEN 1 ELSE 0 END AS b FROM tags WHERE tag <> 'O' WINDOW w AS (PARTITION BY item_id ORDER BY i)),
        s AS (SELECT *, sum(b) OVER (PARTITION BY item_id ORDER BY i) AS span FROM b) SELECT item_id, tag[3:] AS label, (min(i) - 1)::INTEGER AS start, max(i)::INTEGER AS "end" FROM s GROUP BY item_id, span, tag[3:]""",
    "set_prf": f"WITH {_SETS}, {_SCORES('lang')} SELECT * FROM s",
    "set_prf_per_record": f"WITH {_SETS}, {_SCORES('lang, doc_id')} SELECT * FROM s",
    "micro_macro": f"WITH {_SETS}, {_SCORES('lang')}, a AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(f1), 4) AS macro_f1 FROM s) SELECT tp, fp, fn, macro_f1, " + _PRF.replace("AS precision", "AS micro_precision").replace("AS recall", "AS micro_recall").replace("AS f1", "AS micro_f1") + " FROM a",
    "error_topk": f"""WITH {_SETS}, m AS (SELECT doc_id, lang, item, bool_or(side = 0) AS g, bool_or(side = 1) AS p FROM it GROUP BY ALL),
        e AS (SELECT lang, CASE WHEN NOT g THEN 'fp' ELSE 'fn' END AS kind, item, count(*) AS n FROM m WHERE NOT g OR NOT p GROUP BY ALL)
        SELECT lang, kind, item, n, row_number() OVER (PARTITION BY lang, kind ORDER BY n DESC, item)::INTEGER AS rank FROM e QUALIFY rank <= 5""",
    "model_comparison": f"""WITH {_SETS}, {_SCORES('lang')}, m2 AS (SELECT lang, doc_id, item, bool_or(side = 0) AS g, bool_or(side = 1) AS p FROM it GROUP BY ALL),
        c2 AS (SELECT lang, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM m2 WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang), s2 AS (SELECT *, {_PRF} FROM c2)
        SELECT s.lang, printf('%.4f', s.f1) AS pooled, coalesce(printf('%.4f', s2.f1), '-') AS per_record FROM s LEFT JOIN s2 USING (lang)""",
    "chunks": """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-zÀ-ÿ]+') AS l FROM documents),
        k AS (SELECT doc_id, l, unnest(range(0, greatest(1, ceil((len(l) - 50) / 462.0)::INTEGER))) AS chunk FROM w WHERE len(l) > 0)
        SELECT doc_id, chunk::INTEGER AS chunk, len(l[chunk * 462 + 1 : chunk * 462 + 512])::INTEGER AS n, md5(array_to_string(l[chunk * 462 + 1 : chunk * 462 + 512], ' ')) AS digest FROM k""",
    "head_tail_truncate": "WITH c AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 490) || chr(10) || '[...]' || chr(10) || right(text, 490) ELSE text END AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS size, md5(t) AS digest FROM c",
    "chat_valid": "SELECT coalesce(json_valid(text), false) AS valid, count(*) AS n FROM conversations GROUP BY ALL",
    "prompt_format": "SELECT conv_id, turn, md5('<start_of_turn>user' || chr(10) || coalesce(text, '') || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || role || '<end_of_turn>' || chr(10)) AS digest, true AS valid FROM conversations",
    "loss_mask": "SELECT item_id, CASE WHEN contains(text, '.') THEN length(text) - (length(text) - length(regexp_extract(text, '[^.]*$'))) ELSE 0 END::INTEGER AS n_trained, length(text)::INTEGER AS n FROM benchmark",
    "review_completeness": "SELECT doc_id, quality + toxic::BIGINT AS n_filled, CASE quality + toxic WHEN 2 THEN 'done' WHEN 1 THEN 'started' ELSE 'open' END AS state FROM labels",
    "extraction_records": """WITH x AS (SELECT lang AS codigo_cid, CASE WHEN contains(text, '%%%') THEN 'token_overflow' ELSE 'ok' END AS ner_status, CASE WHEN contains(text, '%%%') THEN 0 ELSE contains(lower(text), 'the ')::INT + contains(lower(text), 'tion')::INT END AS k FROM documents)
        SELECT codigo_cid, ner_status, count(*) AS n, sum(k)::BIGINT AS n_entities FROM x GROUP BY ALL""",
    "json_parse": "SELECT CASE event_id % 4 WHEN 1 THEN 'repaired' WHEN 3 THEN 'raw' ELSE 'strict' END AS how, count(*) AS n, sum(CASE event_id % 4 WHEN 3 THEN 0 ELSE 2 END)::BIGINT AS n_items FROM events GROUP BY ALL",
    "events_tumbling": _WINDOW.format(start="date_trunc('day', ts)", rel="events"),
    "events_sliding": _WINDOW.format(start="s", rel="(SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events)"),
    "events_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)
        SELECT user_id, sum(b)::BIGINT AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id""",
}
