"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm import chat, divergence, exact_dedup, minhash, mixing, packing, pii, quality, repeats, rules, sharding, toxicity, vectors
from notemill.llm.common import NOT_SPACE, ensure_checkpoint_dir, read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, all passes over its source together."""
    queue = mixing.mix_queue(read(spark, sf_dir, "documents"), share=1.5, weights=(5, 2, 1), passes=2)
    return queue.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("row")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans' counts and checksum, and all spans; n_* count base spans, which added ones never are."""
    return pii.digest(pii.spans(read(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048, 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(chat.with_forged(read(spark, sf_dir, "conversations")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with near equal bytes; virtual_slot is the slot that the stored map assigns, slot the place in the shard."""
    folder = f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    placed, _ = sharding.shard_documents(read(spark, sf_dir, "documents"), count=40, folder=folder)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, made periodic from some word on for a tenth of the ids, by their checksum."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(NOT_SPACE), F.lit(0))
    n = F.size("_w").cast("long")
    a = F.pmod("_g", n)
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), a.cast("int")), tail), " ")
    rows = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    return rows.select("doc_id", F.when(F.size("_w") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts, a tenth of which with_periods() makes periodic; the longest run, and digests of all and of the rest."""
    found = repeats.tandem_runs(with_periods(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))["run"]
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_minhash": op7_minhash,
    "op8_near_vectors": op8_near_vectors,
    "op9_quality": op9_quality,
    "op10_shard": op10_shard,
    "op11_quality_rules": op11_quality_rules,
    "op12_tandem_runs": op12_tandem_runs,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {
    "op1_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
            FROM documents),
        per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
            SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM per_source),
        levels AS (
            SELECT *, cap / weight AS ratio,
                   (sum(source_size) OVER () * 1.5::DOUBLE
                    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighed),
        chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1),
        goal AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM chosen)), cap) AS target FROM levels),
        ticks AS (SELECT greatest(16, least(4096, (SELECT count(*) FROM sized) // (SELECT count(*) FROM per_source))) AS k),
        queued AS (
            SELECT s.doc_id, s.size, s.key, g.source_size, g.target, p.pass,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source, p.pass ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                   + (p.pass - 1) * g.source_size AS start
            FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source, (VALUES (1), (2)) p(pass)),
        spanned AS (
            SELECT *, k, CASE WHEN size > 0 AND target > 0 THEN unnest(range(greatest(0, least(k, CAST(floor(start * k / target) AS BIGINT)) - 1),
                                                                              least(k, least(k, CAST(floor((start + size) * k / target) AS BIGINT)) + 1) + 1)) END AS j
            FROM queued, ticks WHERE size > 0 AND target > 0),
        bordered AS (SELECT *, CAST(floor(target * j / k) AS BIGINT) AS low, CASE WHEN j = k THEN start + size ELSE CAST(floor(target * (j + 1) / k) AS BIGINT) END AS high FROM spanned),
        fragments AS (
            SELECT doc_id, size, key, pass, least(start + size, high) - greatest(start, low) AS words,
                   CASE WHEN high >= start + size THEN (start + size) / target ELSE (j + 1) / k END AS finish
            FROM bordered WHERE least(start + size, high) > greatest(start, low)),
        ordered AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, pass, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fragments),
        cut AS (
            SELECT doc_id, sum(greatest(0, least(words, (SELECT sum(floor(target)) FROM goal) - before))) AS taken FROM ordered GROUP BY doc_id)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
        FROM queued q LEFT JOIN cut c USING (doc_id) WHERE q.pass = 1""",
    "op6_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        escaped AS (
            SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|/?INST\]|/?ANS\]|/?SYS\]|ROLE:|/ROLE\]|\|image:|\|audio:|\|document:)', '\1\\\2', 'g') AS body FROM turns),
        sized AS (
            SELECT *, length(body) + CASE role WHEN 'user' THEN 3 + 7 + 8 WHEN 'system' THEN 3 + 6 + 7 WHEN 'assistant' THEN 6 + 7 + 4
                                     ELSE 3 + 6 + length(replace(replace(replace(coalesce(role, ''), '%', '%25'), ' ', '%20'), ']', '%5D')) + 2 + 8 END AS chars FROM escaped)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op3_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM hashed WINDOW w AS (PARTITION BY text_sha256)""",
    # a run shows as equal windows of six words at a fixed distance; crc32 is spelt out, as DuckDB has none
    "op12_tandem_runs": r"""
        WITH hashed AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
                       lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) AS h
            FROM documents),
        sized AS (SELECT *, len(w) AS n, h // 10 AS g, row_number() OVER () AS row FROM hashed),
        placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
        spaced AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        words AS (
            SELECT row, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
            FROM (SELECT *, unnest(range(n)) AS i FROM spaced)),
        six AS (
            SELECT row, i, string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS s,
                   count(*) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS k FROM words),
        equal AS (SELECT x.row, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.row = y.row AND x.s = y.s AND x.i < y.i WHERE x.k = 6 AND y.k = 6),
        islands AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM equal),
        stretches AS (SELECT row, q, min(i) AS start, count(*) + 5 + q AS length FROM islands GROUP BY row, q, island),
        long AS (SELECT * FROM stretches WHERE length >= greatest(12, 2 * q)),
        runs AS (
            SELECT * FROM long r WHERE NOT EXISTS (
                SELECT 1 FROM long s WHERE s.row = r.row AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
        gone AS (SELECT DISTINCT row, unnest(range(start + q, start + length)) AS i FROM runs),
        rest AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (row, i) GROUP BY row),
        listed AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY row),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length DESC, start, q) = 1)
        SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
               sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(r.t, '')) AS collapsed_sha256
        FROM sized d LEFT JOIN listed l USING (row) LEFT JOIN best b USING (row) LEFT JOIN rest r USING (row)""",
    "op13_divergence": r"""
        WITH terms AS (
            SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
        kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        per_lang AS (SELECT lang, sum(total) AS n, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        held AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        per_group AS (SELECT g.lang, g.source, coalesce(sum(h.c), 0) AS n FROM groups g LEFT JOIN held h USING (lang, source) GROUP BY g.lang, g.source),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
                   1 + (1000000000::HUGEINT * (coalesce(h.c, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
            FROM per_group g JOIN kept k USING (lang) JOIN per_lang l USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        far AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        parts AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN far f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
            UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE c > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 50""",
}
