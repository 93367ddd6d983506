"""Behaviour that the queries over invented words do not reach. All texts are made up."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import lexicons, text
from notemill.operators import checks, cohort, contract, entities, profile, review, scoring, training
from notemill.sources import readers, writers
from notemill.streaming import windows

D, S, P, L, G, O = lexicons.CATEGORIES  # noqa: E741


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def long(spark, rows):
    return spark.createDataFrame(rows, "record_id int, category string, pos int, entity string")


def listed(df):
    return sorted((r["record_id"], r["category"], r["pos"], r["entity"]) for r in df.select("record_id", "category", "pos", "entity").collect())


def test_section_is_null_without_header_and_empty_with_nothing_after_it(spark):
    cut = lambda v: one(spark, v, lambda x: text.section(x, *lexicons.SECTIONS["hpi"]))
    assert cut("HISTORY OF PRESENT ILLNESS: \n ill since May \nPast Medical History: none") == "ill since May"
    assert cut("History of Present Illness:Physical Exam:") == ""
    assert cut("nothing here") is None
    assert cut(None) is None


def test_all_sections_of_one_cut_equal_those_of_their_own(spark):
    rng = random.Random(3)
    bits = [t for h, f in lexicons.SECTIONS.values() for t in (h, *f)]
    texts = ["".join(rng.choice([rng.choice(bits), rng.choice(bits).upper(), rng.choice(bits)[:7], " x\ny ", "Medicationsocial History:", "é𝔘 "]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "x string").withColumn("cut", text.sections(F.col("x"), lexicons.SECTIONS))
    rows = df.select("cut", F.create_map(*[c for k, v in lexicons.SECTIONS.items() for c in (F.lit(k), text.section(F.col("x"), *v))]).alias("own"), "x").collect()
    assert all(r["cut"] == r["own"] for r in rows if r["x"] is not None) and rows[-2]["cut"] is None
    assert sum(v is not None for r in rows[:-2] for v in r["own"].values()) > 100
    with pytest.raises(ValueError):
        text.sections(F.col("x"), {"a": ("one two:", ("two",))})


def test_notes_are_cut_once_for_all_features(spark, sf):
    from notemill.plans import catalogue

    plan = catalogue.QUERIES["clinical_context"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1


def test_key_folds_accents_case_and_space(spark):
    assert one(spark, "  Hipertensão \n Arterial ", text.key) == "hipertensao arterial"


def test_negation_cancels_the_whole_note(spark):
    neg = lambda v: one(spark, v, lambda x: text.negated(x, lexicons.NEGATORS, lexicons.NEGATED_TERMS))
    assert neg("denies any recent fever. Later fever of 39") is True
    assert neg("fever, no pain in the left arm or chills") is False


def test_first_block_goes_and_a_second_stays(spark):
    assert one(spark, "=== a\nb\n=== c\n=== d\n===", text.without_first_block).strip().startswith("c")


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (512, [512]), (513, [512, 51]), (974, [512, 512]), (975, [512, 512, 51])])
def test_chunks_cover_all_and_share_the_overlap(spark, n, sizes):
    got = spark.range(1).select(text.chunks(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), 512, 50).alias("c")).first()["c"]
    assert [len(c) for c in got] == sizes
    assert not n or sorted({x for c in got for x in c}) == list(range(1, n + 1))
    assert all(a[-50:] == b[:50] for a, b in zip(got, got[1:], strict=False))


def test_head_tail_only_beyond_the_limit(spark):
    assert one(spark, "x" * 9000, lambda x: F.length(text.head_tail(x, 9000))) == 9000
    assert one(spark, "x" * 9001, lambda x: F.length(text.head_tail(x, 9000))) == 2 * 4490 + 7


def test_phrases_longest_first(spark):
    assert one(spark, "non-tender, tender, Shortness of Breath", lambda x: text.phrases(x, lexicons.TRANSLATIONS)) == "indolor, doloroso, dispneia"


def test_marker_and_words(spark):
    assert one(spark, "HIV 1 – negativo hoje", lambda x: text.before_marker(x, lexicons.CHECK_NEGATIVE)) == "HIV 1"
    df = spark.createDataFrame([("hepatite b aguda", "hepatite b"), ("hepatite bx", "hepatite b"), ("a.c", "a.c"), ("abc", "a.c")], "a string, b string")
    assert [r[0] for r in df.select(text.contains_word(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_json_length_is_that_of_spaced_json(spark):
    for value in ({"a": 1, "b": ["x, y: z", 'q"'], "c": {}}, {}, {"k": "a\\b"}):
        compact, spaced = (json.dumps(value, ensure_ascii=False, separators=s) for s in ((",", ":"), (", ", ": ")))
        assert one(spark, compact, text.json_length) == len(spaced)


def test_canonical_alias(spark):
    assert [one(spark, v, lambda x: text.canonical(x, lexicons.ALIASES)) for v in (" Tuberculosis ", "HIV", "Malaria")] == ["Tuberculose", "HIV", "Malaria"]


CASES = [(1, D, 0, "Febre"), (1, S, 0, "febre"), (1, S, 1, "FEBRE"), (1, L, 0, "Hb 9"), (1, O, 0, "hb  9"), (1, P, 0, "teste"), (1, D, 1, "Teste"), (1, D, 2, "HAS"), (1, D, 3, "hipertensão")]


def test_precedence_a_keeps_repeats_in_the_winner(spark):
    got = listed(entities.exclusive(long(spark, CASES)))
    assert (1, D, 0, "Febre") in got and not any(c == S for _, c, _, _ in got)
    assert (1, L, 0, "Hb 9") in got and not any(c == O for _, c, _, _ in got)
    kept = listed(entities.exclusive(long(spark, [(1, S, 0, "febre"), (1, S, 1, "Febre")])))
    assert len(kept) == 2


def test_precedence_b_keeps_one_place_but_for_stop_terms(spark):
    got = listed(entities.dedup_across(long(spark, CASES)))
    assert (1, O, 0, "hb  9") in got and (1, L, 0, "Hb 9") not in got
    assert sum("este" in e for *_, e in got) == 2


def test_clean_is_stable_from_the_second_time_on(spark):
    table = entities.canonical_table(spark)
    rows = long(spark, [*CASES, (2, D, 0, "TB"), (2, S, 0, "Tuberculose"), (2, O, 1, "mtb"), (2, L, 0, "Mycobacterium tuberculosis")])
    first = entities.clean(rows, table)
    second, third = (listed(x) for x in (entities.clean(first, table), entities.clean(entities.clean(first, table), table)))
    assert second == third and listed(first) != second
    assert [e for r, c, _, e in listed(first) if (r, c) == (1, D) and "ipert" in e] == ["Hipertensão arterial sistêmica"]


def test_imaging_moves_to_symptoms_once(spark):
    got = listed(entities.recategorise(long(spark, [(1, D, 0, "Nódulo, à direita"), (1, D, 1, "nodulo"), (1, D, 2, "xnodulo"), (1, S, 0, "Nodulo")]), entities.imaging_pattern(), D, S))
    assert got == [(1, D, 2, "xnodulo"), (1, S, 0, "Nodulo"), (1, S, 1, "Nódulo, à direita")]


def test_vitals_and_layers(spark):
    rows = [(1, L, 0, "PA 120x80"), (1, L, 1, "pancreatina"), (1, L, 2, "Temperatura 38"), (1, D, 0, "rash"), (1, S, 0, "exantema"), (1, D, 1, "derrame pleural leve")]
    got = listed(entities.layered(long(spark, rows)))
    assert [e for _, c, _, e in got if c == L] == ["pancreatina"]
    assert (1, D, 0, "exantema") in got and (1, S, 1, "derrame pleural leve") in got and len(got) == 3
    again = checks.repeated_keys(entities.layered(long(spark, rows)))
    assert again.count() == 0


def test_checks_hit_and_miss(spark):
    rows = [(1, L, 0, "HIV negativo"), (1, D, 0, "hiv"), (1, L, 1, "VDRL pendente"), (1, O, 0, "VDRL"), (1, D, 1, "Febre"), (1, D, 2, "Derrame pleural"), (1, D, 3, "dislipidemia"), (1, D, 4, "Hiperlipidemia"), (1, S, 0, "chest pain"), (1, L, 2, "SpO2 90"), (2, D, 0, "gota")]
    context = spark.createDataFrame([(1, "nada"), (2, "gota")], "record_id int, context string")
    found = {(r["record_id"], r["check"]) for r in checks.all_checks(long(spark, rows), context).collect()}
    assert found == {(1, c) for c in ("negative_test", "pending_test", "symptom_as_disease", "imaging_as_disease", "synonyms", "language", "vital_as_lab")}
    said = spark.createDataFrame([(1, "há derrame pleural hoje")], "record_id int, context string")
    assert not checks.containing(long(spark, rows), "derrame pleural", "x", D, said).count()


def test_counts_edges_and_scores(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 9, 10, 19, 20, 499, 500)], "n int")
    assert {r["bin"]: r["n"] for r in cohort.histogram(df, "n", (0, 1, 2, 3, 5, 10, 20, 50, 100, 500), "500+").collect()} == {"0": 1, "1": 1, "2": 1, "3-4": 2, "5-9": 2, "10-19": 2, "20-49": 1, "100-499": 1, "500+": 1}
    score = lambda n, m: spark.range(1).select(cohort.complexity({"negations": F.lit(1), "pending": F.lit(0), "differentials": F.lit(0), "medications": F.lit(m)}, {"haart": F.lit(True)}, F.lit(n)).alias("s")).first()["s"]
    assert [score(10000, 4), score(10001, 5), score(15001, 5)] == [12, 16, 21]
    assert profile.sensitivity(spark.createDataFrame([], "a boolean, b boolean"), F.col("a"), F.col("b")).first()["sensitivity"] is None


def test_null_key_is_not_kept_out_but_dropped(spark):
    df, ids = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert [r["k"] for r in cohort.keep_out(df, ids, "k").collect()] == [2]


def test_upsert_takes_the_last_and_ignores_new_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (9, "z", 1)], "k int, v string, version int")
    assert sorted(map(tuple, cohort.upsert(old, new, "k", "version").collect())) == [(1, "d", "x"), (2, "b", "y")]


def test_split_gives_each_class_a_validation_row(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(25)], "id int, c string")
    got = cohort.split(df, "c", [F.col("id")]).groupBy("c", "split").count().collect()
    assert {(r["c"], r["split"]): r["count"] for r in got} == {("a", "train"): 22, ("a", "validation"): 2, ("b", "validation"): 1}


def test_scores_pooled_and_by_record(spark):
    gold = spark.createDataFrame([(1, "s", "febre"), (2, "s", "febre")], "r int, c string, e string")
    got = spark.createDataFrame([(1, "s", "febre")], "r int, c string, e string")
    assert scoring.set_scores(gold, got, ["c"], "e").first()["recall"] == 1.0
    assert scoring.set_scores(gold, got, ["c"], "e", ["r"]).first()["recall"] == 0.5
    none = spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int").withColumns(scoring.prf(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 1.0, 1.0)


def test_fuzzy_matches_words_and_near_spellings(spark):
    gold = spark.createDataFrame([("s", "dor toracica"), ("s", "pneumonia"), ("s", "tosse")], "c string, e string")
    got = spark.createDataFrame([("s", "dor toracica intensa"), ("s", "pneumonias"), ("s", "febre")], "c string, e string")
    r = scoring.fuzzy_scores(gold, got, "c", "e").first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1)


def test_spans_and_tags(spark):
    ents = F.array(F.struct(F.lit("New York").alias("entity"), F.lit("P").alias("label")), F.struct(F.lit("york").alias("entity"), F.lit("Q").alias("label")), F.struct(F.lit("none").alias("entity"), F.lit("R").alias("label")))
    df = spark.createDataFrame([("  in new york, now",)], "body string")
    spans = training.without_overlaps(training.found_spans(F.col("body"), ents))
    r = df.select(training.tokens(F.col("body")).alias("t"), spans.alias("s")).select(F.expr("transform(t, x -> struct(x.token, x.start, x.end))").alias("t"), training.bio(F.col("t"), F.col("s")).alias("b")).first()
    assert [tuple(x) for x in r["t"]] == [("in", 2, 4), ("new", 5, 8), ("york,", 9, 14), ("now", 15, 18)]
    assert r["b"] == ["O", "B-P", "I-P", "O"]
    tags = spark.createDataFrame([(1, ["O", "B-P", "I-P", "I-Q", "O", "B-P", "B-P"])], "i int, tags array<string>")
    assert sorted((r["label"], r["start"], r["end"]) for r in scoring.label_spans(tags, "i", "tags").collect()) == [("P", 1, 3), ("P", 5, 6), ("P", 6, 7), ("Q", 3, 4)]


def test_loss_mask(spark):
    masked = lambda ids: spark.createDataFrame([(ids,)], "x array<int>").select(training.loss_labels(F.col("x"), [7, 8]).alias("y")).first()["y"]
    assert masked([1, 7, 8, 2, 3]) == [-100, -100, -100, 2, 3]
    assert masked([1, 2]) == [-100, -100]


@pytest.mark.parametrize(("raw", "value"), [('{"a": ["x"]}', {"a": ["x"]}), ('so: {"a": ["x"]} done', {"a": ["x"]}), ('{"a": ["x", "y', {"a": ["x", "y"]}), ('{"a": ["x"], "b', {"a": ["x"]}), ("none", None), ("", None), (None, None)])
def test_json_repair(raw, value):
    assert contract.repaired(raw) == value


def test_extractor_never_raises(spark):
    def bad(_):
        raise RuntimeError("maximum length " + "x" * 900)

    notes = spark.createDataFrame([(1, "A15", "t"), (2, None, None)], "hadm_id int, icd_code string, text string")
    rows = contract.extract(notes, bad, lambda t: {"plan": "p"}).collect()
    assert {r["agent_status"]["ner_status"] for r in rows} == {"token_overflow"}
    assert all(len(r["agent_status"]["ner_error"]) == 500 and r["ner"][D] == [] and r["soap"]["plan"] == "p" for r in rows)


def test_review_states(spark):
    rows = [("a", "c", None), ("b", "c", "ok"), ("d", "c", "ok"), ("d", "e", "ok")]
    got = review.completeness(spark.createDataFrame(rows, "r string, category string, status string"), ["r"], 2)
    assert {r["r"]: r["state"] for r in got.collect()} == {"a": "open", "b": "started", "d": "done"}
    exports = spark.createDataFrame([("1", '{"c": {"status": "ok", "comment": ""}, "_general": {"status": "x"}}'), ("2", "{broken")], "id string, raw string")
    parsed = review.parsed(exports, "raw")
    assert [(r["id"], r["category"]) for r in review.entries(parsed, "id", F.col("state")).collect()] == [("1", "c")]


def test_round_trips(spark, tmp_path):
    notes = spark.createDataFrame([(1, 'a "quoted"\nline, é'), (2, None)], "id int, note string")
    writers.csv(notes, f"{tmp_path}/csv")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/csv", "id int, note string").collect())) == [(1, 'a "quoted"\nline, é'), (2, None)]
    writers.csv_to_parquet(spark, {f"{tmp_path}/csv": f"{tmp_path}/pq"}, "id int, note string")
    assert readers.parquet(spark, f"{tmp_path}/pq", ["id"]).count() == 2
    writers.ndjson(notes, f"{tmp_path}/js")
    assert readers.ndjson(spark, f"{tmp_path}/js", "id int, note string").count() == 2
    with pytest.raises(ValueError, match="raw text"):
        writers.parquet(notes.withColumnRenamed("note", "text"), f"{tmp_path}/no")


def test_records_in_every_wrapping(spark, tmp_path):
    record = {"paciente_id": "7", "ner": {D: ["x"]}, "soap": {"plan": "p"}}
    for name, value in (("bare", [record]), ("wrapped", {"notes": [record]}), ("single", record)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        got = readers.records(spark, str(tmp_path / f"{name}.json")).collect()
        assert [(r["paciente_id"], r["ner"][D], r["ner"][S], r["soap"]["course"]) for r in got] == [("7", ["x"], [], "")]


def test_events_skip_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "1", "msg": "done", "data": {"a": "1"}}\n\n{"broken\n{"msg": "other"}\n')
    assert readers.events(spark, str(tmp_path / "log.jsonl"), "done").count() == 1


def test_file_names_and_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("amostra_HIV_B20_42.txt", "one\ntwo")
        z.writestr("odd.txt", "x")
    readers.unpacked(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    got = readers.named_parts(readers.text_files(spark, str(tmp_path / "out"))).orderBy("name").collect()
    assert [(r["target"], r["code"], r["id"], r["text"]) for r in got] == [("HIV", "B20", "42", "one\ntwo"), ("unknown", "unknown", "unknown", "x")]


def test_batches_resume(spark, tmp_path):
    df = spark.range(50)
    for _ in range(2):
        writers.in_batches(df, f"{tmp_path}/b", lambda x: x, "id", 4)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 50


def test_reports(spark):
    df = spark.createDataFrame([("<a>", None)], "t string, x int")
    assert "&lt;a&gt;" in writers.html_pages(df, "t", ["x"]).first()["html"]
    assert writers.markdown(df).splitlines()[-1] == "| <a> | - |"


def test_streamed_windows_equal_batch_ones(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = windows.counts(windows.read_events(spark, f"{tmp_path}/in", batch.schema), "ts", "1 day", late="100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    count = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert count(spark.table("w")) == count(windows.counts(batch, "ts", "1 day"))


def test_clinical_features_on_a_note(spark):
    from notemill.operators import features

    body = "History of Present Illness:\nFever, chills and myalgia after a trip.\nPast Medical History: HTN, DM2\nSocial History:\nPhysical Exam:\nTemp: 101.3 then T 98.0\nPertinent Results:\nplts were 80\nMedications on Admission:\nTylenol\nDischarge Medications:\nDischarge Diagnosis:\nMalaria (plasmodium vivax)\nDischarge Condition:"
    df = spark.createDataFrame([(body,), ("nothing",), (None,)], "x string")
    x = F.col("x")
    flags = features.symptoms(x)
    got = df.select(*[c.alias(k) for k, c in {**flags, **features.context(x), **features.laboratory(x)}.items()], features.alert(flags).alias("alert"), features.labels(x)["diag_malaria"].alias("malaria"), features.complexity(F.coalesce(x, F.lit(""))).alias("score")).collect()
    one = got[0].asDict()
    assert one["fever"] and one["myalgia"] and one["alert"] and one["malaria"] and one["travel"] and one["antipyretic"] and not one["antimalarial"]
    assert one["measured"] == 101.3 and one["objective_fever"] and one["diabetes"] and one["hypertension"] and one["platelets"]
    assert got[1]["fever"] is None and got[1]["alert"] is None and got[1]["malaria"] is None and got[1]["measured"] is None and got[1]["score"] == 0


def test_mentions_follow_the_rows_target_and_its_aliases(spark):
    from notemill.operators import features

    df = spark.createDataFrame([("=== a\nhiv\n===\nHIV on truvada, CD4 high", "hiv"), ("rpr and vdrl", "syphilis"), ("rpr", "malaria"), ("hiv", None)], "x string, t string")
    assert [r[0] for r in df.select(features.target_mentions(F.col("x"), F.col("t"))).collect()] == [3, 2, 0, 0]


def test_checks_in_one_pass_equal_each_on_its_own(spark):
    rng = random.Random(6)
    pool = ["HIV", "hiv", "HIV negativo", "hiv: pendente", "febre", "Febre", "HAS", "hipertensao", "Derrame pleural", "derrame pleural", "chest pain", "SpO2 97", "Nódulo pulmonar", "negativo", "dislipidemia", "hiperlipidemia", "tosse"]
    rows = [(k, rng.choice(lexicons.CATEGORIES), n, rng.choice([x for x in pool])) for k in range(60) for n in range(rng.randint(0, 14))] + [(None, D, 0, "febre"), (None, D, 1, "febre")]
    context = spark.createDataFrame([(k, "tem derrame pleural") for k in range(0, 60, 3)], "record_id long, context string")
    e = long(spark, rows)
    parts = [checks.repeated_keys(e), checks.leaked_tests(e, lexicons.CHECK_NEGATIVE, "negative_test", L, (D, O)), checks.leaked_tests(e, lexicons.CHECK_PENDING, "pending_test", L, (D, O)), checks.listed(e, lexicons.CHECK_SYMPTOMS, "symptom_as_disease", D)]
    parts += [checks.containing(e, "(" + "|".join(lexicons.CHECK_IMAGING) + ")", "imaging_as_disease", D, context), checks.synonyms(e, lexicons.CHECK_SYNONYMS), checks.containing(e, lexicons.CHECK_ENGLISH, "language"), checks.containing(e, lexicons.CHECK_VITALS, "vital_as_lab", L)]
    want = sorted(str(tuple(r)) for p in parts for r in p.select(*checks.ISSUE).collect())
    got = checks.all_checks(e, context)
    assert sorted(str(tuple(r)) for r in got.select(*checks.ISSUE).collect()) == want and len({r["check"] for r in got.collect()}) == 8
    plan = checks.all_checks(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    ids = spark.range(70).select(F.col("id").alias("record_id"))
    report = {r["record_id"]: r for r in checks.report(e, context, ids).collect()}
    assert set(report) == set(range(70)) and report[69]["n_issues"] == 0 == report[69]["n_entities"] and report[69]["issues"] == []
    for k in range(60):
        mine = [r for r in got.where(F.col("record_id") == k).collect()] if k < 3 else None
        assert report[k]["n_entities"] == sum(r[0] == k for r in rows) and report[k]["n_issues"] == sum(report[k]["by_check"].values()) == len(report[k]["issues"])
        assert mine is None or sorted(r["check"] for r in mine) == [i["check"] for i in report[k]["issues"]]


def test_layers_mark_what_they_touch_on_one_shuffle(spark):
    plan = entities.layer_marks(long(spark, [(1, D, 0, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tags_by_sweep_equal_tags_by_comparison(spark):
    rng = random.Random(8)
    for _ in range(400):
        at, toks = 0, []
        for _ in range(rng.randint(0, 12)):
            at += rng.randint(1, 3)
            toks.append((at, at := at + rng.randint(1, 5)))
        spans = [(s, s + rng.randint(1, 12), rng.choice("AB")) for s in (rng.randint(0, 50) for _ in range(rng.randint(0, 6)))]
        want = []
        for a, b in toks:
            hit = next((s for s in spans if a < s[1] and s[0] < b), None)
            want.append("O" if hit is None else ("B-" if a <= hit[0] else "I-") + hit[2])
        assert training.swept(*(zip(*toks, strict=True) if toks else ([], [])), *(zip(*spans, strict=True) if spans else ([], [], []))) == want


def test_tags_of_a_very_long_text_take_linear_time(spark):
    import time

    def took(n):
        body = " ".join(f"w{i}" for i in range(n))
        spans = F.transform(F.sequence(F.lit(0), F.lit(n // 4)), lambda i: F.struct((i * 20).alias("start"), (i * 20 + 7).alias("end"), F.lit("X").alias("label")))
        df = spark.createDataFrame([(body,), (None,)], "x string").select(training.tokens(F.col("x")).alias("t"), spans.alias("s"))
        began = time.time()
        rows = df.select(training.bio(F.col("t"), F.col("s")).alias("b")).collect()
        assert len(rows[0]["b"]) == n and rows[1]["b"] is None
        return time.time() - began

    took(100)
    assert took(160_000) < 10 * max(1.0, took(20_000))


MARKED = (
    "Pt. seen by Dr. Smith at 9 a.m. today.| He denies chest pain.| BP 120/80, temp. 37.8 C.",
    "Given 2.5 mg p.o. b.i.d. for pain.| Discharged home.",
    "Meds:|1. Aspirin 81 mg daily|2. Lisinopril 10 mg|3. Insulin 10 units s.c. at night.| Follow up in 2 wks.",
    "No fever.| No chills!| Any rash?| None seen.",
    "J. R. Costa was referred by Prof. Lima.| Hx. of TB vs. sarcoidosis.",
    'She said "I feel fine."| Exam was normal (see note.)| Plan: rest.',
    "The patient was admitted with\nfever and cough.| Cultures were sent.",
    "Labs: Na 140, K 4.2.| 2 units were given.| WBC 12.3 K.",
    "Assessment:|Stable.|Plan:|Continue meds, e.g. Tylenol 500 mg q.i.d. as needed.",
    "Paciente com febre.| Sem queixas.| Água e repouso.| É alérgico.",
)


def test_sentences_as_marked_by_hand(spark):
    made = [(k, re.sub(r"\|(?! )", "\n", m).replace("|", "")) for k, m in enumerate(MARKED)]
    got = dict(spark.createDataFrame(made, "k int, x string").select("k", text.clinical_sentences(F.col("x"), 0)).collect())
    assert got == {k: [re.sub(r"\s+", " ", s).strip() for s in m.split("|")] for k, m in enumerate(MARKED)}
    assert spark.createDataFrame([(None,)], "x string").select(text.clinical_sentences(F.col("x"))).first()[0] is None


def test_exports_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    writers.json_array(df, f"{tmp_path}/array")
    text_of = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert json.loads(text_of("array")) == [{"k": "a", "n": 1}, {"k": "b", "n": 2}]
    with pytest.raises(ValueError, match="NDJSON"):
        writers.json_array(df, f"{tmp_path}/more", rows=1)
    assert writers.markdown(df).splitlines()[2:] == ["| a | 1 |", "| b | 2 |"]
    assert writers.report("Run", {"seconds": 2.5, "records": 3}, {"Checks": df}) == "# Run\n\n- seconds: 2.5\n- records: 3\n\n## Checks\n\n" + writers.markdown(df)
    counts = entities.layer_counts(long(spark, [(1, D, 0, "Derrame pleural"), (1, L, 0, "SpO2 97"), (1, S, 0, "rash"), (2, S, 0, "dor"), (2, S, 1, "Dor")]))
    writers.stats(counts, f"{tmp_path}/stats", 1.234, 2)
    got = json.loads(text_of("stats"))
    assert got["duration_seconds"] == 1.23 and got["aggregate"] == {"across": 1, "imaging": 1, "language": 1, "vitals": 1}
    assert got["examples"]["imaging"] == ["Derrame pleural"] and got["examples"]["across"] == ["Dor"]
    page = writers.index_page(spark.createDataFrame([("<b>", "x.html"), ("a", "y.html")], "t string, f string"), "t", "f", "All").first()["html"]
    assert page == '<html><body><h1>All</h1><ul><li><a href="x.html">&lt;b&gt;</a></li><li><a href="y.html">a</a></li></ul></body></html>'


def test_spans_score_by_exact_place(spark):
    tags = lambda rows: spark.createDataFrame(rows, "id int, tags array<string>")
    gold = tags([(1, ["B-A", "I-A", "O", "B-B"]), (2, ["O"])])
    predicted = tags([(1, ["B-A", "O", "O", "B-B"]), (2, ["B-A"])])
    got = {r["label"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in scoring.span_scores(gold, predicted, "id", "tags").collect()}
    assert got == {"A": (0, 2, 1, 0.0), "B": (1, 0, 0, 1.0)}


def test_anchors_come_besides_quotas(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, c string")
    quota = spark.createDataFrame([("a", 2), ("b", 1)], "c string, quota int")
    got = cohort.anchored(df, df.where("id in (0, 2, 3)"), "id", ["c"], quota, [F.col("id")]).collect()
    assert sorted(r["id"] for r in got if r["anchor"]) == [0, 2, 3] and sorted(r["id"] for r in got if not r["anchor"]) == [1, 4, 6]


def test_split_counts_borders_and_ties(spark):
    df = spark.createDataFrame([(i, "x" if i < 97 else "y", "00000000" if i < 60 else f"{i:08x}") for i in range(100)], "id int, c string, h string")
    got = cohort.split(df, "c", [F.col("h"), F.format_string("%04d", "id")]).where("split = 'validation'").collect()
    assert sorted(r["id"] for r in got) == [*range(9), 97]


def test_agreement_over_all_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")
    r = profile.agreement(df, [], "a", "b").first()
    assert (r["n"], r["agreement"], r["kappa"]) == (4, 0.75, 0.5)


def test_json_with_anything_behind_it_is_none(spark):
    df = spark.createDataFrame([(x,) for x in ('{"a": 1}', '{"a": 1}}', "1,2", "", None, "nothing", '"x"', "[1")], "x string")
    assert [r[0] for r in df.select(text.is_json(F.col("x"))).collect()] == [True, False, False, False, False, False, True, False]


def test_nested_dictionary(spark):
    df = spark.createDataFrame([("s", "fever", "en", ["a"]), ("s", "fever", "de", ["b", "c"]), ("t", "rash", "en", [])], "g string, k string, l string, v array<string>")
    assert json.loads(contract.nested(df, ["g", "k", "l"], "v").first()["value"]) == {"s": {"fever": {"de": ["b", "c"], "en": ["a"]}}, "t": {"rash": {"en": []}}}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 9001, 20000])
def test_medians_without_gathering_a_group(spark, n):
    import statistics

    rows = [(k, None if (i * 7) % 11 == 0 and n > 5 else float((i * 7919 + k) % 5003) / 3) for k in range(2) for i in range(n)]
    got = {r["k"]: r["median"] for r in profile.medians(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()}
    assert got == {k: pytest.approx(statistics.median([v for j, v in rows if j == k and v is not None])) for k in range(2)}


def test_medians_of_values_far_apart_and_infinite(spark):
    import statistics

    groups = {1: [float("-inf")] * 3 + [float("inf")] * 4, 2: [10.0 ** (k - 300) for k in range(0, 600, 7)], 3: [5.0] * 5000 + [6.0] * 5000, 4: [float(i) for i in range(9999)] + [1e300]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    for parts in (1, 4096):
        assert {r["k"]: r["median"] for r in profile.medians(df, "k", "v", parts=parts).collect()} == {k: statistics.median(v) for k, v in groups.items()}


def test_neighbours_fill_as_bin_after_bin(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.choice(["s", "s", "m", "l", "other"])) for i in range(160)] + [(500 + i, "z", "l") for i in range(3)]
    quota, near = {"s": 20, "m": 25, "l": 30}, {"s": ("m", "l"), "m": ("l", "s"), "l": ("m",)}
    got = cohort.filled_from_neighbours(spark.createDataFrame(rows, "id int, c string, b string"), "c", "b", quota, near, [F.col("id")])
    want = set()
    for c in ("x", "y", "z", None):
        used = set()
        for target, n in quota.items():
            preferred = [target, *near[target]]
            free = sorted((preferred.index(b), i) for i, k, b in rows if k == c and b in preferred and i not in used)[:n]
            used |= {i for _, i in free}
            want |= {(c, target, i, r + 1) for r, (_, i) in enumerate(free)}
    rank = {(r["c"], r["picked_for"], r["id"]): r["rank"] for r in got.collect()}
    assert {k[:3] for k in want} == set(rank) and got.columns == ["id", "c", "b", "rank", "picked_for"]
    for c, t in {k[:2] for k in want}:
        assert sorted(rank[k] for k in rank if k[:2] == (c, t)) == sorted(k[3] for k in want if k[:2] == (c, t))


def test_row_dicts_are_bounded(spark):
    df = spark.createDataFrame([(1, [2]), (2, None)], "a int, b array<int>")
    assert sorted(profile.row_dicts(df), key=lambda r: r["a"]) == [{"a": 1, "b": [2]}, {"a": 2, "b": None}]
    with pytest.raises(ValueError, match="more than 1 rows"):
        profile.row_dicts(df, 1)


def test_settings(spark, tmp_path):
    from notemill import config

    (tmp_path / "a.json").write_text('{"seed": 7, "quotas": {"x": {"short": 2}}}')
    got = config.load(str(tmp_path / "a.json"))
    assert got.seed == 7 and got.quotas["x"]["short"] == 2 and got.validation_share == 0.1 and config.of(None) == config.Settings()
    with pytest.raises(ValueError, match="no such setting: sed"):
        config.of({"sed": 1})
    assert config.read(spark, f"file://{tmp_path}/a.json") == got
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("validation_share: 0.2\nanchors: {a1: x}\n")
    assert config.load(str(tmp_path / "a.yaml")).anchors == {"a1": "x"}


def test_an_index_of_any_length_is_the_page_in_pieces(spark):
    rows = spark.createDataFrame([(f"<{i % 700}>", f"{i}.html") for i in range(900)] + [(None, "x")], "t string, f string").repartition(5)
    page = writers.index_page(rows.where("t is not null"), "t", "f", "All").first()["html"]
    pieces = writers.index_pieces(rows, "t", "f", "All", size=2000)
    got = sorted((r["part"], r["n"], r["piece"]) for r in pieces.collect())
    assert "".join(p for _, _, p in got) == page and len(got) > 10 and max(len(p) for _, _, p in got) < 2100
    assert writers.digest(pieces).first()["digest"] == hashlib.md5(page.encode()).hexdigest()
    assert writers.digest(writers.index_pieces(rows.limit(0), "t", "f", "All")).first()["digest"] == hashlib.md5(b"<html><body><h1>All</h1><ul></ul></body></html>").hexdigest()
    many = writers.index_pieces(spark.range(100_003).selectExpr("cast(id as string) t"), "t", "t", "All")  # index_page() refuses so many
    assert many.agg(F.sum(F.length("piece"))).first()[0] == 47 + sum(len(f'<li><a href="{i}">{i}</a></li>') for i in range(100_003))
