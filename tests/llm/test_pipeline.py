"""Each stage of the pipeline against brute force over all that it is given, and the whole run."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from notemill.llm import quality
from tests.llm.test_corpus import best_fit, classes, norm, queued


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes in and what comes out of each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        rows = made.collect()
        out.append((name, docs.collect(), rows, made.columns))
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_stages_follow_one_another(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    sizes = [len(rows) for _, _, rows, _ in stages]
    assert all(c == columns for _, _, _, c in stages[:-1]) and "sequence_id" in stages[-1][3]
    assert len(stages[0][1]) > sizes[0] > sizes[1] >= sizes[2] and sizes[4] > 0


def test_quality_stage_drops_what_scores_below_the_threshold(spark, sf, stages):
    _, before, after, _ = stages[0]
    kept = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("keep").collect()}
    assert {r["doc_id"] for r in after} == kept and len(after) == sum(r["doc_id"] in kept for r in before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_exact_stage_keeps_the_smallest_id_of_each_text(stages):
    _, before, after, _ = stages[1]
    least = {}
    for r in before:
        least[norm(r["text"])] = min(least.get(norm(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def test_near_stage_keeps_the_smallest_id_of_each_class(stages):
    _, before, after, _ = stages[2]
    want = classes([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(want.values()))


def test_mixing_stage_holds_what_the_queue_takes_at_least_half_of(stages):
    _, before, after, _ = stages[3]
    rows = [(r["doc_id"], r["source"], len(norm(r["text"]).split())) for r in before]
    ticks = int(min(4096, max(16, len(rows) // len({s for _, s, _ in rows}))))
    taken, copies = queued(rows, 1.5, (5, 2, 1), 2, ticks), Counter(r["doc_id"] for r in after)
    for i, _, n in rows:
        passes, rest = divmod(taken[i], n) if n else (1, 0)
        assert copies[i] == passes + (rest * 2 >= n > 0 and rest > 0), (i, n, taken[i])


def test_packing_stage_holds_every_token_in_as_few_sequences_as_best_fit(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, before, after, _ = stages[4]
    t, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in before:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r["doc_id"], k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    ends = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) == best_fit([r["length"] for r in after], 2048)


def test_run_equals_its_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    digest = lambda rows: Counter(hashlib.md5(str((r["doc_id"], r["start"], r["length"], r["ids_crc32"])).encode()).hexdigest() for r in rows)
    assert got.columns == stages[-1][3] and digest(got.collect()) == digest(stages[-1][2])
