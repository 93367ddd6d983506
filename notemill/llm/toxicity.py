"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Fitting reads a bounded sample of labelled rows (fit_rows, the rows of smallest hash) in one task; scoring is one narrow
pass over all texts with the sparse weights sent along. Scores are chances: each third of the sample is scored by a model
of the other two, and isotonic regression on those scores says how often a text with such a score is toxic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm import ftrl, wordhash
from notemill.llm.common import map_texts

#: Letters and digits of ASCII in lower case, and all bytes of other characters, make words.
_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
STEM = 5


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature): words, their first letters, bigrams and skip-grams."""
    for first, count, data, offsets in wordhash.slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        starts, ends, rows = wordhash.spans(data, offsets, _WORD)
        words = wordhash.span_hashes(data, starts, ends)
        stems = wordhash.span_hashes(data, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(0x51)
        pairs, skips = wordhash.joined(words, rows, (0, 1)), wordhash.joined(words, rows, (0, 2))
        hashes = np.concatenate([words, wordhash.mix(stems), pairs[0], skips[0]])
        yield first, count, np.concatenate([rows, rows, pairs[1], skips[1]]), (hashes >> np.uint64(64 - ftrl.BITS)).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _label) of at most so many labelled rows: those whose ids have the smallest hashes. Null labels are left out.

    Of documents repeated with one id, the first by text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(rows))  # at most rows narrow rows
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))


@dataclass
class Chances:
    """A rising curve from a model's sums to chances: knots in ascending order."""

    sums: np.ndarray
    chances: np.ndarray

    def of(self, sums: np.ndarray) -> np.ndarray:
        """The chance of each sum; a thousandth of it is the logistic value, so that different sums keep their order."""
        if not len(self.sums):
            return ftrl.logistic(sums)
        return 0.999 * np.interp(sums, self.sums, self.chances) + 0.001 * ftrl.logistic(sums)


def chances(sums: np.ndarray, labels: np.ndarray) -> Chances:
    """Isotonic regression of labels on sums by pooling adjacent violators; a pool's chance is (its ones + 0.5) / (its rows + 1)."""
    pools: list[list[float]] = []  # least and greatest sum, ones, rows
    order = np.argsort(sums, kind="stable")
    for x, y in zip(sums[order], labels[order], strict=True):
        pools.append([x, x, y, 1.0])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            _, most, ones, rows = pools.pop()
            pools[-1][1:] = [most, pools[-1][2] + ones, pools[-1][3] + rows]
    level = np.maximum.accumulate([(ones + 0.5) / (rows + 1) for _, _, ones, rows in pools]) if pools else np.empty(0)
    return Chances(np.array([x for p in pools for x in p[:2]]), np.repeat(level, 2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = 12000, passes: int = 8, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[ftrl.Sparse, Chances]:
    """Weights and chances from the labelled rows given. Without labelled rows all weights are zero and every score is 0.5."""

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, y = [], [], []
        for batch in batches:
            for _, count, rows, index in features(batch.column("_text")):
                seen += ftrl.per_row(rows, index, count)
            ids += batch.column("_id").cast(pa.string()).to_pylist()
            y += batch.column("_label").to_pylist()
        order = sorted(range(len(seen)), key=lambda i: (ids[i], len(seen[i])))  # whatever order the rows came in
        known, labels = [seen[i] for i in order], np.array([y[i] for i in order], float)
        if not known:
            return
        learnt = lambda rows: ftrl.Ftrl(alpha=1.0, l1=6.0, l2=0.1).fit([known[i] for i in rows], labels[rows], passes).sparse()
        fold, sums = np.arange(len(known)) % folds, np.zeros(len(known))
        for k in range(folds):
            model = learnt(np.flatnonzero(fold != k))
            table = model.table()
            for i in np.flatnonzero(fold == k):
                sums[i] = table[known[i]].sum() + model.bias
        curve, model = chances(sums, labels), learnt(np.arange(len(known)))
        lists = [pa.array([x.tolist()], pa.list_(kind)) for x, kind in ((model.index, pa.int32()), (model.weight, pa.float32()), (curve.sums, pa.float64()), (curve.chances, pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *lists], ["bias", "index", "weight", "sums", "chances"])

    got = map_texts(sample(docs, labels, label, fit_rows, id_col, text_col).repartition(1), train, "bias double, index array<int>, weight array<float>, sums array<double>, chances array<double>").first()
    if got is None:  # no labelled rows at all
        return ftrl.Sparse(0.0, np.empty(0, np.int32), np.empty(0, np.float32)), Chances(np.empty(0), np.empty(0))
    return ftrl.Sparse(got["bias"], np.array(got["index"], np.int32), np.array(got["weight"], np.float32)), Chances(np.array(got["sums"]), np.array(got["chances"]))


def score(docs: DataFrame, model: ftrl.Sparse, keep: list[Column], text_col: str = "text", curve: Chances | None = None) -> DataFrame:
    """The columns keep of every row and its score in [0, 1], by the curve or else logistic; null texts count as empty and get the bias alone."""
    taken = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = [f for f in taken.schema.fields if f.name != "_text"]

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for first, count, rows, index in features(batch.column("_text")):
                total[first : first + count] = ftrl.summed(rows, index, table, count)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(ftrl.logistic(total + model.bias) if curve is None else curve.of(total + model.bias))], [*[f.name for f in fields], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_texts(taken, scored, f"{schema}, score double")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 12000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted of every row, learnt from labels outside the held-out third.

    Rows repeated with one id are scored each; null ids are never held out. Scores depend on the text only.
    """
    model, curve = fit(docs, labels.where(~held_out(F.col(id_col))), "toxic", fit_rows, id_col=id_col, text_col=text_col)
    scored = score(docs, model, [F.col(id_col)], text_col, curve)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
