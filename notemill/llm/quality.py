"""Quality by co-training: a text classifier and a page-metadata classifier teach each other.

The text view sees words and word shapes; the metadata view sees source, language, length and layout. Over rounds each
adds its most confident guesses on unlabelled documents to the other's training set. Both are then calibrated on
labelled documents that neither learnt from, and a small logistic regression over the two calibrated scores is the
result. Every round scores all unlabelled documents in one narrow pass; only what is learnt from is bounded (fit_rows
labelled rows and, by pool_rows, the pseudo-labels that are retained) and is learnt in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import ftrl, wordhash
from notemill.llm.common import BROADCAST_ROWS, cut, map_texts
from notemill.llm.toxicity import _WORD

_NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])
_LINE = np.array([i != 10 for i in range(256)])
#: Upper case A, lower case and other scripts a, digits 0, white space as it is, each sign itself.
_CLASS = np.array([65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 48 if 48 <= i <= 57 else i for i in range(256)], np.uint8)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: Signs, capitals and digits: what the shares of characters are of.
_SHARES = {"sign": (~np.isin(_CLASS, [65, 97, 48, 32, 10, 13, 9]), 50), "upper": (_CLASS == 65, 20), "digit": (_CLASS == 48, 20)}
_SHIFT = np.uint64(64 - ftrl.BITS)
#: A guess on an unlabelled document is confident from this logit on (a probability of 0.95), or from its negative down.
SURE = float(np.log(0.95 / 0.05))


def _feature(name: str, bins: np.ndarray) -> np.ndarray:
    salt = np.uint64(int.from_bytes(name.encode()[:8].ljust(8, b"_"), "little"))
    return (wordhash.mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt) >> _SHIFT).astype(np.int64)


def _share(part: np.ndarray, whole: np.ndarray, bins: int = 20) -> np.ndarray:
    return np.floor(bins * part / np.maximum(whole, 1)).astype(np.int64)


def text_view(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features: words, word shapes (runs of one class of characters as one), shape pairs, shares of classes."""
    count = len(offsets) - 1
    starts, ends, rows = wordhash.spans(data, offsets, _WORD)
    words = wordhash.span_hashes(data, starts, ends, _LOWER)
    classes = _CLASS[data]
    s, e, shape_rows = wordhash.spans(data, offsets, _NOT_SPACE)
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[s] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = wordhash.span_hashes(classes[keep], at[s], at[e]) ^ np.uint64(0x5A)
    pairs, pair_rows = wordhash.joined(shapes, shape_rows, (0, 1))
    size = np.diff(offsets)

    def share(name: str) -> np.ndarray:
        inside, bins = _SHARES[name]
        at = np.searchsorted(np.flatnonzero(inside[data]), offsets)  # how many stand before each row
        return _feature(name, _share(np.diff(at), size, bins))

    shares = [share(name) for name in _SHARES]
    each = np.arange(count)
    index = np.concatenate([(words >> _SHIFT).astype(np.int64), (wordhash.mix(shapes) >> _SHIFT).astype(np.int64), (pairs >> _SHIFT).astype(np.int64), *shares])
    return np.concatenate([rows, shape_rows, pair_rows, *[each] * len(shares)]), index


def meta_view(data: np.ndarray, offsets: np.ndarray, source: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features: source, language, length, and layout (lines, their lengths, ends and repeats)."""
    count, size = len(offsets) - 1, np.diff(offsets)
    starts, ends, rows = wordhash.spans(data, offsets, _LINE)
    lines = np.bincount(rows, minlength=count)
    hashes = wordhash.span_hashes(data, starts, ends)
    order = np.lexsort((hashes, rows))
    again = np.zeros(len(order), np.int64)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    repeats = np.bincount(rows[order], weights=again, minlength=count)
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    closed = np.bincount(rows, weights=np.isin(last, [33, 46, 63]), minlength=count)
    short = np.bincount(rows, weights=(ends - starts) < 40, minlength=count)
    words = np.bincount(wordhash.spans(data, offsets, _NOT_SPACE)[2], minlength=count)
    log = lambda x: np.floor(2 * np.log2(np.maximum(x, 1))).astype(np.int64)
    bins = {"source": source, "lang": lang, "src_lang": source * 31 + lang, "length": log(size), "lines": log(lines), "linelen": log(size / np.maximum(lines, 1)), "closed": _share(closed, lines, 10), "short": _share(short, lines, 10), "repeats": _share(repeats, lines, 20), "wordlen": _share(size, words, 2), "words": log(words)}
    each = np.arange(count)
    return np.tile(each, len(bins)), np.concatenate([_feature(k, v) for k, v in bins.items()])


def _codes(column: pa.Array) -> np.ndarray:
    """A hash of each string; null has its own."""
    distinct = pc.dictionary_encode(column.cast(pa.string()).fill_null("\0null"))
    if not len(distinct):
        return np.empty(0, np.int64)
    hashes = np.array([hash_bytes(v.encode()) for v in distinct.dictionary.to_pylist()], np.int64)
    return hashes[distinct.indices.to_numpy(zero_copy_only=False)]


def hash_bytes(value: bytes) -> int:
    x = 1469598103934665603
    for b in value:
        x = (x ^ b) * 1099511628211 % 2**64
    return x % 2**40


def views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple, tuple]]:
    source, lang = _codes(batch.column("_source")), _codes(batch.column("_lang"))
    for first, count, data, offsets in wordhash.slices(batch.column("_text")):
        part = slice(first, first + count)
        yield first, count, text_view(data, offsets), meta_view(data, offsets, source[part], lang[part])


@dataclass
class Model:
    views: tuple[ftrl.Sparse, ftrl.Sparse]
    scale: np.ndarray  # of each view's logit: slope, offset
    mix: np.ndarray  # weight of each calibrated logit, offset

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return ftrl.logistic((logits * self.scale[:, 0] + self.scale[:, 1]) @ self.mix[:2] + self.mix[2])


def _logit_fit(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Newton's method for logistic regression with a weak pull towards start; the last column of x is 1."""
    w = start.astype(float)
    for _ in range(25):
        p = ftrl.logistic(x @ w)
        g = x.T @ (p - y) + 0.5 * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def learn(features: tuple[list[np.ndarray], list[np.ndarray]], labels: np.ndarray, given: tuple[np.ndarray, np.ndarray], passes: int) -> Model:
    """One round. labels: 1, 0, or -1 if unknown; given: each view's pseudo-labels likewise.

    A fifth of the labelled rows is only for calibration.
    """
    known = np.flatnonzero(labels >= 0)
    check, taught = known[::5], np.setdiff1d(known, known[::5])
    models: list[ftrl.Sparse] = []
    for view in range(2):
        rows = np.union1d(taught, np.flatnonzero((labels < 0) & (given[view] >= 0)))
        y = np.where(labels >= 0, labels, given[view])[rows].astype(float)
        trust = np.where(labels[rows] >= 0, 1.0, 0.5)
        models.append(ftrl.Ftrl(l1=0.5).fit([features[view][i] for i in rows], y, passes, importance=trust).sparse())

    def logits(view: int, rows: np.ndarray) -> np.ndarray:
        table, bias = models[view].table(), models[view].bias
        return np.array([table[features[view][i]].sum() + bias for i in rows])

    y = labels[check].astype(float)
    both = np.stack([logits(v, check) for v in range(2)], 1) if len(check) else np.zeros((0, 2))
    one = np.ones((len(check), 1))
    scale = np.stack([_logit_fit(np.hstack([both[:, [v]], one]), y, np.array([1.0, 0.0])) for v in range(2)])
    calibrated = both * scale[:, 0] + scale[:, 1]
    model = Model((models[0], models[1]), scale, _logit_fit(np.hstack([calibrated, one]), y, np.array([0.5, 0.5, 0.0])))
    return model


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """What the views read, with a key that equal rows share: they have equal features."""
    columns = [F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang")]
    return docs.select(*columns).withColumn("_key", F.xxhash64("_id", F.coalesce("_text", F.lit("\0")), F.coalesce("_source", F.lit("\0")), F.coalesce("_lang", F.lit("\0"))))


def _features(rows: DataFrame) -> DataFrame:
    """(_key, _label, _features: of the text view, of the metadata view) of keyed rows with _label, made where the rows are."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            both = []
            for _, count, a, b in views(batch):
                both += [[x, y] for x, y in zip(ftrl.per_row(*a, count), ftrl.per_row(*b, count), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array(both, kind)], ["_key", "_label", "_features"])

    return map_texts(rows, made, "_key long, _label int, _features array<array<int>>")


def _learnt(rows: DataFrame, given: list[dict[int, int]], passes: int) -> Model | None:
    """A model of the rows that _features() made, in one task. given: by key, each view's pseudo-labels. None without rows."""

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, y, both = [], [], ([], [])
        for batch in batches:
            keys += batch.column("_key").to_pylist()
            y += batch.column("_label").to_pylist()
            lists = batch.column("_features").flatten()  # two a row
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            for i in range(len(lists)):
                both[i % 2].append(flat[ends[i] : ends[i + 1]].copy())
        order = sorted(range(len(keys)), key=lambda i: (keys[i], len(both[0][i])))
        theirs = tuple(np.array([g.get(keys[i], -1) for i in order], int) for g in given)
        m = learn(([both[0][i] for i in order], [both[1][i] for i in order]), np.array([y[i] for i in order], int), theirs, passes)
        row = [[float(v.bias) for v in m.views], [v.index.tolist() for v in m.views], [v.weight.tolist() for v in m.views], [*m.scale.ravel().tolist(), *m.mix.tolist()]]
        kinds = [pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.float32())), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["bias", "index", "weight", "rest"])

    got = map_texts(rows.repartition(1), train, "bias array<double>, index array<array<int>>, weight array<array<float>>, rest array<double>").first()
    if got is None:
        return None
    rest = np.array(got["rest"])
    sparse = [ftrl.Sparse(b, np.array(i, np.int32), np.array(w, np.float32)) for b, i, w in zip(got["bias"], got["index"], got["weight"], strict=True)]
    return Model((sparse[0], sparse[1]), rest[:4].reshape(2, 2), rest[4:7])


def _logits(batch: pa.RecordBatch, model: Model, tables: list[np.ndarray]) -> np.ndarray:
    logits = np.zeros((batch.num_rows, 2))
    for first, count, a, b in views(batch):
        for v, (rows, index) in enumerate((a, b)):
            logits[first : first + count, v] = ftrl.summed(rows, index, tables[v], count) + model.views[v].bias
    return logits


def _guesses(keyed: DataFrame, model: Model, known: DataFrame) -> DataFrame:
    """(_key, _view0, _view1): each view's logit for every keyed row whose id is not among the known ones."""

    def guessed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [v.table() for v in model.views]
        for batch in batches:
            logits = _logits(batch, model, tables)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(logits[:, 0]), pa.array(logits[:, 1])], ["_id", "_key", "_view0", "_view1"])

    kind = f"_id {keyed.schema['_id'].dataType.simpleString()}, _key long, _view0 double, _view1 double"
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then the known rows need not be scored
        return map_texts(keyed.join(F.broadcast(known), "_id", "left_anti"), guessed, kind).drop("_id")
    return map_texts(keyed, guessed, kind).join(known, "_id", "left_anti").drop("_id")  # narrow rows shuffle, texts do not


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, pool_rows: int = 4000, rounds: int = 3, passes: int = 3, exchange: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> tuple[Model, DataFrame]:
    """A model, and the ids of the labelled rows it was fitted on, from the labelled rows whose ids have the smallest hashes and from all unlabelled rows' best guesses.

    Each round all unlabelled rows are scored, rows without an id among them, and each view gives the other its most
    confident new guesses of either label: exchange x pool_rows / rounds of each at most, and no larger a share of
    fewer unlabelled rows than pool_rows. Without labelled rows the model says one half.
    """
    known = cut(labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").cast("int").alias("_label")))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    chosen = known.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id", F.lit(13)), "_id").limit(fit_rows)  # narrow rows
    chosen = cut(chosen)
    keyed = _keyed(docs, id_col, text_col, source_col, lang_col)
    one = F.min(F.struct("_key", "_text", "_source", "_lang", "_label")).alias("one")  # of documents repeated with one id
    rows = cut(_features(keyed.join(F.broadcast(chosen), "_id").groupBy("_id").agg(one).select("_id", "one.*")))
    given: list[dict[int, int]] = [{}, {}]
    model = _learnt(rows, given, passes)
    if model is None:  # no rows to learn from
        none = ftrl.Sparse(0.0, np.empty(0, np.int32), np.empty(0, np.float32))
        return Model((none, none), np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0.5, 0.5, 0.0])), chosen
    for _ in range(rounds):
        guesses = cut(_guesses(keyed, model, known.select("_id")))
        many = max(1, int(exchange * min(pool_rows, guesses.limit(pool_rows).count()) / rounds))
        before = given[0].keys() | given[1].keys()
        for view in range(2):
            taken, logit = given[1 - view], F.col(f"_view{view}")
            picked: list[tuple[int, int]] = []
            for label, sure in ((1, logit), (0, -logit)):
                best = guesses.where(sure >= SURE).groupBy("_key").agg(F.max(sure).alias("_sure")).orderBy(F.desc("_sure"), "_key").limit(many + len(taken)).collect()  # bounded by pool_rows
                picked += [(r["_key"], label) for r in best if r["_key"] not in taken][:many]
            taken.update(picked)
        new = sorted((given[0].keys() | given[1].keys()) - before)
        if new:
            theirs = docs.sparkSession.createDataFrame([(k, -1) for k in new], "_key long, _label int")
            rows = rows.unionByName(cut(_features(keyed.join(F.broadcast(theirs), "_key").dropDuplicates(["_key"]))))
        model = _learnt(rows, given, passes)
    return model, chosen


def score(docs: DataFrame, model: Model, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", only: list[str] | None = None) -> DataFrame:
    """docs (or its columns `only`) with _quality, the probability that the page is good.

    Null texts count as empty, null sources and languages as values of their own.
    """
    kept = only if only is not None else docs.columns
    taken = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("_source"), F.col(lang_col).cast("string").alias("_lang"))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [v.table() for v in model.views]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(model.scores(_logits(batch, model, tables)))], [*kept, "_quality"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[: len(kept)])
    return map_texts(taken, scored, f"{schema}, _quality double")


def rejects(scored: DataFrame, labels: DataFrame, fitted: DataFrame, keep: float = 0.999, accuracy: int = 10_000, id_col: str = "doc_id") -> float:
    """The score below which a page is rejected, from (id_col, _quality) of all rows.

    It lets at least the share keep of the pages that are labelled good and were not fitted on pass, at one half at most:
    a quantile over all such rows, to 1 / accuracy of them. Where nearly none are left to take it from (fewer than
    1 / (1 - keep)), the fitted ones count too. Without labels nothing is rejected.
    """
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    known = scored.join(good, scored[id_col] == good["_id"]).join(F.broadcast(fitted.select("_id", F.lit(True).alias("_seen"))), "_id", "left")  # fit_rows rows
    at = lambda some: F.expr(f"percentile_approx(_quality, {1 - keep}, {accuracy}) {'' if some else 'FILTER (WHERE _seen IS NULL)'}")
    r = known.agg(F.count_if(F.col("_seen").isNull()).alias("n"), at(False).alias("unseen"), at(True).alias("any")).first()
    least = r["unseen"] if r["n"] * (1 - keep) >= 1 else r["any"]
    return 0.0 if least is None else min(0.5, least)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = 0.999, **options) -> DataFrame:
    """id_col, quality_score, keep of every row; keep: the score is not below the one that rejects() finds.

    Null texts count as empty; repeated rows are scored each; no labels: everything is kept. An empty table gives an
    empty result.
    """
    model, fitted = fit(docs, labels, id_col=id_col, **options)
    scored = cut(score(docs, model, only=[id_col]))
    least = rejects(scored, labels, fitted, keep, id_col=id_col)
    return scored.select(id_col, F.col("_quality").alias("quality_score"), (F.col("_quality") >= least).alias("keep"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = 0.999, **options) -> DataFrame:
    """docs without the rows that quality() rejects; all columns stay as they are. The scored table is written once."""
    model, fitted = fit(docs, labels, id_col=id_col, **options)
    scored = cut(score(docs, model))
    return scored.where(F.col("_quality") >= rejects(scored.select(id_col, "_quality"), labels, fitted, keep, id_col=id_col)).drop("_quality")
