"""Runs of periodic words, by the linear tandem-repeat method over the words' suffix tree.

Per batch of texts: words repeated in windows of six mark the stretches that can hold a run of twelve words (any run is
covered by such windows, so the sieve is exact); their words are numbered and joined to one string, each stretch ended by
a symbol of its own, which no repeat can cross. On that string

1. blocks of the Lempel-Ziv factorisation are tested for tandem repeats around their borders, which gives for every
   kind of tandem repeat an occurrence that its leftmost one is a rotation of (the leftmost covering set),
2. their ends are located in the suffix tree, which is kept as a suffix array with its intervals of common prefixes,
3. suffix-link walks from there rotate them by a word at a time until a rotation is missing or marked: all kinds,
4. the leaves below a mark are its occurrences; those of one period at consecutive words are one run.

Common extensions in both directions come from the ranks of all substrings of 2^k words, which building the suffix array
by doubling leaves behind. Rows never leave their partition: there is no shuffle, and memory is that of one batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import map_texts

#: Words of a run at least, and words of the windows that mark where one can be.
LEAST, WINDOW = 12, 6
#: Words of texts that are sieved together, and words of stretches that are searched together; a single text may have more.
SLICE_WORDS, STRING_WORDS = 1 << 18, 1 << 17


class Extensions:
    """Suffix array of the integers text and the lengths of common extensions between any two places."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank.astype(np.int32)]
        width = 1
        while int(rank.max(initial=-1)) < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, width = new, 2 * width
            self.levels.append(rank.astype(np.int32))
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.text = text

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b; a <> b, n itself stands for the empty suffix."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (a < self.n) & (b < self.n)
            level = self.levels[k]
            same = np.flatnonzero(inside)
            same = same[level[a[same]] == level[b[same]]]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end at a and b, these included; -1 stands for none."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            width, level = 1 << k, self.levels[k]
            same = np.flatnonzero(np.minimum(a, b) >= width - 1)
            same = same[level[a[same] - width + 1] == level[b[same] - width + 1]]
            a[same] -= width
            b[same] -= width
        return start - a


class Intervals:
    """Locations in the suffix tree: the interval of suffixes that share so many words with the one at a place."""

    def __init__(self, ext: Extensions):
        self.ext = ext
        low = np.zeros(ext.n, np.int64)  # low[r]: words that the suffixes of ranks r - 1 and r share
        low[1:] = ext.ahead(ext.order[:-1], ext.order[1:])
        self.tables = [low.astype(np.int32)]
        while (2 << (len(self.tables) - 1)) <= ext.n:
            t, w = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-w], t[w:]))

    def of(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that begin with the length words at place."""
        lo = self.ext.rank[place].copy()
        hi = lo.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            w, t = 1 << k, self.tables[k]
            j = np.flatnonzero(lo - w + 1 >= 1)  # ranks lo - w + 1 .. lo
            j = j[t[lo[j] - w + 1] >= length[j]]
            lo[j] -= w
            j = np.flatnonzero(hi + w < self.ext.n)  # ranks hi + 1 .. hi + w
            j = j[t[hi[j] + 1] >= length[j]]
            hi[j] += w
        return lo, hi


def _blocks(ext: Extensions) -> np.ndarray:
    """Borders of the Lempel-Ziv factorisation: a block is the longest prefix of the rest that begins earlier, or one word."""
    n = ext.n
    before = np.full(n, -1, np.int64)
    after = np.full(n, -1, np.int64)
    before[ext.order[1:]] = ext.order[:-1]
    after[ext.order[:-1]] = ext.order[1:]
    left, right = before.tolist(), after.tolist()
    for i in range(n - 1, -1, -1):  # leaves the nearest suffixes, above and below in order, that begin earlier
        p, q = left[i], right[i]
        if p >= 0:
            right[p] = q
        if q >= 0:
            left[q] = p
    longest = np.zeros(n, np.int64)
    for near in (np.array(left), np.array(right)):
        j = np.flatnonzero(near >= 0)
        longest[j] = np.maximum(longest[j], ext.ahead(j, near[j]))
    step, at, borders = np.maximum(longest, 1).tolist(), 0, [0]
    while at < n:
        at += step[at]
        borders.append(at)
    return np.array(borders)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): (0, 0, 1, 1, 1) and (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _covering(ext: Extensions, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of tandem repeats, one of each series around a block's border."""
    size = np.diff(borders)
    found = []
    # the end of a block lies in the second half
    block, k = _spread(size)
    h, k = borders[1:][block], k + 1
    j = np.flatnonzero(h < ext.n)
    h, k = h[j], k[j]
    one, two = ext.ahead(h, h - k), ext.behind(h - 1, h - k - 1)
    j = np.flatnonzero((one > 0) & (one + two >= k))
    found.append((np.maximum(h - k - two, h - 2 * k + 1)[j], k[j]))
    # the start of a block lies in the first half; the second is within this block and the next
    block, k = _spread(size + np.append(size[1:], 0))
    h, k = borders[:-1][block], k + 1
    j = np.flatnonzero((h + k < ext.n) & (h > 0))
    h, k = h[j], k[j]
    one, two = ext.ahead(h, h + k), ext.behind(h - 1, h + k - 1)
    j = np.flatnonzero((one > 0) & (two > 0) & (one + two >= k))
    found.append((np.maximum(h - two, h - k + 1)[j], k[j]))
    key = np.unique(np.concatenate([s * (ext.n + 1) + k for s, k in found]))
    return key // (ext.n + 1), key % (ext.n + 1)


def _smallest_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            out[p * p :: p] = np.minimum(out[p * p :: p], p)
    return out


def _primitive(ext: Extensions, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether half is the smallest period of the tandem repeat at start: it has none of half / p for a prime p."""
    factor = _smallest_factors(int(half.max(initial=1)))
    ok, rest = np.ones(len(half), bool), half.copy()
    while len(j := np.flatnonzero(ok & (rest > 1))):
        p = factor[rest[j]]
        period = half[j] // p
        ok[j] = ext.ahead(start[j], start[j] + period) < 2 * half[j] - period
        rest[j] //= p
    return ok


def _vocabulary(ext: Extensions, tree: Intervals, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, last rank, half) of all kinds of tandem repeats, from the covering ones: suffix-link walks.

    A walk goes on from word to word while the text itself holds the next rotation, then looks for it below the suffix
    link's location. All walks take their steps side by side.
    """
    n, text = ext.n, ext.text
    marks = np.empty(0, np.int64)  # first rank * (n + 1) + half
    last: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = half - 1  # rotations that are left
    while len(start):
        more = np.minimum(ext.ahead(start, start + half) - half, left)
        owner, k = _spread(more + 1)
        lo, hi = tree.of(start[owner] + k, 2 * half[owner])
        key = lo * (n + 1) + half[owner]
        new = ~np.isin(key, marks)
        unique, first = np.unique(key[new], return_index=True)
        last.append((lo[new][first], hi[new][first], half[owner][new][first]))
        # a walk whose last location was marked before is done by the walk that marked it
        end = np.cumsum(more + 1) - 1
        on = np.flatnonzero(new[end] & (left > more))
        _, single = np.unique(key[end][on], return_index=True)
        on = on[single]
        marks = np.concatenate([marks, unique])
        start, half, left = (start + more)[on], half[on], (left - more)[on] - 1
        # the rotation: drop the first word of the repeat, append it again
        lo, hi = tree.of(start + 1, 2 * half - 1)
        want, depth = text[start], 2 * half - 1
        a, b = lo.copy(), hi + 1
        while len(j := np.flatnonzero(a < b)):
            m = (a[j] + b[j]) // 2
            smaller = text[np.minimum(ext.order[m] + depth[j], n - 1)] < want[j]
            a[j], b[j] = np.where(smaller, m + 1, a[j]), np.where(smaller, b[j], m)
        place = ext.order[np.minimum(a, n - 1)]
        on = np.flatnonzero((a <= hi) & (text[np.minimum(place + depth, n - 1)] == want))
        start, half, left = place[on], half[on], left[on]
    return tuple(np.concatenate([x[i] for x in last]) if last else np.empty(0, np.int64) for i in range(3))


def runs_of(text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of at least max(least, 2 * period) in text, by start, then period.

    text: integers, of which the last must occur only once.
    """
    ext = Extensions(text)
    tree = Intervals(ext)
    start, half = _covering(ext, _blocks(ext))
    keep = _primitive(ext, start, half)
    lo, hi, half = _vocabulary(ext, tree, start[keep], half[keep])
    owner, k = _spread(hi - lo + 1)
    key = np.unique(half[owner] * (ext.n + 1) + ext.order[lo[owner] + k])
    half, at = key // (ext.n + 1), key % (ext.n + 1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    start, period = at[first], half[first]
    length = count - 1 + 2 * period
    j = np.flatnonzero(length >= np.maximum(least, 2 * period))
    j = j[np.lexsort((period[j], start[j]))]
    return start[j], length[j], period[j]


def _mix(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A hash of each window of WINDOW codes and its row, at the window's first word; windows across rows differ by place."""
    n = max(0, len(codes) - WINDOW + 1)
    out, factor = rows[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 1
    for k in range(WINDOW):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        x = (codes[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(factor)
        out += x ^ (x >> np.uint64(29))
    return out * np.uint64(0x9E3779B97F4A7C15)


def _stretches(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of stretches of LEAST words or more that windows repeated in their row cover; rows is ascending."""
    hashes = _mix(codes, rows)
    n = len(hashes)
    inside = rows[:n] == rows[WINDOW - 1 : WINDOW - 1 + n] if n else np.empty(0, bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(again & inside)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = rows[1:] != rows[:-1]
    opens = np.flatnonzero(covered & (np.concatenate([[True], ~covered[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(covered & (np.concatenate([~covered[1:], [True]]) | edge[1:])) + 1
    long = ends - opens >= LEAST
    return opens[long], ends[long]


def _search(codes: np.ndarray, opens: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start (in codes), length and period of the runs within the stretches, a string of stretches at a time."""
    at = 0
    while at < len(opens):
        to, size = at, 0
        while to < len(opens) and (to == at or size + ends[to] - opens[to] < STRING_WORDS):
            size += int(ends[to] - opens[to]) + 1
            to += 1
        owner, k = _spread(ends[at:to] - opens[at:to] + 1)
        place = opens[at:to][owner] + k  # the one after each stretch becomes its own symbol
        last = place == ends[at:to][owner]
        text = np.where(last, 0, codes[np.minimum(place, len(codes) - 1)])
        text[last] = int(codes.max(initial=0)) + 1 + np.arange(int(last.sum()))
        start, length, period = runs_of(text, least)
        yield place[start], length, period
        at = to


def _rows_of(texts: list[bytes], least: int) -> Iterator[tuple[int, list, bytes]]:
    """(words, [(start, length, period)], text without repeats) of each of texts."""
    words = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    counts = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(counts) - counts
    rows = np.repeat(np.arange(len(words)), counts)
    found: dict[int, list] = {}
    for start, length, period in _search(codes, *_stretches(codes, rows), least):
        of = rows[start]
        for r, s, n, q in zip(of.tolist(), (start - first[of]).tolist(), length.tolist(), period.tolist(), strict=True):
            found.setdefault(r, []).append((s, n, q))
    for r, ws in enumerate(words):
        runs = sorted(found.get(r, []), key=lambda x: (x[0], x[2]))
        if runs:
            drop = np.zeros(len(ws) + 1, np.int64)
            np.add.at(drop, [s + q for s, _, q in runs], 1)
            np.add.at(drop, [s + n for s, n, _ in runs], -1)
            ws = [w for w, d in zip(ws, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]
        yield len(words[r]), runs, b" ".join(ws)


def tandem_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (array of start, length, period by start, then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0; a null text has none. A run is a stretch of
    consecutive words with smallest period q and length >= max(least, 2 * q), least >= 12, that no neighbouring word
    extends keeping period q. collapsed is the text, words joined by one space, without the words that some run holds
    after its first q. Rows repeated with one id, null ids and other columns change nothing: each row is on its own.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not searched")
    kind = "struct<start:bigint,length:bigint,period:bigint>"

    def run(batches: Iterable) -> Iterator:
        fields = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 6 * SLICE_WORDS):  # bytes: some six a word
                    size += len(texts[to].as_py() or b"")
                    to += 1
                rows = list(_rows_of([t or b"" for t in texts[at:to].to_pylist()], least))
                runs = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r[1]] for r in rows], fields)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())], names=["_id", "n_words", "runs", "collapsed"])
                at = to

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_texts(rows, run, f"_id {id_type}, n_words bigint, runs array<{kind}>, collapsed string").withColumnRenamed("_id", id_col)
