"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs on the driver over counts of pieces by length (at most `capacity` of them), never over the
pieces. What it plans are runs: `times` sequences with one same list of lengths. A piece then takes its place by
looking up its rank among the pieces of its length, so no sequence is ever assembled in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import wordhash
from notemill.llm.common import cut, held, map_texts, spread_rank

CAPACITY = 2048
#: Words whose ids a task keeps; beyond them only those of the slice at hand stay. About 40 bytes each.
CACHED_WORDS = 1_000_000
_NOT_SPACE = np.array([not (i == 32 or 9 <= i <= 13) for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: The printable stand-ins that byte-level vocabularies use for bytes: printable Latin-1 as it is, others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: What a tokenizer file must say for WordIds to hold: white space is dropped and never joined across, case is ignored.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
_PATTERN = regex.compile(_WORDS + "|\n")
#: Other than printable ASCII and the Latin letters and signs that stand above it, which need no normalising.
_UNUSUAL = re.compile("[^\n!-~\u00a1-\u00ac\u00ae-\u024f]")
_NORMALS = ["NFC", "Replace", "Lowercase"]


def checked(path: str) -> str:
    """path, if the file is of the kind that WordIds encodes as the tokenizer itself does; raises ValueError if not."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    before, steps = (found.get("pre_tokenizer") or {}).get("pretokenizers") or [], (found.get("normalizer") or {}).get("normalizers") or []
    level = before[1] if len(before) == 2 else {}
    words = before[:1] == [_SPLIT] and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex")
    folded = [s["type"] for s in steps] == _NORMALS and steps[1]["pattern"] == {"Regex": r"\s+"}
    added = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in found.get("added_tokens", []))
    if not (words and folded and added and found["model"]["type"] == "BPE" and not found.get("post_processor")):
        raise ValueError(f"{path}: only byte-level BPE on lower-case words without white space is supported")
    return path


class WordIds:
    """Ids of texts, word by word: each distinct word of a slice of texts is looked up or encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row (a word: a
    run of bytes that are not ASCII white space). Words are known by a 64-bit hash of their bytes in lower case; those
    that hold a special token's string, in its exact case, by one of their own bytes.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.signs = self.tokenizer.model, {}  # signs: ids of digits and of runs of signs, which words share
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(re.escape(t) for t in special)) if special else None
        self.forget()

    def forget(self) -> None:
        """An empty cache: a task's words go with the task, the vocabulary stays."""
        self.keys, self.first, self.size, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, "<u4")

    def encoded(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each followed by a line feed, and how many of them each word has.

        Latin words are lowered and split here by the tokenizer's pattern and given to its model; words with any other
        character, and those with a special token's string, to the whole tokenizer.
        """
        text = words.decode()
        odd: dict[int, list[int]] = {}
        if _UNUSUAL.search(text) or self.special and self.special.search(words):
            lines = text.split("\n")[:-1]
            for i, word in enumerate(lines):
                if _UNUSUAL.search(word) or self.special and self.special.search(word.encode()):
                    odd[i], lines[i] = self.tokenizer.encode(word, add_special_tokens=False).ids, ""
            text = "\n".join([*lines, ""])
        ids, ends, model = [], [], self.model
        for part in _PATTERN.findall(text.lower()):
            if part == "\n":
                ids += odd.get(len(ends), ())
                ends.append(len(ids))
            elif known := self.signs.get(part):
                ids += known
            else:
                new = [t.id for t in model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LEVEL))]
                ids += new
                if not part.isalpha() and len(self.signs) < 4096:
                    self.signs[part] = new
        return np.array(ids, "<u4"), np.diff(np.array(ends, np.int64), prepend=0).astype(np.int32)

    def entries(self, hashes: np.ndarray, words: Callable[[np.ndarray], bytes]) -> np.ndarray:
        """Places of distinct, ascending hashes in the cache; words gives some of them as text, a line each."""
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == hashes[at < len(self.keys)]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > self.most:
                kept = at[known]
                size = self.size[kept]
                self.flat = self.flat[gathered(self.first[kept], size)]
                self.keys, self.size, self.first = self.keys[kept], size, np.cumsum(size, dtype=np.int64) - size
            ids, size = self.encoded(words(new))
            place = np.searchsorted(self.keys, hashes[new])
            first = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, ids])
            self.keys, self.first, self.size = (np.insert(old, place, x) for old, x in ((self.keys, hashes[new]), (self.first, first), (self.size, size)))
        return np.searchsorted(self.keys, hashes)

    def of(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice in a row, each text's followed by end, and where each text's ids end."""
        count, raw = len(offsets) - 1, data.tobytes()
        starts, ends, rows = wordhash.spans(data, offsets, _NOT_SPACE)
        hashes = wordhash.span_hashes(data, starts, ends, _LOWER)
        if self.special and len(starts) and (hits := [m.start() for m in self.special.finditer(raw)]):
            held = np.unique(np.searchsorted(starts, hits, "right") - 1)
            held = held[[self.special.search(raw, s, e) is not None for s, e in zip(starts[held].tolist(), ends[held].tolist(), strict=True)]]
            hashes[held] = wordhash.mix(wordhash.span_hashes(data, starts[held], ends[held]) ^ np.uint64(0x5EC1))
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)

        def words(new: np.ndarray) -> bytes:
            first, size = starts[at[new]], ends[at[new]] - starts[at[new]] + 1
            lines = np.append(data, np.uint8(10))[np.minimum(gathered(first, size), len(data))]
            lines[np.cumsum(size) - 1] = 10
            return lines.tobytes()

        entry = self.entries(distinct, words)
        size = self.size[entry][back]
        ids = self.flat[gathered(self.first[entry][back], size)]
        many = np.bincount(rows, weights=size, minlength=count).astype(np.int64)
        if end is None:
            return ids, np.cumsum(many)
        out = np.full(len(ids) + count, end, "<u4")
        out[np.arange(len(ids)) + np.repeat(rows, size)] = ids
        return out, np.cumsum(many + 1)


def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., size[0] of them, then first[1], ..."""
    before = np.cumsum(size, dtype=np.int64) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) of every document's ids and end_id, cut only beyond capacity.

    Null texts count as empty: one piece that holds end_id.
    """
    import public_tokenizers

    path = checked(public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer)
    taken = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    id_type = taken.schema[0].dataType.simpleString()

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(path, lambda: WordIds(path))
        words.forget()
        for batch in batches:
            for row, count, data, offsets in wordhash.slices(batch.column(1)):
                ids, ends = words.of(data, offsets, end_id)
                whole = np.diff(ends, prepend=0)
                many = -(-whole // capacity)
                at = np.repeat(np.arange(count), many)
                number = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                start = number * capacity
                length = np.minimum(whole[at] - start, capacity)
                first = ends[at] - whole[at] + start
                parts = [ids[a : a + n] for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(row + at)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)
        words.forget()

    return map_texts(taken, pieces, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, keeps=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: [(times, [(length, how many of it in the sequence), ...]), ...].

    Pieces of a length go, tightest first, to the sequences with room for them. A run of equal sequences is cut in at
    most one place for each length, so there are at most three runs a length whatever the counts are.
    """
    runs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, content: list[tuple[int, int]]) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((times, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                fits = capacity // length
                full, rest = divmod(left, fits)
                if full:
                    put(capacity - fits * length, full, [(length, fits)])
                if rest:
                    put(capacity - rest * length, 1, [(length, rest)])
                break
            room = rooms[k]
            times, content = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[k]
            fits = room // length
            full, rest = min(times, left // fits), 0
            if full:
                put(room - fits * length, full, [*content, (length, fits)])
                left -= full * fits
            if full < times:
                rest = min(left, fits)
                if rest:  # fewer are left than one sequence has room for
                    put(room - rest * length, 1, [*content, (length, rest)])
                    left -= rest
                if times - full - (rest > 0):
                    put(room, times - full - (rest > 0), content)
    return [run for room in sorted(runs) for run in runs[room]]


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by rank: pieces of `length` with ranks from `rank` on take place `offset` of the sequences from `sequence` on."""
    used, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for times, content in plan(histogram, capacity):
        offset = 0
        for length, many in content:
            for _ in range(many):
                rows.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def place(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """pieces (a cut table with length) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = layout(counts, capacity)
    ranked = spread_rank(pieces, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32"), F.col("start")])
    fields = ranked.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name != "_rank") + ", sequence_id long, offset long"
    scale = 1 << 40  # above any rank: (length, rank) as one sorted number

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] * scale + table["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length * scale + rank, "right") - 1
            names = [n for n in batch.schema.names if n != "_rank"]
            out = [batch.column(n) for n in names] + [pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; rows repeated with one id are packed each; other columns are not read; an empty table
    gives an empty result. Texts are tokenised once, and only these narrow rows are shuffled.
    """
    return place(cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity, id_col)
