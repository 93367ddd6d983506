"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors have cosine >= c exactly if their squared distance is at most 2 - 2c. After a rotation to principal axes the
dimensions are dealt into blocks, and each block gets the part of that budget that is in proportion to its variance. A
pair within the whole budget is within the budget of at least one block, so the union of the blocks' range joins holds
every link; candidates are then verified on the whole vectors in double precision.

A block's range join is by cells: every vector lives in the cell of its nearest pivot and is a guest in the cells whose
border is within the block's radius. Two vectors within the radius meet in the cell of the one with the lower cell number,
and only there. How many pivots a block gets follows from what they save on a sample: where vectors have no structure
that cells could use, a block is one cell. Large cells are cut into chunks of bounded size, so a task's size depends on
no group's. Equal vectors are one vector with a weight. A task looks at its pairs tile by tile and returns a count for
each vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import components, copied, cut, let_go, named, numbered, salted, salted_join

#: What double precision may add to a block's squared distance, and single precision (per dimension) to a candidate's.
TIGHT, SINGLE = 1e-9, 2.5e-7
#: Of a chunk: rows, and bytes in single precision.
CHUNK_ROWS, CHUNK_BYTES = 65536, 16 << 20
#: A comparison of two vectors in a block costs about this share of sending one to a task.
COMPARED = 1e-3
#: Vectors that stand in very many rows are dealt out: at most so many are broadcast for it.
HOT_VECTORS = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length 1. Their largest component comes to 1 first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of p, in slices."""
    out = np.empty((len(x), len(p)))
    step = max(1, (1 << 22) // max(1, p.size))
    for s in range(0, len(x), step):
        out[s : s + step] = ((x[s : s + step, None] - p[None]) ** 2).sum(2)
    return out


class Plan:
    """Rotation, blocks, budgets and pivots, fitted to a bounded sample. Any sample gives the same links."""

    def __init__(self, sample: np.ndarray, cosine: float, blocks: int, most_pivots: int, rows: int, seed: int = 5):
        dim = sample.shape[1]
        blocks = max(1, min(blocks, dim))
        values, axes = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(dim, dim) + 1e-12 * np.eye(dim))
        values, axes = np.maximum(values[::-1], 1e-12), axes[:, ::-1]
        turn = np.arange(dim) % (2 * blocks)
        block = np.where(turn < blocks, turn, 2 * blocks - 1 - turn)  # there and back, for blocks of like variance
        self.axes = [np.ascontiguousarray(axes[:, block == b]) for b in range(blocks)]
        energy = np.array([values[block == b].sum() for b in range(blocks)])
        self.budget = (2 - 2 * cosine) * energy / energy.sum()
        self.cosine = cosine
        self.radius = np.sqrt(self.budget + TIGHT) + TIGHT
        rng = np.random.default_rng(seed)
        self.pivots = []
        for b in range(blocks):
            y = sample @ self.axes[b]
            tried, many = [], 1
            while many <= min(most_pivots, max(1, len(y) // 8)):
                p = self._centres(y, many, rng)
                home, guest = self._cells(y, p, self.radius[b])
                homes, guests = np.bincount(home, minlength=len(p)) / len(y), guest.sum(0) / len(y)
                pairs = rows * float((homes * (homes / 2 + guests)).sum())  # of a row, on average
                tried.append((COMPARED * pairs + 1 + float(guests.sum()), many, p))
                many *= 2
            self.pivots.append(min(tried, key=lambda t: t[:2])[2])

    @staticmethod
    def _centres(y: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
        p = y[rng.permutation(len(y))[:many]]
        for _ in range(3):
            near = distances(y, p).argmin(1)
            p = np.array([y[near == k].mean(0) if (near == k).any() else p[k] for k in range(len(p))])
        return np.unique(p.round(3), axis=0)  # no two so near each other that their border is uncertain

    @staticmethod
    def _cells(y: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Home cell of each row, and whether it is a guest in each cell of a lower number."""
        d = distances(y, p)
        home = d.argmin(1)
        apart = np.sqrt(distances(p, p))[home]
        border = (d - d[np.arange(len(d)), home][:, None]) / np.maximum(2 * apart, 1e-12)
        return home, (border <= radius) & (np.arange(len(p))[None] < home[:, None])

    def cells(self, units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._cells(units @ axes, p, r) for axes, p, r in zip(self.axes, self.pivots, self.radius, strict=True)]

    def links(self, block: int, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of linked pairs of unit vectors that no block before this one has found, tile by tile."""
        axes = self.axes[block]
        x, y = ((u @ axes).astype(np.float32) for u in (left, right))
        one = lambda v: np.ones((len(v), 1), np.float32)
        half = lambda v: -(v * v).sum(1, keepdims=True) / 2
        least = -(self.budget[block] + 1e-5 + SINGLE * axes.shape[1]) / 2
        x, y = np.hstack([x, half(x), one(x)]), np.hstack([y, one(y), half(y)])
        for i in range(0, len(x), 512):
            for j in range(i // 2048 * 2048 if same else 0, len(y), 2048):
                a, b = np.nonzero(x[i : i + 512] @ y[j : j + 2048].T >= least)
                a, b = a + i, b + j
                if same:
                    a, b = a[a < b], b[a < b]
                for s in range(0, len(a), 65536):
                    p, q = a[s : s + 65536], b[s : s + 65536]
                    ok = (left[p] * right[q]).sum(1) >= self.cosine
                    p, q = p[ok], q[ok]
                    if not len(p):
                        continue
                    gap = left[p] - right[q]
                    near = [((gap @ self.axes[k]) ** 2).sum(1) <= self.budget[k] + TIGHT for k in range(block + 1)]
                    first = near[block] & ~np.any(near[:block], axis=0) if block else near[0]
                    yield p[first], q[first]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (of each position, the lowest one linked with it) after more links (a, b)."""
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, blocks: int = 4, sample_rows: int = 4096, most_pivots: int = 512, chunk_rows: int = CHUNK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Every row is a vector of its own: n_links counts the other rows linked with it, equal ones and rows of the same id
    included, and rows with one id but different vectors are in one component only if links lead from one to the other.
    Rows without an id link like all others; component_id is the smallest id of the component, null if none of its rows
    has one, and kept says that the two are the same (null and null as well). Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, others with those of their own length, each length in a join of its
    own; components may be of any finite size. Ids are of any type with an order. Other columns are not read. An empty
    table gives an empty result.

    What the blocks must compare depends on the data: for vectors without any structure a block's radius is near its
    spread, all cells border on each other, and the work is all pairs, in chunks.
    """
    found, names = numbered(vectors.select(F.col(id_col), F.col(vector_col).alias("_value")), id_col)
    value = F.col("_value")
    plain = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(value.isNotNull() & plain & F.exists(value, lambda x: x != 0), F.lit(False))
    taken = cut(found.where(usable).select(id_col, "_id", value.cast("array<double>").alias("_v")))
    equal = cut(taken.groupBy("_v").agg(F.min("_id").alias("_rep"), F.count("*").alias("_many")).withColumn("_row", F.monotonically_increasing_id()))
    sizes = equal.groupBy(F.size("_v").alias("dim")).agg(F.count("*").alias("count"), F.sum("_many").alias("rows")).orderBy("dim").collect()  # one row a length
    links = taken.sparkSession.createDataFrame([], "_row long, links long, a long, b long")
    for r in sizes:
        if r["count"] > 1:
            links = links.unionByName(_links(equal.where(F.size("_v") == r["dim"]), r["dim"], r["count"], cosine, blocks, sample_rows, most_pivots, chunk_rows))
    others = cut(links.groupBy(F.col("_row").alias("id")).agg(F.sum("links").alias("others")))
    joined = cut(components(others, links.select("a", "b")).join(equal.select(F.col("_row").alias("id"), "_rep"), "id"))
    least = joined.groupBy("component").agg(F.min("_rep").alias("component_id"))
    known = salted_join(joined.drop("_rep"), least, "component").join(others, "id").withColumnRenamed("id", "_row").drop("component")
    n = (F.coalesce("others", F.lit(0).cast("long")) + F.col("_many") - 1).alias("n_links")
    each = cut(equal.join(known, "_row", "left").select("_v", n, F.when(F.col("others").isNull(), F.col("_rep")).otherwise(F.col("component_id")).alias("component_id")))
    per_salt = max(512, -(-sum(r["rows"] for r in sizes) // HOT_VECTORS))
    hot = F.broadcast(cut(equal.where(F.col("_many") > per_salt).select("_v", F.ceil(F.col("_many") / per_salt).cast("int").alias("_salts"))))
    linking = salted(taken, "_v", hot).join(copied(each, "_v", hot), ["_v", "_salt"]).select(id_col, "_id", "n_links", "component_id")
    alone = found.where(~usable).select(id_col, "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = linking.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("_id")))
    return named(out, ["component_id"], names).select(id_col, "n_links", "component_id", "kept")


def _links(equal: DataFrame, dim: int, count: int, cosine: float, blocks: int, sample_rows: int, most_pivots: int, chunk_rows: int) -> DataFrame:
    """(_row, links, a, b) by task: how many rows it found linked with a distinct vector a (_row again), and a vector b these links lead to."""
    sample = equal.orderBy(F.xxhash64("_v"), "_row").limit(sample_rows).select("_v").collect()  # sample_rows vectors at most
    plan = Plan(unit(np.array([r["_v"] for r in sample], np.float64)), cosine, min(blocks, dim), most_pivots, count)
    chunk_rows = max(2, min(chunk_rows, CHUNK_BYTES // (4 * dim)))

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                at, block, cell, guest = [], [], [], []
                for b, (home, guests) in enumerate(plan.cells(unit(_matrix(batch.column("_v"), dim)))):
                    rows, cells = np.nonzero(guests)
                    at += [np.arange(len(home)), rows]
                    block += [np.full(len(home) + len(rows), b)]
                    cell += [home, cells]
                    guest += [np.zeros(len(home), bool), np.ones(len(rows), bool)]
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(at), pa.array(np.concatenate(block), pa.int32()), pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(guest))], ["_row", "block", "cell", "guest"])

    cells = cut(equal.select("_row", "_v").mapInArrow(celled, "_row long, block int, cell int, guest boolean"))
    chunks = lambda flag: F.ceil(F.count_if(flag) / chunk_rows).cast("int")
    counts = cut(cells.groupBy("block", "cell").agg(chunks(~F.col("guest")).alias("homes"), chunks(F.col("guest")).alias("others")).where("homes > 0"))
    dealt = cells.join(F.broadcast(counts), ["block", "cell"])  # blocks x most_pivots rows at most
    chunk = F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("_row"), F.greatest(F.col("others"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("_row"), F.col("homes"))).cast("int")
    dealt = dealt.withColumn("chunk", chunk)
    last = F.col("homes") + F.col("others") - 1
    meets = F.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: F.struct(h.alias("h"), F.col("chunk").alias("c")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("chunk")), lambda h: F.struct(h.alias("h"), F.col("chunk").alias("c"))),
            F.when(F.col("chunk") < last, F.transform(F.sequence(F.col("chunk") + 1, last), lambda c: F.struct(F.col("chunk").alias("h"), c.alias("c")))).otherwise(F.array().cast("array<struct<h:int,c:int>>")),
        )
    )
    tasks = dealt.select("_row", "block", "cell", "chunk", F.explode(meets).alias("m")).select("_row", "block", "cell", "chunk", "m.h", "m.c")
    rows = tasks.join(equal.select("_row", "_many", F.col("_v").cast("array<float>").alias("_v") if _single(equal) else "_v"), "_row")

    def compared(table: pa.Table) -> pa.Table:
        let_go()
        block, h, c = (table.column(n)[0].as_py() for n in ("block", "h", "c"))
        table = table.sort_by("_row")  # whatever order the rows came in
        chunk, weight, row = (table.column(n).to_numpy() for n in ("chunk", "_many", "_row"))
        units = unit(_matrix(table.column("_v"), dim))
        left, right = np.flatnonzero(chunk == h), np.flatnonzero(chunk == c)
        many, label = np.zeros(len(row), np.int64), np.arange(len(row))
        for a, b in plan.links(block, units[left], units[right], h == c):
            a, b = left[a], right[b]
            many += (np.bincount(a, weights=weight[b], minlength=len(row)) + np.bincount(b, weights=weight[a], minlength=len(row))).astype(np.int64)
            label = merged(label, a, b)
        some = np.flatnonzero(many)
        return pa.table({"_row": row[some], "links": many[some], "a": row[some], "b": row[label][some]}, schema=pa.schema([(n, pa.int64()) for n in ("_row", "links", "a", "b")]))

    return cut(rows.groupBy("block", "cell", "h", "c").applyInArrow(compared, "_row long, links long, a long, b long"))


def _single(equal: DataFrame) -> bool:
    """Whether every component is a single-precision number, so that half the bytes carry it."""
    return equal.where(F.exists("_v", lambda x: x.cast("float").cast("double") != x)).limit(1).count() == 0
