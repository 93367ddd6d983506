"""What the corpus operators share: lineage cuts, checked broadcasts, two-level ranks and link components.

Nothing here collects rows of documents to the driver; what reaches it is bounded by a parameter.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.session import ship

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What this Python worker keeps from task to task: workers outlive a stage, and the next one needs their memory.
_held: dict[str, Any] = {}
#: Rows and bytes of an Arrow batch of texts, where the session has Spark's own defaults (10,000 rows of any length).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def held(name: str, make: Callable[[], Any]) -> Any:
    """make()'s value, kept in this Python worker until a task wants another or none."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Returns the memory of what earlier tasks kept or freed."""
    if _held:
        _held.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Returns freed memory to the system: the JVM beside this worker has use for it."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_texts(df: DataFrame, run: Callable[[Iterable], Iterator], schema: str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, from a worker without what earlier tasks left, unless run keeps it."""
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, ours)

    def tidy(batches: Iterable) -> Iterator:
        if not keeps:
            let_go()
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(tidy, schema)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and all runs on this machine, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="notemill-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared checkpoint folder: later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a cut table of narrow rows) with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def power_of_two(n: float, least: int, most: int) -> int:
    size = least
    while size < n and size < most:
        size *= 2
    return size


def spread_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "_rank", weight: str | None = None, bucket: Column | None = None, per_bucket: int = 1024, most_buckets: int = 65536) -> DataFrame:
    """Adds the running rank (from 0) of each row of df (a cut table) within keys, or with weight the sum of weight before it.

    Two levels, so that a key with any share of the rows is spread over tasks: a key's rows are dealt into as many
    buckets as their number asks for, buckets are summed and prefix-summed (one row a bucket), and only a bucket is
    ordered in a window. bucket: a value in [0, 65536) that is monotone in order; without it any hash of the order
    columns, which ranks rows within a key in an arbitrary but repeatable order. Keys must not be null.
    """
    if keys:
        wanted = F.least(F.lit(most_buckets), F.ceil(F.count("*") / per_bucket)).cast("int").alias("_rank_buckets")
        sized = df.join(bounded_broadcast(cut(df.groupBy(*keys).agg(wanted))), keys)
    else:
        sized = df.withColumn("_rank_buckets", F.lit(max(1, min(most_buckets, -(-df.count() // per_bucket)))))
    at = F.pmod(F.xxhash64(*order), F.col("_rank_buckets")) if bucket is None else F.floor(bucket * F.col("_rank_buckets") / 65536)
    dealt = sized.withColumn("_rank_bucket", at.cast("int")).drop("_rank_buckets")
    value = F.lit(1).cast("long") if weight is None else F.col(weight)
    sums = dealt.groupBy(*keys, "_rank_bucket").agg(F.sum(value).alias("_rank_sum"))
    before = Window.partitionBy(*keys).orderBy("_rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("_rank_before", F.coalesce(F.sum("_rank_sum").over(before), F.lit(0).cast("long"))).drop("_rank_sum"))
    inner = Window.partitionBy(*keys, "_rank_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_rank_inside", F.coalesce(F.sum(value).over(inner), F.lit(0).cast("long")))
    return inside.join(bounded_broadcast(sums), [*keys, "_rank_bucket"]).withColumn(name, F.col("_rank_before") + F.col("_rank_inside")).drop("_rank_bucket", "_rank_before", "_rank_inside")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each of sums (name, value) the sum of the value over all rows before this one in a global order.

    Rows are dealt out by ranges of the order; sums of whole ranges (one row each) and those inside a range are added.
    """
    rows = cut(df.select("*", *[v.alias(f"_run_{k}") for k, v in sums.items()]).repartitionByRange(*order).withColumn("_run_part", F.spark_partition_id()))
    ahead = Window.orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    inside = Window.partitionBy("_run_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))
    parts = rows.groupBy("_run_part").agg(*[F.sum(f"_run_{k}").alias(f"_run_{k}") for k in sums])
    parts = parts.select("_run_part", *[sofar(f"_run_{k}", ahead).alias(f"_run_before_{k}") for k in sums])
    found = rows.withColumns({f"_run_{k}": sofar(f"_run_{k}", inside) for k in sums}).join(F.broadcast(parts), "_run_part")
    return found.withColumns({k: F.col(f"_run_{k}") + F.col(f"_run_before_{k}") for k in sums}).drop("_run_part", *[f"_run_{x}{k}" for k in sums for x in ("", "before_")])


def hot_keys(df: DataFrame, key: str, per_salt: int = 512, small: int = 4096) -> DataFrame | None:
    """(key, _salts) of the keys with more than per_salt rows in df (a cut table): at most BROADCAST_ROWS rows.

    None where df has few rows in all, and none is worth dealing out.
    """
    rows = df.count()
    if rows <= small:
        return None
    salts = F.ceil(F.count("*") / max(per_salt, -(-rows // BROADCAST_ROWS))).cast("int")
    return F.broadcast(cut(df.groupBy(key).agg(salts.alias("_salts")).where("_salts > 1")))


def salted(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """df with _salt, by which a hot key's rows are dealt out."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return df.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")


def copied(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """df, which has one row a key, with a row for each _salt of the key."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    return df.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left (a cut table) joined with right, which has one row a key, however many rows of left share one."""
    hot = hot_keys(left.select(key), key)
    return salted(left, key, hot).join(copied(right, key, hot), [key, "_salt"], how).drop("_salt")


def components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each of vertices (id): component is the smallest id reachable over edges (a, b).

    Smallest-label spreading with pointer jumping: each round a vertex takes the least label among its neighbours'
    and then its label's label, so paths halve. Minima are combined before the shuffle, and where a label is read by
    very many (the edges of a hub, the members of a large component) the key is salted, so none lands in one task whole.
    Every round is written to
    the shared checkpoint folder, and all of them are removed at the end.
    """
    spark = vertices.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    edges = edges.where("a <> b").select("a", "b")
    both = _stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
    hubs = hot_keys(both, "b")
    both = _stored(salted(both, "b", hubs), f"{folder}/dealt")
    labels = _stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{folder}/0")
    for turn in range(1, most_rounds + 1):
        told = copied(labels.withColumnRenamed("id", "b"), "b", hubs)
        heard = both.join(told, ["b", "_salt"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        least = _stored(labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("next")), f"{folder}/{turn}-heard")
        # what a label's own vertex has heard: jumps over a path's middle
        jump = least.select(F.col("id").alias("next"), F.col("next").alias("jumped"))
        after = _stored(salted_join(least, jump, "next", "left").select("id", F.least("next", F.coalesce("jumped", "next")).alias("new"), F.col("label").alias("old")), f"{folder}/{turn}")
        labels = after.select("id", F.col("new").alias("label"))
        if after.where("new <> old").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("link components did not settle")
    found = cut(vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component")))
    remove(spark, folder)
    return found


def _stored(df: DataFrame, path: str) -> DataFrame:
    """df written and read back. A checkpoint keeps the estimated size, which each round's joins would multiply without bound."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """df with _id, a long that orders as id_col does and is null where it is; and the (_id, id_col) table of other than integral ids.

    Integral ids are their own numbers. Others are sorted over ranges and numbered by range and place.
    """
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn("_id", F.col(id_col).cast("long")), None
    names = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_name")).distinct()
    names = cut(names.repartitionByRange("_name").sortWithinPartitions("_name").withColumn("_id", F.monotonically_increasing_id()))
    return df.join(names, df[id_col] == names["_name"], "left").drop("_name"), names


def named(df: DataFrame, columns: list[str], names: DataFrame | None) -> DataFrame:
    """df with numbers in columns turned back into the ids that numbered() found."""
    for c in columns if names is not None else []:
        df = df.join(names.select(F.col("_id").alias(c), F.col("_name").alias(f"_{c}_name")), c, "left").withColumn(c, F.col(f"_{c}_name")).drop(f"_{c}_name")
    return df
