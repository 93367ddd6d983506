"""Stages that run in parts and go on where they broke off: files as a stream, a folder for each part, a ledger of parts.

The stream's checkpoint knows which files are done, so each file is read once in all. A part is written to the folder of
its number; if a run ends between the write and the checkpoint's commit, the next one writes the same part anew from the
same files, so no row is there twice or missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema: T.StructType | str, per_part: int = 100, form: str = "parquet") -> DataFrame:
    """The files of a folder as a stream, at most per_part of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_part).format(form).load(path)


def run(stream: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Runs the stream's parts that are not done, stage(part) each, and ends.

    Results are under path/rows (see results()), the ledger under path/ledger and the stream's checkpoint under
    path/checkpoint. mode: update for stateful streams, whose later rows of a key replace earlier ones (see latest()).
    An error of a part ends the run; what was done before it stays.
    """

    def put(part: DataFrame, number: int) -> None:
        rows = f"{path}/rows/part={number}"
        (stage(part) if stage else part).write.mode("overwrite").parquet(rows)
        session = part.sparkSession
        session.read.parquet(rows).agg(F.count("*").alias("n")).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/ledger/part={number}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """All parts' rows, with part."""
    return spark.read.parquet(f"{path}/rows")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(part, n, at): the parts that were written, their rows and when."""
    return spark.read.parquet(f"{path}/ledger")


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Of the rows of a key the one with the greatest version."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_last"))
    return one.select(*keys, "_last.*")
