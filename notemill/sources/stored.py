"""Stored tables that are updated by key: only the buckets in which a row changes are written anew.

A table is a folder: data/v<version>/bucket=<number> with the rows of a bucket as that version wrote them, and
manifests/<version>.json, which names for each bucket the version to read. A manifest is moved into place when all its
files are there, so a reader sees one version or the next, a run that breaks off leaves the table as it was, and of two
writers of the same version the second fails. Files that an update does not touch stay as they are, names included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.session import hadoop_path

#: A manifest has one entry a bucket.
MOST_BUCKETS = 100_000


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs = hadoop_path(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, key, buckets, schema, places}: places has the version that wrote each bucket that has rows."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no stored table at {path}" + (f" in version {version}" if known else ""))
    return json.loads(spark.read.text(f"{path}/manifests/{known[-1] if version is None else version}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, made: dict) -> None:
    target, fs = hadoop_path(spark, f"{path}/manifests/{made['version']}.json")
    temporary, _ = hadoop_path(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {made['version']} of {path} was written by another run")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, version: int) -> set[int]:
    """The buckets that rows (with _bucket) have, written as that version's."""
    spark = rows.sparkSession
    target = f"{path}/data/v{version}"
    rows.withColumnRenamed("_bucket", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    folder, fs = hadoop_path(spark, target)
    return {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("bucket=")}


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Stores rows, one a key, in buckets by a hash of the key."""
    spark = rows.sparkSession
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    if versions(spark, path):
        raise ValueError(f"there is a stored table at {path}")
    places = dict.fromkeys(_write(rows.withColumn("_bucket", _bucket(key, buckets)), path, 1), 1)
    _publish(spark, path, {"version": 1, "key": key, "buckets": buckets, "schema": rows.schema.json(), "places": places})


def _read(spark: SparkSession, path: str, about: Mapping, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(about["schema"]))
    folders = [f"{path}/data/v{v}/bucket={b}" for b, v in about["places"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as it is, or was in an earlier version."""
    return _read(spark, path, manifest(spark, path, version))


def upsert(changes: DataFrame, path: str, order: str | None = None, insert: bool = False) -> dict[str, int]:
    """Rows of the table replaced by changes of the same key; how many buckets were read and written, and the version.

    changes: the key and any of the other columns; columns that it has not stay. Of several changes of a key that with
    the greatest `order` counts. Keys that the table has not are left out unless insert. Only buckets with a change's key
    are read, and of these only the ones in which some row differs are written: the same changes again write nothing.
    Changes with a null key are left out.
    """
    spark = changes.sparkSession
    about = manifest(spark, path)
    key, schema = about["key"], T.StructType.fromJson(json.loads(about["schema"]))
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        changes = changes.withColumn("_n", last).where("_n = 1").drop("_n", order)
    given = [f.name for f in schema if f.name in changes.columns and f.name != key]
    new = changes.where(F.col(key).isNotNull()).select(F.col(key).cast(schema[key].dataType), *[F.col(c).cast(schema[c].dataType).alias(f"_new_{c}") for c in given], F.lit(True).alias("_hit"))
    asked = {r[0] for r in new.select(_bucket(key, about["buckets"])).distinct().collect()}  # one number a bucket at most
    touched = asked if insert else {b for b in asked if str(b) in about["places"]}
    old = _read(spark, path, about, touched).withColumn("_there", F.lit(True))
    rows = old.join(new, key, "full_outer" if insert else "left")
    hit = F.coalesce("_hit", F.lit(False))
    value = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in given}
    differs = F.col("_there").isNull()
    for c in given:
        differs = differs | (hit & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    rows = rows.withColumns({"_bucket": _bucket(key, about["buckets"]), "_differs": differs})
    changed = {r[0] for r in rows.where("_differs").select("_bucket").distinct().collect()}
    if changed:
        version = about["version"] + 1
        made = rows.where(F.col("_bucket").isin(sorted(changed))).select(*[value.get(f.name, F.col(f.name)).alias(f.name) for f in schema], "_bucket")
        written = _write(made, path, version)
        about = about | {"version": version, "places": about["places"] | {str(b): version for b in written}}
        _publish(spark, path, about)
    return {"version": about["version"], "read": len(touched), "written": len(changed)}
