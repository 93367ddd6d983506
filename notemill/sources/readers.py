"""Readers with declared schemas. Paths go to Spark as they are, so any of its file systems will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill import schemas
from notemill.sources import arrays


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """With a header and doubled quotes. Without a schema types are inferred, at one more pass.

    lines: texts may hold line breaks; a file is then one task. Without them large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", lines).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records from a JSON array, one object a file, NDJSON, or an object with the array under notes.

    lines: NDJSON only, of which large files are split; else a file is one task.
    """
    wrapped = T.StructType([T.StructField("notes", T.ArrayType(schemas.RECORD)), *schemas.RECORD.fields])
    read = spark.read.option("multiLine", not lines).schema(wrapped).json(path)
    own = F.struct(*[F.col(f.name) for f in schemas.RECORD.fields])
    return schemas.filled(read.select(F.inline(F.coalesce("notes", F.array(own)))))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that are large JSON arrays, bare or under notes; each file is read by many tasks."""
    read = arrays.elements(spark, path).select(F.from_json("value", schemas.RECORD).alias("r"))
    return schemas.filled(read.where("r is not null").select("r.*"))


def events(spark: SparkSession, path: str, message: str | None = None) -> DataFrame:
    """NDJSON log lines; blank and broken ones are left out."""
    read = spark.read.schema(schemas.EVENT).option("mode", "DROPMALFORMED").json(path).where("msg is not null")
    return read.where(F.col("msg") == message) if message else read


def ndjson(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files; Spark leaves out empty ones.

    A pattern in the last part of the path chooses names of one listing of the folder. As a pattern of paths each file
    would be a path of its own, to be looked up and listed again.
    """
    folder, _, name = path.rpartition("/")
    one = folder and re.search(r"[*?\[{]", name) and not re.search(r"[*?\[{]", folder)
    read = spark.read.option("pathGlobFilter", name).text(folder, wholetext=True) if one else spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def named_parts(files: DataFrame, pattern: str = r"^[a-z]+_(.+)_([A-Z0-9.]+)_(\d+)\.txt$", parts: tuple[str, ...] = ("target", "code", "id"), default: str = "unknown") -> DataFrame:
    """Columns from groups of the file's name; the default where it does not match."""
    hit = F.col("name").rlike(pattern)
    return files.withColumns({p: F.when(hit, F.regexp_extract("name", pattern, i)).otherwise(default) for i, p in enumerate(parts, 1)})


def annotated_xml(spark: SparkSession, path: str, row: str = "annotation") -> DataFrame:
    """One row an annotation of an annotated corpus."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def unpacked(archive: str, folder: str) -> list[str]:
    """Extracts a zip (Spark reads gz as it is) to a folder on a file system that the driver and the executors share.

    The archive stays. Only for preparing inputs; entries that would leave the folder are refused.
    """
    import zipfile
    from pathlib import Path

    top = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if top not in (top / name).resolve().parents and (top / name).resolve() != top:
                raise ValueError(f"{name} leaves {folder}")
        z.extractall(top)
        return sorted(str(top / n) for n in z.namelist() if not n.endswith("/"))
