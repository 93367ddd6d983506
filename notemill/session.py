"""A Spark session with the settings that the queries assume."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "notemill", cores: int | str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and AQE on. A session or master that exists already is used as it is."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("MASTER") and cores is not None:
        builder = builder.master(f"local[{cores}]")
    return builder.config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the cluster's spark.checkpoint.dir; under a temporary one only where none is set on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{(given or 'file://' + tempfile.gettempdir()).rstrip('/')}/notemill-{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) as Spark's driver sees them, for names and places of files; rows never pass here."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless their Python finds it already (PYTHONPATH or the working folder)."""
    root = Path(sys.modules["notemill"].__file__).resolve().parents[1]
    found = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    context = spark.sparkContext
    if root in found or any(p.endswith("notemill-package.zip") for p in context._python_includes):
        return
    packed = os.path.join(context._temp_dir, "notemill-package.zip")  # the driver's own; Spark serves it to executors
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "notemill").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(packed)
