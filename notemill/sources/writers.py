"""Writers. Raw text columns are refused unless they are allowed by name of the argument."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.text import escape_html
from notemill.session import hadoop_path

RAW = ("text", "texto")


def _safe(df: DataFrame, allow_text: bool) -> DataFrame:
    raw = [c for c in df.columns if c.lower() in RAW]
    if raw and not allow_text:
        raise ValueError(f"raw text in {', '.join(raw)}: drop it or pass allow_text=True")
    return df


def parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = (), allow_text: bool = False) -> None:
    writer = _safe(df, allow_text).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists", allow_text: bool = False) -> None:
    """Columns beyond those given are left out."""
    _safe(df.select(*columns) if columns else df, allow_text).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def ndjson(df: DataFrame, path: str, mode: str = "errorifexists", allow_text: bool = False) -> None:
    _safe(df, allow_text).write.mode(mode).json(path)


def json_array(df: DataFrame, path: str, rows: int = 100_000, allow_text: bool = False) -> None:
    """One file with a JSON array, as other tools read it; df must be an export of at most `rows` rows."""
    safe = _safe(df, allow_text)
    if safe.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows: write NDJSON")
    listed = F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), ",\n")
    safe.agg(F.concat(F.lit("[\n"), listed, F.lit("\n]")).alias("value")).coalesce(1).write.text(path)


def json_arrays(df: DataFrame, path: str, under: str | None = None, allow_text: bool = False) -> None:
    """A folder of files, each a JSON array of a partition's rows, or an object that holds it under a name.

    Tasks write as they read, so nothing is gathered; non-ASCII letters stay. Partitions without rows give empty arrays.
    """
    opening, closing = ("[", "]") if under is None else ("{" + json.dumps(under) + ": [", "]}")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            ahead = [","] * len(batch)
            if first and ahead:
                ahead[0], first = opening, False
            yield pd.DataFrame({"value": [a + v for a, v in zip(ahead, batch["value"], strict=True)]})
        yield pd.DataFrame({"value": [(opening if first else "") + closing]})

    _safe(df, allow_text).select(F.to_json(F.struct("*")).alias("value")).mapInPandas(lines, "value string").write.text(path)


def csv_to_parquet(spark: SparkSession, pairs: dict[str, str], schema: str | None = None) -> None:
    """Each CSV (key) as Parquet (value); what exists already is left alone."""
    from notemill.sources.readers import csv as read_csv

    for source, target in pairs.items():
        read_csv(spark, source, schema).write.mode("ignore").parquet(target)


def in_batches(df: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], key: str, batches: int = 10, allow_text: bool = False) -> None:
    """stage(df) appended in parts by hash of the key: a run that breaks off leaves whole parts, and a second run does the others."""
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")
    folder, fs = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    done = {int(n.split("=")[1]) for n in names if n.startswith("part=")}
    for p in range(batches):
        if p not in done:
            _safe(stage(df.where(part == p)), allow_text).withColumn("part", F.lit(p)).write.mode("append").partitionBy("part").parquet(path)


def html_pages(df: DataFrame, title: str, fields: Sequence[str]) -> DataFrame:
    """df with `html`, a page a row, all values escaped."""
    rows = [F.concat(F.lit(f"<h2>{f}</h2><p>"), escape_html(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit("</p>")) for f in fields]
    return df.withColumn("html", F.concat(F.lit("<html><body><h1>"), escape_html(F.col(title).cast("string")), F.lit("</h1>"), *rows, F.lit("</body></html>")))


def index_page(df: DataFrame, title: str, link: str, heading: str, rows: int = 100_000) -> DataFrame:
    """One row, `html`: a page of links to at most `rows` pages, by title; index_pieces() gives one of any length."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} pages: make an index for each part")
    item = F.concat(F.lit('<li><a href="'), escape_html(F.col(link).cast("string")), F.lit('">'), escape_html(F.col(title).cast("string")), F.lit("</a></li>"))
    items = F.array_sort(F.collect_list(F.struct(F.col(title).cast("string").alias("t"), item.alias("i"))))
    return df.agg(F.concat(F.lit(f"<html><body><h1>{heading}</h1><ul>"), F.array_join(F.transform(items, lambda x: x["i"]), ""), F.lit("</ul></body></html>")).alias("html"))


def index_pieces(df: DataFrame, title: str, link: str, heading: str, size: int = 1_000_000) -> DataFrame:
    """(part, n, piece): the page that index_page() gives, however many pages it links, in pieces of some `size` characters.

    Each range of titles is put together by a task of its own; the page is the pieces in order of part and n.
    """
    from pyspark import TaskContext

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held, many = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for item in batch["item"]:
                held.append(item)
                many += len(item)
                if many >= size:
                    yield pd.DataFrame({"part": [part], "n": [n], "piece": ["".join(held)]})
                    n, held, many = n + 1, [], 0
        if held:
            yield pd.DataFrame({"part": [part], "n": [n], "piece": ["".join(held)]})

    item = F.concat(F.lit('<li><a href="'), escape_html(F.col(link).cast("string")), F.lit('">'), escape_html(F.col(title).cast("string")), F.lit("</a></li>"))
    listed = df.select(F.col(title).cast("string").alias("t"), item.alias("item")).where("item is not null").orderBy("t", "item").select("item").mapInPandas(pieces, "part long, n long, piece string")
    ends = [(-1, 0, f"<html><body><h1>{heading}</h1><ul>"), (2**62, 0, "</ul></body></html>")]
    return listed.unionByName(df.sparkSession.createDataFrame(ends, listed.schema))


def digest(pieces: DataFrame) -> DataFrame:
    """One row, `digest`: md5 of pieces (part, n, piece) in their order. It needs all bytes in order, so one task reads them, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = hashlib.md5(usedforsecurity=False)
        for batch in batches:
            for piece in batch["piece"]:
                made.update(piece.encode())
        yield pd.DataFrame({"digest": [made.hexdigest()]})

    return pieces.repartition(1).sortWithinPartitions("part", "n").mapInPandas(run, "digest string")


def stats(counts: DataFrame, path: str, seconds: float, records: int, key: str = "layer") -> None:
    """A JSON file of a run: seconds, records, and the counters and examples of each layer (key, n, examples)."""
    rows = F.array_sort(F.collect_list(F.struct(key, "n", "examples")))
    entries = lambda value: F.map_from_entries(F.transform(rows, lambda r: F.struct(r[key], r[value])))
    one = F.struct(F.lit(round(seconds, 2)).alias("duration_seconds"), F.lit(records).alias("total_records"), entries("n").alias("aggregate"), entries("examples").alias("examples"))
    counts.agg(F.to_json(one).alias("value")).coalesce(1).write.text(path)


def report(title: str, facts: Mapping[str, object], tables: Mapping[str, DataFrame], rows: int = 1000) -> str:
    """A run's report: facts (timings, counters) as a list, then each table under its heading."""
    listed = [f"- {name}: {value}" for name, value in facts.items()]
    return "\n\n".join([f"# {title}", "\n".join(listed), *[f"## {name}\n\n{markdown(df, rows)}" for name, df in tables.items()]])


def markdown(df: DataFrame, rows: int = 1000, order: Sequence[str] = ()) -> str:
    """A report table, sorted by order or else by its columns; df must be an aggregate of at most `rows` rows."""
    got = df.orderBy(*(order or df.columns)).limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows: aggregate first")
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in got]])
