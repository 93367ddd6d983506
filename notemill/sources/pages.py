"""One named file for each row: a data source that Spark's tasks write with, and read with where files are in folders.

Names are the rows' own, so a task that runs again writes the same files anew. Each task also writes its part of the
index; when all have ended, the driver writes the page that links these parts, and `_SUCCESS` last. Files go where Arrow's
file systems reach (local and mounted folders, and those that the URI names and Arrow is built with).

Spark's own readers keep the state of every file in the driver. Files in folders of bounded size are listed by the tasks
that read them instead, and the driver sees no more than the folders' names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_NAME = re.compile(r"[^/\\\x00]+")
_FOLDER, _INDEX = re.compile(r"pages-\d{6,}-\d{6,}"), re.compile(r"index-\d{6,}\.html")
#: Bytes of a batch of texts that a task hands on, and parts of the index that a task reads.
BATCH, INDEX_PARTS = 4 << 20, 64


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)


def _put(path: str, name: str, content: str, at: tuple | None = None) -> None:
    system, folder = at or _file_system(path)
    with system.open_output_stream(f"{folder}/{name}") as out:
        out.write(content.encode())


def page(title: str, items: list[tuple[str, str]], more: str = "") -> str:
    """A page of links (file, text)."""
    listed = "".join(f'<li><a href="{html.escape(file)}">{html.escape(text)}</a></li>' for file, text in items)
    return f"<html><body><h1>{html.escape(title)}</h1>{more}<ul>{listed}</ul></body></html>"


@dataclass
class Part(WriterCommitMessage):
    index: str
    files: int


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.title, self.hint = options["path"], options.get("title", "Pages"), options.get("instructions", "")
        self.per_folder = int(options.get("perfolder", 0))

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        items, at, part, below = [], _file_system(self.path), TaskContext.get().partitionId(), ""  # looked up once a task
        for i, r in enumerate(rows):
            if not r["name"] or not _NAME.fullmatch(r["name"]) or r["name"].startswith(("index", "_", ".")):
                raise ValueError(f"{r['name']!r} can't be a page's file name")
            if self.per_folder and i % self.per_folder == 0:  # rows come in order of title and name, so again in the same folder
                below = f"pages-{part:06d}-{i // self.per_folder:06d}/"
                at[0].create_dir(f"{at[1]}/{below}")
            _put(self.path, below + r["name"], r["content"] or "", at)
            items.append((below + r["name"], r["title"] if r["title"] is not None else r["name"]))
        name = f"index-{part:06d}.html"
        if items:
            _put(self.path, name, page(self.title, items))  # of one task's pages, in their order
        return Part(name, len(items))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None and m.files]
        many = sum(m.files for m in parts)
        hint = f"<p>{html.escape(self.hint)}</p>" if self.hint else ""
        _put(self.path, "index.html", page(self.title, [(m.index, f"{m.index} ({m.files})") for m in parts], f"<p>{many} pages</p>{hint}"))
        _put(self.path, "_SUCCESS", "")

    def abort(self, messages: list[Part | None]) -> None:
        """What is written stays without `_SUCCESS`; the next run writes the same names."""


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.index = options["path"], options.get("index") == "true"

    def partitions(self) -> list[InputPartition]:
        """A folder of pages each, or some parts of the index."""
        from pyarrow import fs

        system, folder = _file_system(self.path)
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(folder)))
        if self.index:
            parts = [n for n in names if _INDEX.fullmatch(n)]
            return [InputPartition(parts[i : i + INDEX_PARTS]) for i in range(0, len(parts), INDEX_PARTS)] or [InputPartition([])]
        if apart := [n for n in names if not n.startswith(("index", "_", ".")) and not _FOLDER.fullmatch(n)]:
            raise ValueError(f"{apart[0]!r} of {self.path} is in no folder of pages")
        return [InputPartition([n]) for n in names if _FOLDER.fullmatch(n)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        def batch():
            return pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["name", "text"])

        system, folder = _file_system(self.path)
        of = (lambda n: [f"{folder}/{n}"]) if self.index else (lambda n: fs.FileSelector(f"{folder}/{n}"))
        names, texts, size = [], [], 0
        for given in partition.value:
            for x in sorted(system.get_file_info(of(given)), key=lambda x: x.base_name):
                if x.size == 0:
                    continue
                with system.open_input_stream(x.path) as f:
                    names.append(x.base_name)
                    texts.append(f.read())
                size += len(texts[-1])
                if size >= BATCH:
                    yield batch()
                    names, texts, size = [], [], 0
        if names:
            yield batch()


class PageFiles(DataSource):
    """Format `pages`, for writing name, title and content and for reading name and text."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {"name", "title", "content"} - set(schema.names):
            raise ValueError("pages have name, title and content")
        return PageWriter(dict(self.options))


def write(rows: DataFrame, path: str, name: str, title: str, content: str, heading: str = "Pages", instructions: str = "", pages_per_part: int = 10_000, per_folder: int = 0) -> None:
    """A file for each row under path, named by the column name, and an index of them by title.

    path must be new. The index has a part for some pages_per_part pages, in ranges of the title, and a first page that
    links the parts. Names must be file names that no other row has and that do not begin with index, _ or a dot.
    per_folder: at most so many files a folder, for read(); 0 puts all files in path itself.
    """
    spark = rows.sparkSession
    system, folder = _file_system(path)
    if system.get_file_info(folder).type.name != "NotFound":
        raise ValueError(f"{path} is there already")
    made = rows.select(F.col(name).cast("string").alias("name"), F.col(title).cast("string").alias("title"), F.col(content).cast("string").alias("content"))
    if twice := made.groupBy("name").count().where("count > 1 or name is null").limit(3).collect():
        raise ValueError(f"no name or one of several rows: {[r['name'] for r in twice]}")
    system.create_dir(folder)
    spark.dataSource.register(PageFiles)
    parts = max(1, -(-made.count() // pages_per_part))
    ranged = made.repartitionByRange(parts, "title", "name").sortWithinPartitions("title", "name")
    ranged.write.format("pages").mode("append").options(title=heading, instructions=instructions, perfolder=per_folder).save(path)


def read(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """(name, text) of the files that write() put into folders under path, or of the parts of their index, without empty ones.

    The folders are listed, not the index, by a task each.
    """
    spark.dataSource.register(PageFiles)
    return spark.read.format("pages").option("index", index).load(path)
