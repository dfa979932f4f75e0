"""Book files as a data source: spark.read.format("books") and spark.readStream.format("books").

Options: path (a folder, or a URI that pyarrow's file systems open; subfolders count), partitionBytes (how many bytes of files make a partition, 32 MB unless given; a file is never cut). A row is a document: a text file is one, an EPUB
file has one for each document of its reading order without covers, contents pages and empty ones. A given schema names the columns that are wanted; files aren't opened where only columns of the listing are asked for. Conditions on
path and kind choose files before any is opened.

A stream's offset is the time of the newest file that has been read, in nanoseconds; files must not get an older time than what has been read, as uploads don't. Files that can't be opened as what their name says are a row with a null text.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from inkloom.sources.books import decoded, epub_documents

SCHEMA = "path string, kind string, size bigint, modified timestamp, place int, doc string, title string, text string"
LISTED = ("path", "kind", "size", "modified")
KINDS = ("txt", "epub")
PARTITION_BYTES = 32 << 20


class File(NamedTuple):
    path: str
    kind: str
    size: int
    time: int


class Part(InputPartition):
    def __init__(self, files: list[File]) -> None:
        super().__init__(None)
        self.files = files


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[File]:
    """The book files under a path, by path."""
    files, base = opened(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    rows = [(f.path, f.extension.lower(), f.size, f.mtime_ns or 0) for f in found if f.type == pyarrow.fs.FileType.File]
    return sorted(File(*r) for r in rows if r[1] in KINDS)


def packed(files: list[File], most: int) -> list[Part]:
    """Files in partitions of about `most` bytes, the largest first and each to the lightest partition."""
    parts: list[list[File]] = [[] for _ in range(min(len(files), max(1, -(-sum(f.size for f in files) // most))))] if files else []
    weights = [0] * len(parts)
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        at = weights.index(min(weights))
        parts[at].append(f)
        weights[at] += f.size + 1
    return [Part(p) for p in parts if p]


def is_content(doc: str, properties: str, text: str) -> bool:
    """Whether an EPUB document is neither empty, a contents page nor a bare cover."""
    name, body = doc.lower(), text.strip()
    last = name.rpartition("/")[2]
    return not (not body or "nav" in properties or last.startswith(("nav", "toc")) or ("cover" in name and len(body) <= 32) or body.lower() == "cover")


def documents(path: str, file: File) -> Iterator[tuple[int, str, str, str | None]]:
    """(place, doc, title, text) of a file."""
    files, _ = opened(path)
    with files.open_input_stream(file.path) as stream:
        data = stream.read()
    if file.kind == "txt":
        yield 0, "", "", decoded(data)
        return
    try:
        for place, doc, properties, text, title in epub_documents(data):
            if is_content(doc, properties, text):
                yield place, doc, title, text
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
        yield 0, "", "", None


class _Reading:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        if "path" not in options:
            raise ValueError("the option path is missing")
        self.path, self.columns = options["path"], schema.names
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime

        deep = any(c not in LISTED for c in self.columns)
        for f in partition.files:
            time = datetime.datetime.fromtimestamp(f.time / 1e9, datetime.UTC)
            for place, doc, title, text in documents(self.path, f) if deep else ((None, None, None, None),):
                row = {"path": f.path, "kind": f.kind, "size": f.size, "modified": time, "place": place, "doc": doc, "title": title, "text": text}
                yield tuple(row[c] for c in self.columns)


class BatchReader(_Reading, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("kind",)):
                self.wanted.append(f)
            else:
                yield f

    def _chosen(self, file: File) -> bool:
        tests = {EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x)}
        return all(tests[type(f)](getattr(file, f.attribute[0]), f.value) for f in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        return packed([f for f in listed(self.path) if self._chosen(f)], self.most) or [Part([])]


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"upto": max((f.time for f in listed(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return packed([f for f in listed(self.path) if start["upto"] < f.time <= end["upto"]], self.most)


class BookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format "books" known to a session, and lets Spark hand it conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BookSource)
