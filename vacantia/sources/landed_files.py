"""A Python data source for landed JSON files: lists are decoded element by element, bad files reported."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vacantia.schema import LANDED

NAME = "landed_files"
CHUNK = 1 << 20


class Elements:
    """The elements of a JSON text's root list, or its root object, as texts; read in pieces.

    Only the element that is being decoded is held. A root that is neither list nor object has no
    elements; a text that is no JSON, has something after its root or is cut short raises.
    """

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.ended = pieces, "", 0, False
        self.decoder = json.JSONDecoder()

    def _more(self) -> None:
        piece = next(self.pieces, None)
        if piece is None:
            self.ended = True
        else:
            self.text, self.at = self.text[self.at :] + piece, 0

    def _sign(self) -> str:
        """The next sign that is no white space, or "" at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\n\r":
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._more()

    def _value(self) -> tuple[object, str]:
        """The next value and its text; a value at the end of what was read may go on, so more is read first."""
        self._sign()
        wanted = 0
        while True:
            if self.ended or len(self.text) - self.at >= wanted:
                try:
                    value, end = self.decoder.raw_decode(self.text, self.at)
                    if end < len(self.text) or self.ended:
                        text, self.at = self.text[self.at : end], end
                        return value, text
                except json.JSONDecodeError:
                    if self.ended:
                        raise
                wanted = 2 * (len(self.text) - self.at)  # tried anew when twice as much is there
            self._more()

    def __iter__(self) -> Iterator[str]:
        if self._sign() == "[":
            self.at += 1
            if self._sign() == "]":
                self.at += 1
            else:
                while True:
                    yield self._value()[1]
                    sign = self._sign()
                    self.at += 1
                    if sign == "]":
                        break
                    if sign != ",":
                        raise ValueError(f"{sign or 'the end'} after an element")
        else:
            value, text = self._value()
            if isinstance(value, dict):
                yield text
        if self._sign():
            raise ValueError("text after the root")


@dataclass
class Files(InputPartition):
    paths: list[str]


class LandedReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, bytes_per_task: int):
        self.path, self.pattern, self.bytes_per_task = path, pattern, bytes_per_task

    def _store(self):
        from urllib.parse import unquote, urlsplit

        from pyarrow import fs

        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), unquote(urlsplit(self.path).path)
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        """Files by path, as many a task as fit into ``bytes_per_task``."""
        from fnmatch import fnmatchcase

        from pyarrow import fs

        store, root = self._store()
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((f.path, f.size or 0) for f in listed if f.type == fs.FileType.File and fnmatchcase(f.base_name, self.pattern))
        groups, held = [], 0
        for path, size in found:
            if not groups or held + size > self.bytes_per_task:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def _elements(self, path: str) -> Iterator[str]:
        store, _ = self._store()
        decode = codecs.getincrementaldecoder("utf-8")()

        def pieces() -> Iterator[str]:
            with store.open_input_stream(path) as stream:
                while data := stream.read(CHUNK):
                    yield decode.decode(data)
                yield decode.decode(b"", final=True)

        yield from Elements(pieces())

    def read(self, partition: Files) -> Iterator[tuple]:
        """A file is read twice: first to its end, as one that fails there has to be left out whole."""
        for path in partition.paths:
            try:
                for _ in self._elements(path):
                    pass
            except ValueError as error:  # also what the decoders raise
                yield (path, None, None, f"{type(error).__name__}: {error}"[:500])
                continue
            for i, text in enumerate(self._elements(path)):
                yield (path, i, text, None)


class LandedFiles(DataSource):
    """format("landed_files"): rows (src_file, src_pos, value, problem) of all files below ``path`` named like ``pattern``.

    ``value`` is the text of a list's element or of a single object; a file that does not parse
    has one row with its ``problem`` instead. A missing directory has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "src_file string, src_pos long, value string, problem string"

    def reader(self, schema: T.StructType) -> LandedReader:
        return LandedReader(self.options["path"], self.options.get("pattern", "jobs_*.json"), int(self.options.get("bytesPerTask", 64 << 20)))


def scan(spark: SparkSession, directory: str, pattern: str = "jobs_*.json", bytes_per_task: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(LandedFiles)
    return spark.read.format(NAME).option("pattern", pattern).option("bytesPerTask", bytes_per_task).load(directory)


def postings(scanned: DataFrame, schema: T.StructType = LANDED) -> DataFrame:
    """Postings of a scan, with the position of each; elements that are no objects are left out."""
    rows = scanned.filter("value IS NOT NULL AND substr(value, 1, 1) = '{'")
    return rows.select(F.from_json("value", schema).alias("j"), "src_file", "src_pos").select("j.*", "src_file", "src_pos")


def problems(scanned: DataFrame) -> DataFrame:
    """(src_file, problem) of the files left out."""
    return scanned.filter("problem IS NOT NULL").select("src_file", "problem")
