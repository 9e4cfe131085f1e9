"""Members of archives as a data source: members are listed from the directory or the headers and read in ranges, each a partition of its own."""

from __future__ import annotations

import glob
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from io import BufferedReader

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairloom.runtime import importable

#: Bytes of a range, and of a row's content at most.
RANGE, CHUNK = 64 << 20, 4 << 20
SCHEMA = "path string, member string, size long, offset long, content binary, error string"


@dataclass
class Part(InputPartition):
    """Bytes ``begin`` to ``end`` of a member: at ``place`` in the file, or, without a place, unpacked from the member's begin."""

    path: str
    member: str | None
    size: int
    begin: int
    end: int
    place: int | None
    error: str | None = None


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(pattern)``: zip, tar and compressed tar files that all machines can open."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern = options["path"]
        self.range, self.chunk = int(options.get("range", RANGE)), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[Part]:
        """Only directories and headers are read here."""
        found: list[Part] = []
        for path in sorted(glob.glob(self.pattern)):
            try:
                found += self._zipped(path) if zipfile.is_zipfile(path) else self._tarred(path)
            except (tarfile.TarError, zipfile.BadZipFile, OSError) as problem:
                found.append(Part(path, None, 0, 0, 0, None, str(problem)))
        return found

    def _ranges(self, path: str, member: str, size: int, place: int) -> list[Part]:
        begins = range(0, max(size, 1), self.range)
        return [Part(path, member, size, a, min(a + self.range, size), place + a) for a in begins]

    def _zipped(self, path: str) -> list[Part]:
        found: list[Part] = []
        with zipfile.ZipFile(path) as archive, open(path, "rb") as file:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    found.append(Part(path, info.filename, info.file_size, 0, 0, None, "encrypted"))
                elif info.compress_type == zipfile.ZIP_STORED:
                    file.seek(info.header_offset)
                    header = file.read(30)
                    place = info.header_offset + 30 + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
                    found += self._ranges(path, info.filename, info.file_size, place)
                else:  # packed bytes can only be read from their begin
                    found.append(Part(path, info.filename, info.file_size, 0, info.file_size, None))
        return found

    def _tarred(self, path: str) -> list[Part]:
        try:
            with tarfile.open(path, "r:") as archive:
                return [p for x in archive if x.isfile() for p in self._ranges(path, x.name, x.size, x.offset_data)]
        except tarfile.ReadError:
            with tarfile.open(path, "r|*"):  # a compressed tar is read in one go, by one task
                return [Part(path, None, 0, 0, 0, None)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.error is not None:
            yield part.path, part.member, part.size, None, None, part.error
        elif part.place is not None:
            with open(part.path, "rb") as file:
                file.seek(part.place)
                yield from self._rows(part.path, part.member, part.size, part.begin, part.end, file)
        elif part.member is not None:
            try:
                with zipfile.ZipFile(part.path) as archive, archive.open(part.member) as file:
                    yield from self._rows(part.path, part.member, part.size, 0, part.size, file)
            except (zipfile.BadZipFile, NotImplementedError, OSError, EOFError) as problem:
                yield part.path, part.member, part.size, None, None, str(problem)
        else:
            try:
                with tarfile.open(part.path, "r|*") as archive:
                    for x in archive:
                        if x.isfile():
                            yield from self._rows(part.path, x.name, x.size, 0, x.size, archive.extractfile(x))
            except (tarfile.TarError, OSError, EOFError) as problem:
                yield part.path, None, 0, None, None, str(problem)

    def _rows(self, path: str, member: str, size: int, begin: int, end: int, file: BufferedReader) -> Iterator[tuple]:
        """Rows of at most a chunk each; an empty member has one row."""
        at = begin
        while at < end or at == end == 0:
            data = file.read(min(self.chunk, end - at))
            if not data and end:
                yield path, member, size, at, None, "the member ends early"
                return
            yield path, member, size, at, data, None
            at += max(len(data), 1)


def archive_members(spark: SparkSession, pattern: str, range_bytes: int = RANGE, chunk_bytes: int = CHUNK) -> DataFrame:
    """``path, member, size, offset, content, error``: the bytes of all members, a row for each chunk at its offset.

    A member of any size is read: where its bytes lie unpacked in the file, in ranges
    by as many tasks, else by one task, a chunk at a time. A broken archive or member, or an
    encrypted one, has a row with an error. Members inside members are not opened.
    """
    importable(spark)
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("range", range_bytes).option("chunk", chunk_bytes).load(pattern)
