"""Files that Spark's own formats can't make or read safely: one file written by many tasks, and lines of any length.

Both are Python data sources.  Paths go to Arrow's file systems, so they may be
local, HDFS or an object store; what tasks write and the commit joins has to be
in a place that all of them see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes moved or looked at together.
CHUNK = 8 << 20
#: Bytes of a file that one task looks for the beginnings of lines in.
SPLIT = 64 << 20


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


# One file.


@dataclass
class Fragment(WriterCommitMessage):
    """What a task has written: its place in the order, and its bytes."""

    place: int
    name: str
    size: int


class OneFileWriter(DataSourceArrowWriter):
    """Tasks write fragments; the commit puts them behind each other under the file's name, or nothing at all.

    ``head`` and ``tail`` stand before and after all rows; ``first`` replaces
    the lead that the very first row shares with the others.
    """

    def __init__(self, path: str, head: str, tail: str, lead: str, first: str, overwrite: bool):
        self.path, self.head, self.tail, self.lead, self.first, self.overwrite = path, head.encode(), tail.encode(), lead.encode(), first.encode(), overwrite
        self.own = f"{path}.parts-{uuid.uuid4().hex}"
        fs, where = _at(path)
        if not overwrite and fs.get_file_info(where).type != pafs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragment:
        task = TaskContext.get()
        # An attempt that runs beside another has a name of its own; only those that are committed count.
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        fs, folder = _at(self.own)
        fs.create_dir(folder, recursive=True)
        size = 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for batch in iterator:
                rows = b"".join(self.lead + (x or "").encode() + b"\n" for x in batch.column(0).to_pylist())
                out.write(rows)
                size += len(rows)
        return Fragment(task.partitionId(), name, size)

    def commit(self, messages: list[Fragment | None]) -> None:
        fs, folder = _at(self.own)
        fs.create_dir(folder, recursive=True)
        first = self.first
        with fs.open_output_stream(f"{folder}/whole") as out:
            out.write(self.head)
            for part in sorted((m for m in messages if m is not None and m.size), key=lambda m: m.place):
                with fs.open_input_stream(f"{folder}/{part.name}") as read:
                    if first is not None:
                        read.read(len(self.lead))
                        out.write(first)
                        first = None
                    while chunk := read.read(CHUNK):
                        out.write(chunk)
            out.write(self.tail if first is None else self.first + self.tail)
        fs.move(f"{folder}/whole", _at(self.path)[1])
        fs.delete_dir(folder)

    def abort(self, messages: list[Fragment | None]) -> None:
        fs, folder = _at(self.own)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class OneFile(DataSource):
    """Format ``ledgerleaf-file``: a column of lines as one file, in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "ledgerleaf-file"

    def writer(self, schema: StructType, overwrite: bool) -> OneFileWriter:
        o = self.options
        return OneFileWriter(o["path"], o.get("head", ""), o.get("tail", ""), o.get("lead", ""), o.get("first", ""), overwrite)


def write_lines(lines: DataFrame, path: str, order: list[str], value: str = "value", head: str = "", tail: str = "", lead: str = "", first: str = "") -> None:
    """Write ``value`` of each row as a line of the one file ``path``, by ``order``.

    Rows are sorted in ranges, each of which a task writes; nothing is sorted or
    made into text in one place.  An older file is replaced when all is written;
    if a task fails for good, neither the file nor a fragment is left or changed.
    """
    spark = lines.sparkSession
    spark.dataSource.register(OneFile)
    parts = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(value)
    parts.write.format("ledgerleaf-file").options(path=path, head=head, tail=tail, lead=lead, first=first).mode("overwrite").save()


# Lines of any length.


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _lines(split: Split, most: int, chunk: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, bytes so far, line) of the lines that begin in a split; of one over the cap no more is kept than the fact."""
    fs, where = _at(split.path)
    with fs.open_input_file(where) as f:
        at = split.start
        if at:
            # The line that runs into the split belongs to an earlier one: its end is looked for, it is not read.
            at = _line_end(f, at - 1, split.end, chunk)
        while at < split.end:
            kept, seen, end = [], 0, None
            while end is None and seen <= most and at + seen < split.size:
                data = f.read_at(min(chunk, split.size - at - seen, most + 1 - seen), at + seen)
                stop = data.find(b"\n")
                if stop >= 0:
                    data, end = data[:stop], at + seen + stop + 1
                kept.append(data)
                seen += len(data)
            if seen > most:
                # The rest is passed over, within the split; beyond its end another split looks for the next line.
                kept.clear()
                yield at, seen, None
                at = _line_end(f, at + seen, split.end, chunk) if end is None else end
            else:
                yield at, seen, b"".join(kept)
                at = end if end is not None else split.size


def _line_end(f: pa.NativeFile, at: int, limit: int, chunk: int) -> int:
    """Where the next line begins at or after ``at``; ``limit`` if none does before it."""
    while at < limit:
        data = f.read_at(min(chunk, limit - at), at)
        stop = data.find(b"\n")
        if stop >= 0:
            return at + stop + 1
        at += len(data)
    return limit


class CappedReader(DataSourceReader):
    def __init__(self, paths: list[str], most: int, split: int, chunk: int):
        self.paths, self.most, self.split, self.chunk = paths, most, split, chunk

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            fs, where = _at(path)
            found = fs.get_file_info(where)
            files = [found] if found.type == pafs.FileType.File else sorted((x for x in fs.get_file_info(pafs.FileSelector(where)) if x.type == pafs.FileType.File), key=lambda x: x.path)
            scheme = path[: path.index(":/") + 1] + "//" if ":/" in path else ""
            for x in files:
                if not x.base_name.startswith((".", "_")):
                    out += [Split(scheme + x.path if scheme else x.path, s, min(s + self.split, x.size), x.size) for s in range(0, x.size, self.split)]
        return out or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if partition.end:
            for offset, seen, line in _lines(partition, self.most, self.chunk):
                text = None if line is None else line.removesuffix(b"\r").decode("utf-8", "replace")
                yield partition.path, offset, seen, text


class CappedLines(DataSource):
    """Format ``ledgerleaf-lines``: lines of text files up to a cap; of a longer one only where it is."""

    @classmethod
    def name(cls) -> str:
        return "ledgerleaf-lines"

    def schema(self) -> str:
        return "path string, offset bigint, seen bigint, value string"

    def reader(self, schema: StructType) -> CappedReader:
        o = self.options
        return CappedReader([o["path"]], int(o["most"]), int(o.get("split", SPLIT)), int(o.get("chunk", CHUNK)))


def read_lines(spark: SparkSession, path: str, most: int, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """``path, offset, seen, value`` of the lines of a file, or of a folder's files.

    A line of over ``most`` bytes has a null value: reading stops at the cap, so
    no task holds more than that, whatever the line's length.  ``seen`` is the
    number of bytes looked at.  Files are split, and a line belongs to the split
    it begins in.
    """
    spark.dataSource.register(CappedLines)
    return spark.read.format("ledgerleaf-lines").options(path=path, most=most, split=split, chunk=chunk).load()
