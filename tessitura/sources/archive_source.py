"""Archives as a Spark data source: spark.read.format("archives") and df.write.format("archives").

A file needs no index to be read by many tasks. It is cut at byte ranges; a task looks for the first record mark (`SP NUL B` and a
known type) in its range whose value ends at the file's end or at another such mark, and begins after that value. It goes on until
it has read the record after the last mark before its range's end. So every record is read once, however the cuts fall, though its
key can't be told from the bytes before it by looking back. Values that a filter on the key rules out are passed over unread.

A writing task makes one file and its piece of the index under names of its own; the commit moves them, an abort removes them.

Options: `split` (bytes of a range, 64 MB), `token` (record type to write, FM). Requires
spark.sql.python.filterPushdown.enabled for filters to reach the reader; without it Spark filters what was read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .archives import DENSE, VALUE, Cursor, Short, _batch, place_of, value_bytes, value_of

SPLIT = 1 << 26
#: Bytes read at once, and of a record's head at first.
READ, HEAD = 1 << 20, 1 << 12
#: Records, and numbers, of a batch.
RECORDS, NUMBERS = 1024, 1 << 20
MARK = b" \0B"


def extent(c: Cursor) -> int:
    """Where the value at the cursor ends; of its numbers nothing is read, but for sparse matrices."""
    if c.take(2) != MARK[1:]:
        raise ValueError("not a binary archive")
    if c.data[c.at : c.at + 1] == b"\x04":
        return c.number() * 5 + c.at
    token = c.until_space()
    if token in DENSE:
        rows = 1 if token.endswith("V") else c.number()
        cols = c.number()
        return c.at + rows * cols * (1 + token.endswith("CM")) * np.dtype(DENSE[token]).itemsize
    if token in ("CM", "CM2", "CM3"):
        rows, cols = np.frombuffer(c.take(16), "<i4")[2:].tolist()
        return c.at + {"CM": 8 * cols + rows * cols, "CM2": 2 * rows * cols, "CM3": rows * cols}[token]
    if token == "SM":
        for _ in range(c.number()):
            if c.until_space() != "SV":
                raise ValueError("a sparse matrix has sparse vectors only")
            c.number()
            c.take(10 * c.number())
        return c.at
    raise ValueError(f"unknown record type {token}")


class Pieces:
    """Bytes of a file by offset, read a block at a time."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def at(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if not self.base <= offset or offset + n > self.base + len(self.data):
            self.base, self.data = offset, self.file.read_at(min(max(n, READ), self.size - offset), offset)
        return self.data[offset - self.base : offset - self.base + n]

    def head(self, at: int, keyed: bool = True) -> tuple[str, int, int]:
        """(key, where its value begins, where that ends) of the record at an offset; without a key if that isn't known."""
        many = HEAD
        while True:
            c = Cursor(self.at(at, many))
            try:
                key = c.until_space() if keyed else ""
                begin = at + c.at
                return key, begin, at + extent(c)
            except Short:
                if at + many >= self.size:
                    raise ValueError("the file ends inside a record") from None
                many *= 8

    def mark(self, at: int) -> int | None:
        """The first record mark at or after an offset."""
        while at < self.size:
            data = self.at(at, READ)
            found = data.find(MARK)
            if found < 0:
                at += max(len(data) - len(MARK) + 1, 1)
            elif self._real(at + found):
                return at + found
            else:
                at += found + 1
        return None

    def _real(self, mark: int) -> bool:
        try:
            end = self.head(mark + 1, keyed=False)[2]
            if end < self.size:
                self.head(end)
            return end <= self.size
        except (ValueError, UnicodeDecodeError):
            return False


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.keys = path, split, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def partitions(self) -> list[Range]:
        place, root = place_of(self.path)
        info = place.get_file_info(root)
        if info.type == fs.FileType.File:
            files = [(self.path, info.size)]
        else:
            found = (x for x in place.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".ark") and x.base_name[0] not in "._")
            files = sorted((f"{self.path.rstrip('/')}/{x.base_name}", x.size) for x in found)
        return [Range(path, at, min(at + self.split, size)) for path, size in files for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        place, root = place_of(partition.path)
        with place.open_input_file(root) as file:
            pieces, at, last, rows, many = Pieces(file), 0, -1, [], 0
            if partition.begin:
                last = pieces.mark(partition.begin)
                at = pieces.size if last is None else pieces.head(last + 1, keyed=False)[2]
            while at < pieces.size and last < partition.end:
                key, begin, end = pieces.head(at)
                if end > pieces.size:
                    raise ValueError(f"{partition.path} ends inside the record of {key}")
                if self.keys is None or key in self.keys:
                    rows.append((key, *value_of(Cursor(pieces.at(begin, end - begin)))))
                    many += len(rows[-1][-1])
                    if len(rows) >= RECORDS or many >= NUMBERS:
                        yield _batch(rows)
                        rows, many = [], 0
                at, last = end, begin - 1
            if rows:
                yield _batch(rows)


@dataclass
class Written(WriterCommitMessage):
    name: str


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, token: str, overwrite: bool):
        self.path, self.token, self.overwrite = path.rstrip("/"), token, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, root = place_of(self.path)
        place.create_dir(f"{root}/index", recursive=True)
        name = f"part-{uuid.uuid4().hex}.ark"
        try:
            self._write(iterator, place, root, name)
        except BaseException:
            self._remove(place, root, name)
            raise
        return Written(name)

    def _write(self, iterator: Iterator[pa.RecordBatch], place, root: str, name: str) -> None:
        at = 0
        with place.open_output_stream(f"{root}/_{name}") as out, place.open_output_stream(f"{root}/index/_{name}") as index:
            for b in iterator:
                x = b.column(b.schema.get_field_index("x"))
                for key, rows, cols, v in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "rows", "cols")), x, strict=True):
                    head, value = f"{key} ".encode(), value_bytes(np.asarray(v.values), rows, cols, self.token)
                    out.write(head + value)
                    index.write(f"{key}\t{self.path}/{name}:{at + len(head)}\n".encode())
                    at += len(head) + len(value)

    @staticmethod
    def _remove(place, root: str, name: str) -> None:
        for path in (f"{root}/_{name}", f"{root}/index/_{name}"):
            if place.get_file_info(path).type == fs.FileType.File:
                place.delete_file(path)

    def commit(self, messages) -> None:
        place, root = place_of(self.path)
        old = [x.path for folder in (root, f"{root}/index") for x in place.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File and x.base_name[0] != "_"]
        for m in messages:
            if m is not None:
                place.move(f"{root}/_{m.name}", f"{root}/{m.name}")
                place.move(f"{root}/index/_{m.name}", f"{root}/index/{m.name}")
        for path in old if self.overwrite else []:
            place.delete_file(path)

    def abort(self, messages) -> None:
        place, root = place_of(self.path)
        for m in messages:
            if m is not None:
                self._remove(place, root, m.name)


class Archives(DataSource):
    """key, rows, cols, complex, x of every record."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return f"key string, {VALUE}"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        missing = {"key", "rows", "cols", "x"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return ArchiveWriter(self.options["path"], self.options.get("token", "FM"), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, in which the format is known and filters on the key reach it."""
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_split(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    return registered(spark).read.format("archives").option("split", split).load(path)
