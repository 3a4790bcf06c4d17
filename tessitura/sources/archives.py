"""Binary archives of many records in one file, with an index of byte offsets, and extended-raw files of arrays.

Fixed formats. An archive's record is `key SP NUL B token SP` and its value: matrices FM (float) and DM (double) and complex
matrices FCM and DCM as `4 rows 4 cols data` (complex numbers as pairs), vectors FV and DV as `4 size data`, integer vectors
without a token as `4 size` and `4 number` each, sparse matrices SM as `4 rows` and a vector `SV 4 size 4 many` with
`4 place 4 value` pairs each, compressed ones CM, CM2 and CM3. An extended-raw record is `key SP`, a letter of f d i q, v or m
for one or two dimensions, their 32-bit sizes and the numbers. An index line is `key TAB path:offset`, the offset of the value.

Files are written and read by tasks through pyarrow's file systems, so a folder can be any URI that it knows. A task writes
its file under a name of its own and moves it when it is whole; what a lost executor began is never read."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE = {"FM": "<f4", "DM": "<f8", "FV": "<f4", "DV": "<f8", "FCM": "<f4", "DCM": "<f8"}
RAW = {"f": "<f4", "d": "<f8", "i": "<i4", "q": "<i8"}
VALUE = "rows int, cols int, complex boolean, x array<double>"
_TYPES = pa.schema([("key", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("complex", pa.bool_()), ("x", pa.list_(pa.float64()))])
#: Bytes read at once when a record of unknown size is looked for.
FIRST_READ = 1 << 16


class Short(ValueError):
    """More bytes are needed."""


class Cursor:
    """Typed reads from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def until_space(self) -> str:
        to = self.data.find(b" ", self.at)
        if to < 0:
            raise Short
        return self.take(to - self.at + 1)[:-1].decode()

    def number(self, kind: str = "i") -> float:
        if self.take(1) != b"\x04":
            raise ValueError("a number of another size than four bytes")
        return struct.unpack("<" + kind, self.take(4))[0]

    def array(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(np.dtype(kind).itemsize * n), kind).astype(np.float64)


def value_of(c: Cursor) -> tuple[int, int, bool, np.ndarray]:
    """(rows, columns, complex, numbers) of the archive value at the cursor."""
    if c.take(2) != b"\0B":
        raise ValueError("not a binary archive")
    if c.data[c.at : c.at + 1] == b"\x04":  # integers
        n = c.number()
        return 1, n, False, np.array([c.number() for _ in range(n)], dtype=np.float64)
    token = c.until_space()
    if token in DENSE:
        rows = 1 if token.endswith("V") else c.number()
        cols, two = c.number(), token.endswith("CM")
        return rows, cols, two, c.array(DENSE[token], rows * cols * (1 + two))
    if token == "SM":
        parts = []
        for _ in range(c.number()):
            if c.until_space() != "SV":
                raise ValueError("a sparse matrix has sparse vectors only")
            row = np.zeros(c.number())
            for _ in range(c.number()):
                at = c.number()
                row[at] = c.number("f")
            parts.append(row)
        return len(parts), len(parts[0]) if parts else 0, False, np.concatenate(parts) if parts else np.zeros(0)
    if token in ("CM", "CM2", "CM3"):
        low, span, rows, cols = struct.unpack("<ffii", c.take(16))
        if token != "CM":
            kind, top = ("<u2", 65535.0) if token == "CM2" else ("u1", 255.0)
            return rows, cols, False, c.array(kind, rows * cols) * (span / top) + low
        quartile = (c.array("<u2", 4 * cols) * (span / 65535.0) + low).reshape(cols, 4)
        u = c.array("u1", rows * cols).reshape(cols, rows)
        x = [np.interp(a, (0, 64, 192, 255), q) for a, q in zip(u, quartile, strict=True)]
        return rows, cols, False, np.stack(x, axis=1).ravel()
    raise ValueError(f"unknown record type {token}")


def raw_of(c: Cursor) -> tuple[int, int, bool, np.ndarray]:
    """The extended-raw value at the cursor; vectors have one row."""
    kind, shape = c.take(1).decode(), c.take(1)
    rows, cols = struct.unpack("<ii", c.take(8)) if shape == b"m" else (1, *struct.unpack("<i", c.take(4)))
    return rows, cols, False, c.array(RAW[kind], rows * cols)


FORMATS: dict[str, Callable] = {"archive": value_of, "raw": raw_of}


def value_bytes(x: np.ndarray, rows: int, cols: int, token: str) -> bytes:
    """The value of a record: a token of DENSE for archives, `raw` and a letter of RAW for extended raw (rows 0: a vector)."""
    if token.startswith("raw"):
        size = struct.pack("<ii", rows, cols) if rows else struct.pack("<i", cols)
        return token[-1].encode() + (b"m" if rows else b"v") + size + x.astype(RAW[token[-1]]).tobytes()
    size = struct.pack("<bi", 4, cols) if token.endswith("V") else struct.pack("<bibi", 4, rows, 4, cols)
    return b"\0B" + token.encode() + b" " + size + x.astype(DENSE[token]).tobytes()


def place_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(records: DataFrame, folder: str, token: str = "FM") -> DataFrame:
    """Writes records(key, rows, cols, x) as one file a partition and returns the index (key, path, offset), which is stored as
    text lines in folder/index."""
    spark = records.sparkSession
    folder = folder.rstrip("/")

    def run(batches):
        place, root = place_of(folder)
        place.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.ark"
        keys, offsets, at = [], [], 0
        with place.open_output_stream(f"{root}/_{name}") as out:
            for b in batches:
                for key, rows, cols, x in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                    head, value = f"{key} ".encode(), value_bytes(np.asarray(x.values), rows, cols, token)
                    keys.append(key)
                    offsets.append(at + len(head))
                    out.write(head + value)
                    at += len(head) + len(value)
        place.move(f"{root}/_{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{k}\t{folder}/{name}:{o}" for k, o in zip(keys, offsets, strict=True)], pa.string())], ["value"])

    records.select(F.col("key").cast("string").alias("key"), F.col("rows").cast("int"), F.col("cols").cast("int"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "value string").write.text(f"{folder}/index")
    return read_index(spark, f"{folder}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, path, offset) of index lines; a line without an offset fails."""
    v = spark.read.text(path).where(F.btrim("value") != "").select(F.split(F.btrim("value"), "\\s+", 2).alias("v"))
    where = F.element_at("v", 2)
    offset = F.when(F.rlike(where, F.lit(":[0-9]+$")), F.regexp_extract(where, ":([0-9]+)$", 1).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no offset: "), where)))
    return v.select(F.element_at("v", 1).alias("key"), F.regexp_replace(where, ":[0-9]+$", "").alias("path"), offset.alias("offset"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _TYPES.types, strict=True)], schema=_TYPES)


def read_at(index: DataFrame, kind: str = "archive") -> DataFrame:
    """(key, rows, cols, complex, x) of index(key, path, offset): each record alone is read, so a large file is shared by many
    tasks, and a filter on the index saves reading."""
    parse = FORMATS[kind]

    def run(batches: Iterator[pa.RecordBatch]):
        open_files: dict[str, object] = {}
        for b in batches:
            rows = []
            for key, path, offset in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if path not in open_files:
                    place, root = place_of(path)
                    open_files[path] = place.open_input_file(root)
                size = FIRST_READ
                while True:
                    file = open_files[path]
                    data = file.read_at(min(size, file.size() - offset), offset)
                    try:
                        rows.append((key, *parse(Cursor(data))))
                        break
                    except Short:
                        if offset + size >= file.size():
                            raise ValueError(f"{path} ends inside the record of {key}") from None
                        size *= 4
            yield _batch(rows)

    return index.select("key", "path", "offset").mapInArrow(run, f"key string, {VALUE}")


def read_whole(spark: SparkSession, path: str, kind: str = "archive") -> DataFrame:
    """All records of the files below a path. Archives are cut at byte ranges (see archive_source). Extended-raw records have no
    mark to find them by: one task reads a file from front to back; for large files of these use read_at with their index."""
    if kind == "archive":
        from .archive_source import read_split

        return read_split(spark, path)
    parse = FORMATS[kind]

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                place, root = place_of(p)
                with place.open_input_file(root) as f:
                    at, size, rows = 0, FIRST_READ, []
                    while at < f.size():
                        c = Cursor(f.read_at(min(size, f.size() - at), at))
                        try:
                            while c.at < len(c.data):
                                start = c.at
                                rows.append((c.until_space(), *parse(c)))
                            at += c.at
                        except Short:
                            if not start and len(c.data) == f.size() - at:
                                raise ValueError(f"{p} ends inside a record") from None
                            at, size = at + start, FIRST_READ if start else size * 4
                        yield _batch(rows)
                        rows = []

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ark").load(path).select("path").repartition("path")
    return files.mapInArrow(run, f"key string, {VALUE}")


def table(spark: SparkSession, specifier: str, kind: str = "archive", value: Callable[[Column], Column] | None = None) -> DataFrame:
    """Records of `ark:path` (front to back) or `scp:path` (by index). value: what to make of each record's numbers."""
    how, _, path = specifier.partition(":")
    if how not in ("ark", "scp"):
        raise ValueError(f"neither ark: nor scp: in {specifier}")
    out = read_whole(spark, path, kind) if how == "ark" else read_at(read_index(spark, path), kind)
    return out if value is None else out.withColumn("x", value(F.col("x")))


def wave_headers(files: DataFrame) -> DataFrame:
    """(key, sr, channels, samples) of files(key, path), from the headers of RIFF files alone; samples are not read."""

    def run(batches):
        for b in batches:
            rows = []
            for key, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place, root = place_of(path)
                with place.open_input_file(root) as f:
                    if f.read(4) != b"RIFF" or f.seek(8) is None or f.read(4) != b"WAVE":
                        raise ValueError(f"{path} is no RIFF wave")
                    at, found = 12, {}
                    while at + 8 <= f.size() and "data" not in found:
                        name, size = struct.unpack("<4sI", f.read_at(8, at))
                        found[name.decode("latin-1").strip()] = (at + 8, size)
                        at += 8 + size + size % 2
                    _, channels, sr, _, block, _ = struct.unpack("<hhiihh", f.read_at(16, found["fmt"][0]))
                    rows.append((key, sr, channels, found["data"][1] // block))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["key", "sr", "channels", "samples"])

    return files.select(F.col("key").cast("string").alias("key"), "path").mapInArrow(run, "key string, sr int, channels int, samples long")
