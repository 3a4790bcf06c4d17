"""Readers of keyed collections. All files are read by Spark's own sources, so any store that Spark reads will do.

Locators that are shell commands aren't run. Pickled objects aren't loaded."""

from __future__ import annotations

import io
import wave as riff
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import file_key


def parse_script(lines: DataFrame, tokens: int = 2, restrict: bool = True, unique: bool = True) -> DataFrame:
    """(key, value) of text lines `key value ...`; value is an array for tokens other than 2. Fails on lines of another number
    of tokens if restrict (others may have more), on commands in place of a file, and on keys that occur twice."""
    t = F.split(F.btrim("value"), "\\s+")
    rows = lines.select(t.alias("t")).where(F.element_at("t", 1) != "")
    wrong = (F.size("t") != tokens) if restrict else (F.size("t") < 1)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of tokens: "), F.array_join("t", " ")))).when(F.endswith(F.element_at("t", -1), F.lit("|")), F.raise_error(F.lit("commands aren't run"))).otherwise(F.element_at("t", 1))
    value = F.element_at("t", 2) if tokens == 2 else F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    out = rows.select(checked.alias("key"), value.alias("value"))
    if unique:
        n = F.count("*").over(Window.partitionBy("key"))
        out = out.withColumn("n", n).select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.col("key")))).otherwise(F.col("key")).alias("key"), "value")
    return out


def read_script(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_script(spark.read.text(path), **options)


def scan_folder(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """(key, path, content) of the files with this extension; the key is the file's stem."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension.lstrip('.')}").load(folder).select(file_key(F.col("path")).alias("key"), "path", "content")


#: Bytes of files' contents that a task decodes at once, about.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch):
    """Slices of a batch with about PIECE bytes of its last column each, or one longer file."""
    size = np.cumsum([len(x.as_buffer() or b"") for x in batch.column(batch.num_columns - 1)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    """files' other columns and the columns of decode(bytes) -> dict. Decoded files of one piece of a batch are held at once."""
    rest = [f for f in files.schema if f.name != "content"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    target = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches):
        for b in (x for whole in batches for x in pieces(whole)):
            rows = [decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *pa.Table.from_pylist(rows, target).combine_chunks().columns] if not rows else [*b.columns[:-1], *(pa.array([r[f.name] for r in rows], f.type) for f in target)], [*(f.name for f in rest), *target.names])

    return files.select(*(f.name for f in rest), "content").mapInArrow(run, f"{fields}, {schema}")


def decode_wave(content: bytes, sr: int | None = None, normalize: bool = True) -> dict:
    """Samples of a RIFF file of 16-bit PCM, channels one after the other; fails on another sample rate."""
    with riff.open(io.BytesIO(content)) as w:
        if sr and w.getframerate() != sr:
            raise ValueError(f"sample rate {w.getframerate()} instead of {sr}")
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).T.astype(np.float64)
        return {"sr": w.getframerate(), "channels": w.getnchannels(), "x": (x / 32768 if normalize else x).ravel()}


def read_waves(files: DataFrame, sr: int | None = 16000, normalize: bool = True, beg: int = 0, end: int | None = None) -> DataFrame:
    """(key, ch, sr, x) of files(key, path, content): several files of a key are its channels in the order of their paths.
    beg, end: the samples wanted, of each channel."""
    d = _decoded(files, lambda c: decode_wave(c, sr, normalize), "sr int, channels int, x array<double>")
    part = d.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("channels") - 1))).withColumn("n", (F.size("x") / F.col("channels")).cast("int"))
    ch = F.row_number().over(Window.partitionBy("key").orderBy("path", "c")) - 1
    return part.select("key", ch.alias("ch"), "sr", F.slice("x", F.col("c") * F.col("n") + 1 + beg, F.greatest(F.least(F.col("n"), F.lit(end) if end is not None else F.col("n")) - beg, F.lit(0))).alias("x"))


def read_arrays(files: DataFrame) -> DataFrame:
    """(key, path, rows, cols, x) of .npy files with one or two dimensions; pickled ones are refused."""

    def decode(content):
        a = np.load(io.BytesIO(content), allow_pickle=False)
        a = np.atleast_2d(a)
        return {"rows": a.shape[0], "cols": a.shape[1], "x": a.astype(np.float64).ravel()}

    return _decoded(files, decode, "rows int, cols int, x array<double>")


def read_raw(files: DataFrame, dtype: str = "float32", length: int | None = None) -> DataFrame:
    """(key, path, x) of files that are numbers and nothing else; fails on another length than asked."""

    def decode(content):
        a = np.frombuffer(content, dtype=np.dtype(dtype).newbyteorder("<"))
        if length is not None and len(a) != length:
            raise ValueError(f"{len(a)} values instead of {length}")
        return {"x": a.astype(np.float64)}

    return _decoded(files, decode, "x array<double>")


def decompressed(u: Column, p0: Column, p25: Column, p75: Column, p100: Column) -> Column:
    """A byte of a compressed column from its quartiles, piecewise linear with joints at 64 and 192."""
    return F.when(u <= 64, p0 + (p25 - p0) * u / 64).when(u <= 192, p25 + (p75 - p25) * (u - 64) / 128).otherwise(p75 + (p100 - p75) * (u - 192) / 63)


def segments(wave: DataFrame, cuts: DataFrame, sr: int) -> DataFrame:
    """(seg, utt, ch, x) of cuts(seg, utt, beg, end seconds) in wave(utt, ch, x)."""
    a, b = F.floor(F.col("beg") * sr).cast("int"), F.floor(F.col("end") * sr).cast("int")
    return wave.join(cuts, "utt").select("seg", "utt", "ch", F.slice("x", a + 1, F.greatest(b - a, F.lit(0))).alias("x"))


def channels_of(scripts: list[DataFrame]) -> DataFrame:
    """(key, ch, value) of one script for each channel; keys with a single channel are left out."""
    out = None
    for ch, s in enumerate(scripts):
        one = s.withColumn("ch", F.lit(ch))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n")


def speakers_of(scripts: list[DataFrame]) -> DataFrame:
    """(key, spk, value) of one script for each speaker, spk counted from 0: the keys that every script has."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("spk", F.lit(k).cast("long")) for k, s in enumerate(scripts)])
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where(F.col("n") == len(scripts)).select("key", "spk", "value")


ROOM = "struct<beta:double,receiver_location:array<array<double>>,room_size:array<double>,receiver_geometric:array<double>,spk:array<struct<pos:array<double>,doa:double,dst:double,loc:string>>>"


def room_speakers(configs: DataFrame, column: str = "value") -> DataFrame:
    """(room's other columns, beta, mics, src, loc, doa, dst) of rooms as JSON text."""
    rest = [c for c in configs.columns if c != column]
    r = configs.select(*rest, F.from_json(column, ROOM).alias("r"))
    return r.select(*rest, F.col("r.beta").alias("beta"), F.size("r.receiver_location").cast("long").alias("mics"), F.posexplode("r.spk").alias("src", "s")).select(*rest, "beta", "mics", F.col("src").cast("long").alias("src"), "s.loc", "s.doa", "s.dst")
