"""Writers. Results are Parquet tables; these give the other forms the collections are exchanged in."""

from __future__ import annotations

import io
import uuid
import wave as riff

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .archives import place_of


def encode_waves(waves: DataFrame, sr: int = 16000, peak: float | None = None) -> DataFrame:
    """(utt, content): RIFF files of 16-bit PCM of waves(utt, x array of samples in [-1, 1]); peak: scale to it first."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                x = np.asarray(x.values, dtype=np.float64)
                if peak:
                    x = x * (peak / max(float(np.abs(x).max(initial=0)), 1e-12))
                with io.BytesIO() as f:
                    with riff.open(f, "wb") as w:
                        w.setnchannels(1)
                        w.setsampwidth(2)
                        w.setframerate(sr)
                        w.writeframes(np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes())
                    out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["utt", "content"])

    return waves.select("utt", "x").mapInArrow(run, f"utt {waves.schema['utt'].dataType.simpleString()}, content binary")


def encode_arrays(rows: DataFrame, dtype: str = "float32") -> DataFrame:
    """(utt, content): .npy files of rows(utt, x array)."""

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                with io.BytesIO() as f:
                    np.save(f, np.asarray(x.values).astype(dtype), allow_pickle=False)
                    out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["utt", "content"])

    return rows.select("utt", "x").mapInArrow(run, f"utt {rows.schema['utt'].dataType.simpleString()}, content binary")


def export(files: DataFrame, folder: str, extension: str) -> DataFrame:
    """Writes (utt, content) as one file a key below a folder that all tasks reach (a path or any URI that pyarrow knows) and
    returns (key, path). A file is moved to its name when it is whole, so a task that is run again does no harm."""
    folder, ending = folder.rstrip("/"), extension.lstrip(".")

    def run(batches):
        place, root = place_of(folder)
        place.create_dir(root, recursive=True)
        for b in batches:
            keys = [str(k) for k in b.column(0).to_pylist()]
            for key, content in zip(keys, b.column(1).to_pylist(), strict=True):
                own = f"{root}/_{uuid.uuid4().hex}"
                with place.open_output_stream(own) as out:
                    out.write(content)
                place.move(own, f"{root}/{key}.{ending}")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([f"{folder}/{k}.{ending}" for k in keys], pa.string())], ["key", "path"])

    spark = files.sparkSession
    files.select("utt", "content").mapInArrow(run, "key string, path string").write.parquet(f"{folder}/_index")
    return spark.read.parquet(f"{folder}/_index")


def report_lines(df: DataFrame, key: str, value: Column, decimals: int = 3) -> DataFrame:
    """(value): lines `key TAB number`, for df.write.text."""
    return df.select(F.concat_ws("\t", F.col(key).cast("string"), F.format_string(f"%.{decimals}f", value)).alias("value"))


def unwritten(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't written yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def config_json(df: DataFrame, *columns: str) -> DataFrame:
    """(value): one JSON object a row."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))
