"""The archive data source: every cut, filters on the key, commits and aborts."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.sources import archive_source as S
from tessitura.sources import archives as A

RNG = np.random.default_rng(8)


def vector(values, wide=False):
    return b"\0BFV \x04" + struct.pack("<i", len(values)) + np.asarray(values, "<f4").tobytes()


def integers(values):
    return b"\0B\x04" + struct.pack("<i", len(values)) + b"".join(b"\x04" + struct.pack("<i", v) for v in values)


def sparse(rows):
    """rows: (size, {place: value})."""
    out = b"\0BSM \x04" + struct.pack("<i", len(rows))
    for size, at in rows:
        out += b"SV \x04" + struct.pack("<i", size) + b"\x04" + struct.pack("<i", len(at)) + b"".join(b"\x04" + struct.pack("<i", k) + b"\x04" + struct.pack("<f", v) for k, v in at.items())
    return out


def compressed(kind, low, span, rows, cols, body):
    return f"\0B{kind} ".encode() + struct.pack("<ffii", low, span, rows, cols) + body


#: A vector whose bytes look like marks and like a record's beginning.
TRAP = np.frombuffer((b"x \0BFM \x04" * 12 + b"k1 \0B\x04" * 12)[: 4 * 40], "<f4")
RECORDS = [
    ("a", vector([1, 2, 3]), [1, 2, 3]),
    ("trap", vector(TRAP), TRAP.astype(float).tolist()),
    ("ints", integers([5, -7, 2**31 - 1]), [5, -7, 2**31 - 1]),
    ("empty", vector([]), []),
    ("sm", sparse([(4, {1: 2.5, 3: -1.0}), (4, {})]), [0, 2.5, 0, -1, 0, 0, 0, 0]),
    ("cm2", compressed("CM2", 1.0, 2.0, 2, 2, np.array([0, 65535, 13107, 26214], "<u2").tobytes()), [1.0, 3.0, 1.4, 1.8]),
    ("cm3", compressed("CM3", -1.0, 5.1, 1, 3, bytes([0, 255, 51])), [-1.0, 4.1, 0.02]),
    # one column: quartiles 0, 1, 3, 7 of a span of 65535; bytes 0, 64, 192, 255 meet them, 32 and 128 lie half way
    ("cm", compressed("CM", 0.0, 65535.0, 6, 1, np.array([0, 1, 3, 7], "<u2").tobytes() + bytes([0, 64, 192, 255, 32, 128])), [0, 1, 3, 7, 0.5, 2.0]),
    *((f"r{i}", vector(v := RNG.normal(size=int(n)).astype("f4")), v.astype(float).tolist()) for i, n in enumerate(RNG.integers(0, 30, 25))),
]


@pytest.fixture
def file(tmp_path):
    (tmp_path / "all.ark").write_bytes(b"".join(f"{k} ".encode() + v for k, v, _ in RECORDS))
    return str(tmp_path / "all.ark")


@pytest.mark.parametrize("split", [1, 7, 50, 333, 1 << 20])
def test_every_record_once_whatever_the_cuts(file, split):
    reader = S.ArchiveReader(file, split)
    got = [(r["key"], r["x"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [k for k, _ in got] == [k for k, *_ in RECORDS]
    for (key, x), (_, _, want) in zip(got, RECORDS, strict=True):
        assert np.allclose(x, want, atol=1e-6, equal_nan=True), key


def test_reading_by_many_tasks(spark, file):
    df = S.read_split(spark, file, 100)
    assert df.rdd.getNumPartitions() == -(-os.path.getsize(file) // 100)
    assert sorted(r["key"] for r in df.collect()) == sorted(k for k, *_ in RECORDS)


def test_filters_reach_the_reader(spark, file):
    df = S.read_split(spark, file, 100)
    assert [r["x"] for r in df.where("key = 'ints'").collect()] == [[5, -7, 2**31 - 1]]
    assert sorted(r["key"] for r in df.where(F.col("key").isin("a", "cm", "none") & (F.size("x") > 3)).collect()) == ["cm"]
    reader = S.ArchiveReader(file, 1 << 20)
    assert list(reader.pushFilters([S.EqualTo(("key",), "a"), S.EqualTo(("rows",), 1), S.In(("key",), ("a", "b"))])) == [S.EqualTo(("rows",), 1)]
    assert reader.keys == {"a"}


def test_a_cut_off_file_fails(spark, tmp_path):
    (tmp_path / "cut.ark").write_bytes(b"a " + vector([1, 2, 3])[:-2])
    with pytest.raises(Exception, match="ends inside"):
        S.read_split(spark, str(tmp_path / "cut.ark")).collect()


def test_written_read_again_by_scan_and_by_index(spark, tmp_path):
    df = spark.range(200).select(F.format_string("k%d", "id").alias("key"), F.lit(2).alias("rows"), F.lit(3).alias("cols"), F.array(*((F.col("id") * 6 + k).cast("double") for k in range(6))).alias("x")).repartition(4)
    S.registered(spark)
    path = str(tmp_path / "out")
    for mode in ("overwrite", "overwrite", "append"):
        df.write.format("archives").option("token", "DM").mode(mode).save(path)
    want = sorted((f"k{i}", 2, 3, [float(i * 6 + k) for k in range(6)]) for i in range(200))
    for got in (S.read_split(spark, path, 64), A.read_at(A.read_index(spark, f"{path}/index"))):
        assert sorted((r["key"], r["rows"], r["cols"], r["x"]) for r in got.collect()) == sorted(want * 2)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    S.registered(spark)
    (tmp_path / "out").mkdir()
    bad = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.array(F.lit(1.0))).alias("x"))
    with pytest.raises(Exception, match="no"):
        bad.repartition(4).write.format("archives").mode("append").save(str(tmp_path / "out"))
    assert S.read_split(spark, str(tmp_path / "out")).count() == 0
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]
