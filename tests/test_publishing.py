"""Versioned sink, verified scans, canonical fingerprints, comparison of unlike tables."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tabsieve.functions.canonical import float_text
from tabsieve.operators import quality
from tabsieve.sources import tables, versions


def ids(spark, path):
    return sorted(r["id"] for r in tables.read_table(spark, path).collect())


def test_a_reader_always_finds_one_whole_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    versions.publish_table(spark.range(3), path)
    assert ids(spark, path) == [0, 1, 2]

    # a writer that dies after its files are complete, before the marker
    def killed(*_):
        assert ids(spark, path) == [0, 1, 2]
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.publish_table(spark.range(9), path)
    assert ids(spark, path) == [0, 1, 2]
    assert len(list((tmp_path / "t.parquet").glob("_v-*"))) == 2  # the leftover

    # a writer that dies after the marker
    with monkeypatch.context() as m:
        m.setattr(versions, "_tidy", killed)
        with pytest.raises((KeyboardInterrupt, AssertionError)):
            versions.publish_table(spark.range(5), path)
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    monkeypatch.setattr(versions, "LEFTOVER_MS", -1)
    versions.publish_table(spark.range(6), path)
    assert ids(spark, path) == [0, 1, 2, 3, 4, 5]
    assert len(list((tmp_path / "t.parquet").glob("_v-*"))) == 2  # current and previous


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    versions.publish_table(spark.range(2), path)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.publish_table(bad, path)
    assert ids(spark, path) == [0, 1]
    assert len(list((tmp_path / "t.parquet").glob("_v-*"))) == 1


def test_plain_folders_and_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(4).write.parquet(path)
    assert versions.current_version(spark, path) is None and len(ids(spark, path)) == 4
    versions.publish_table(spark.range(1), path)
    assert ids(spark, path) == [0]
    (tmp_path / "f.csv").write_text("id\n1\n")
    with pytest.raises(NotADirectoryError):
        versions.publish_table(spark.range(1), str(tmp_path / "f.csv"), fmt="csv")


def test_a_verified_scan_checks_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(10).write.parquet(path)
    expected = tables.fingerprint_value(spark.read.parquet(path))
    scan = tables.VerifiedScan(spark, path, expected)
    spark.range(10, 12).write.mode("append").parquet(path)  # not among the pinned files
    out = str(tmp_path / "out.parquet")
    versions.publish_written(spark, out, lambda t: scan.run(lambda f: tables.save_files(f, t, "parquet")))
    assert ids(spark, out) == list(range(10))

    stale = tables.VerifiedScan(spark, path, expected)  # twelve rows now
    with pytest.raises(tables.StaleDatasetError):
        versions.publish_written(spark, out, lambda t: stale.run(lambda f: tables.save_files(f, t, "parquet")))
    assert ids(spark, out) == list(range(10))
    with pytest.raises(tables.StaleDatasetError):
        tables.read_verified(spark, path, expected)


def slow_float(x):
    if x != x:
        return "Fnan"
    if x in (float("inf"), float("-inf")):
        return "Finf" if x > 0 else "F-inf"
    n, d = abs(x).as_integer_ratio()
    if not n:
        return "F0"
    twos = 0
    while n % 2 == 0:
        n, twos = n // 2, twos + 1
    return f"F{'-' if x < 0 else ''}{n}p{twos - (d.bit_length() - 1)}"


def test_float_text_is_the_exact_value(spark):
    import random
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, 1.5, 0.1, -0.1, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0 ** 53 + 2,
              float("inf"), float("-inf"), float("nan"), 1e16, 123456.789]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(400)]
    values += [2.0 ** k for k in range(-1070, 1020, 13)] + [2.0 ** k - 2.0 ** (k - 53) for k in range(-900, 1020, 17)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["t"] for r in df.select("i", float_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert found == [slow_float(v) for v in values]


def test_fingerprint_can_be_repeated_by_hand(spark):
    df = spark.createDataFrame([(1, "a;b", 1.5, None), (2, None, None, {"k": [1, None]})],
                               "n long, s string, x double, m map<string, array<int>>")
    rows = ["I1;S3:a;b;F3p-1;N", "I2;N;N;P1{S1:k=A2[I1,N]}"]
    halves = [(int(hashlib.md5(r.encode()).hexdigest()[:16], 16), int(hashlib.md5(r.encode()).hexdigest()[16:], 16))
              for r in rows]
    text = "n:bigint,s:string,x:double,m:map<string,array<int>>|2|%d|%d" % tuple(sum(h) % (1 << 64) for h in zip(*halves))
    assert tables.fingerprint_value(df) == hashlib.sha256(text.encode()).hexdigest()
    assert tables.fingerprint_value(df.repartition(3)) == tables.fingerprint_value(df)


def test_map_columns_are_compared_by_content(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as m, 1 as k union all select map('b', 2, 'a', 1), 1 "
                   "union all select map('a', 2), 1 union all select null, 1 union all select null, 1")
    assert quality.duplicate_row_count(df).first()["duplicate_rows"] == 2
    assert tables.datasets_equal(df, df.repartition(2))
    assert not tables.datasets_equal(df, df.where("m is not null"))


def test_unlike_types_differ_instead_of_failing(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([("1", "x"), ("abc", "y")], "k string, v string")
    assert tuple(tables.dataset_difference(left, right).first()) == (1, 1, False)
    assert tables.datasets_equal(left, left.selectExpr("cast(k as string) as k", "v"))
    nested = spark.sql("select array(1) as k, 'x' as v")
    assert not tables.datasets_equal(left, nested)
