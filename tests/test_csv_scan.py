"""CSV files cut anywhere: records with line breaks in quoted fields come out whole."""

import csv
import random

import pytest

from tabsieve.sources import csvscan, tables


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, files, end="\n", seed=1):
    rng = random.Random(seed)
    rows = []
    for f in range(files):
        with open(folder / f"part-{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator=end)
            w.writerow(["id", 'the "note"', "a.b"])
            for i in range(120):
                row = (str(1000 * f + i), rng.choice(["plain", 'with "quotes"', "two\nlines", "comma, here", 'a\n"b"\n\nc',
                                                      "x" * rng.randrange(300), '"', "\n", "crlf\r\nend", "été 漢"]),
                       rng.choice(["u", "v\n" * rng.randrange(40), 'w"']))
                w.writerow(row)
                rows.append(row)
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_survive_every_cut(small_splits, tmp_path, end):
    rows = write(tmp_path, 3, end)
    df = csvscan.scan_csv(small_splits, str(tmp_path))
    assert df.columns == ["id", 'the "note"', "a.b"]
    assert csvscan._lines(small_splits, str(tmp_path)).rdd.getNumPartitions() > 50
    assert sorted(tuple(x or "" for x in r) for r in df.collect()) == sorted(rows)


def test_one_file_is_read_by_many_tasks(small_splits, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("id,text\n" + "".join(f'{i},"line one\nline, two"\n' for i in range(400)))
    df = tables.read_table(small_splits, str(path))
    assert df.dtypes == [("id", "bigint"), ("text", "string")]
    assert df.where("text = 'line one\nline, two'").count() == 400
    assert csvscan._lines(small_splits, str(path)).rdd.getNumPartitions() > 20


def test_files_without_line_breaks_move_no_line(small_splits, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("id,text\n" + "".join(f'{i},"a, b ""c"""\n' for i in range(300)))
    lines = csvscan._lines(small_splits, str(path))
    assert lines.join(csvscan._splits(lines), ["file", "split"]).where("mixed").count() == 0
    assert tables.read_table(small_splits, str(path)).where("text = 'a, b \"c\"'").count() == 300


def test_open_quote_is_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('id,text\n1,"never closed\n2,x\n')
    with pytest.raises(csvscan.UnclosedQuoteError, match="bad.csv"):
        csvscan.scan_csv(spark, str(path))


def test_schema_blank_lines_and_ragged_records(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('id,v,w\n1,2.5,"x"\n\n   \n2\n3,4,y,extra\n')
    out = csvscan.scan_csv(spark, str(path), "id int, v double, w string").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 2.5, "x"), (2, None, None), (3, 4.0, "y")]
    assert csvscan.scan_csv(spark, str(path)).count() == 3


def test_header_only_and_headers_with_line_breaks(spark, tmp_path):
    (tmp_path / "h.csv").write_text('id,"two\nlines"\n')
    df = csvscan.scan_csv(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["id", "two\nlines"] and df.count() == 0
    (tmp_path / "g.csv").write_text('id,"two\nlines"\n7,"a\nb"\n')
    assert [tuple(r) for r in csvscan.scan_csv(spark, str(tmp_path / "g.csv")).collect()] == [("7", "a\nb")]


def test_other_readers_stay(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('id,size\n1,5" pipe\n2,plain\n')
    assert tables.read_table(spark, str(path), multi_line=True).count() == 2
    assert tables.read_table(spark, str(path), multi_line=False).count() == 2
