"""Bar CSV folders: layouts, any number of columns, quoting, rejects and the file report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import bar_csv, files, store

HEAD = "Date,Open,High,Low,Close,Volume\n"


def scan(spark, folder, texts, **options):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8")
    return bar_csv.scan(spark, str(folder), **options)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_number_and_order_of_columns(spark, tmp_path):
    wide = ",".join(f"x{i}" for i in range(300)) + ",volume,CLOSE , low,High,open,Datetime\n" + "," * 300 + "5,4,1,6,2,2020-01-01\n"
    got = scan(spark, tmp_path / "a", {"W.csv": wide})
    assert rows(got.bars.drop("seq")) == [("W", dt.date(2020, 1, 1), 2.0, 6.0, 1.0, 4.0, 5)]
    assert got.rejects.count() == 0


def test_quoted_cells_byte_order_mark_and_line_ends(spark, tmp_path):
    text = '﻿"Date","Open","High, say","High","Low","Close","Volume"\r\n2020-01-02,"1,234.5","a ""b"", c",2000,1," 1500 ","1,000"\r\n\r\n'
    got = scan(spark, tmp_path / "a", {"Q.csv": text})
    assert rows(got.bars.drop("seq")) == [("Q", dt.date(2020, 1, 2), 1234.5, 2000.0, 1.0, 1500.0, 1000)]


@pytest.mark.parametrize("cell, row, reason", [
    ("date", "soon,1,2,0.5,1.5,9", "unreadable date"), ("date", ",1,2,0.5,1.5,9", None), ("open", "2020-01-01,,2,0.5,1.5,9", "no open"),
    ("high", "2020-01-01,1,Infinity,0.5,1.5,9", "unreadable high"), ("low", "2020-01-01,1,2,x,1.5,9", "unreadable low"),
    ("close", "2020-01-01,1,2,0.5", "no close"), ("volume", "2020-01-01,1,2,0.5,1.5,NaN", "unreadable volume"),
    ("volume", "2020-01-01,1,2,0.5,1.5,1e40", "unreadable volume"), ("volume", "2020-01-01,1,2,0.5,1.5,", "no volume")])
def test_every_line_not_taken_has_its_reason(spark, tmp_path, cell, row, reason):
    got = scan(spark, tmp_path / "a", {"R.csv": HEAD + "2020-01-05,1,2,0.5,1.5,9.7\n" + row + "\n"})
    assert rows(got.bars.select("volume")) == [(9,)]
    assert rows(got.rejects.select("line", "reason")) == ([(row, reason)] if reason else [])
    report = got.files.first()
    assert (report["lines"], report["bars"], report["rejected"], report["layout"]) == (2, 1, int(bool(reason)), int(not reason))


def test_files_without_usable_header_are_reported(spark, tmp_path):
    texts = {"A.csv": HEAD + "2020-01-01,1,2,0.5,1.5,9\n", "B.csv": "2020-01-01,1,2,0.5,1.5,9\n", "C.csv": "Date,Open,High,Low,Adj Close,Volume\n2020-01-01,1,2,3,4,5\n",
             "D.csv": "", "E.csv": HEAD, "notes.txt": HEAD + "2020-01-01,1,2,0.5,1.5,9\n"}
    got = scan(spark, tmp_path / "a", texts)
    assert rows(got.files.select("symbol", "lines", "bars", F.coalesce("reason", F.lit("")))) == [
        ("A", 1, 1, ""), ("B", 1, 0, "no header"), ("C", 1, 0, "missing columns: close"), ("E", 0, 0, "")]
    few = scan(spark, tmp_path / "a", {}, min_rows=2)
    assert few.bars.count() == 0 and rows(few.files.where("symbol = 'A'").select("reason")) == [("fewer than 2 rows",)]


def test_every_line_is_counted_once_whatever_the_split(spark, tmp_path):
    body = "".join(f"2020-01-{1 + i % 28:02d},1,2,0.5,{'x' if i % 10 == 3 else i},7\n" for i in range(5000))
    texts = {f"S{k}.csv": HEAD + body for k in range(3)}
    whole = scan(spark, tmp_path / "a", texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = scan(spark, tmp_path / "a", {})
        assert split.bars.rdd.getNumPartitions() > 3 or split.bars.count()
        assert rows(split.files.drop("file")) == rows(whole.files.drop("file")) == [(f"S{k}", 5000, 4500, 500, 0, None) for k in range(3)]
        newest = files.read_bars_csv(spark, str(tmp_path / "a")).where("symbol = 'S1' AND date = DATE '2020-01-05'").first()
        assert newest["close"] == max(i for i in range(5000) if i % 28 == 4 and i % 10 != 3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_is_read_back(spark, tmp_path, make_bars):
    bars = make_bars({"A&B": [1.5, 2.25], "C D": [0.1 + 0.2], "E/F": [3.0]})
    store.export_csv(bars, str(tmp_path / "out"))
    assert rows(files.read_bars_csv(spark, str(tmp_path / "out")).select(*bars.columns)) == rows(bars)


def test_the_scan_reads_lines_once_and_uses_no_python(spark, tmp_path):
    got = scan(spark, tmp_path / "a", {"A.csv": HEAD + "2020-01-01,1,2,0.5,1.5,9\n"})
    plan = got.bars._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_small_files_are_judged_without_a_shuffle(spark, tmp_path):
    got = scan(spark, tmp_path / "a", {f"S{k}.csv": HEAD + "2020-01-01,1,2,0.5,1.5,9\n2020-01-02,x,2,0.5,1.5,9\n" * 3 for k in range(3)}, min_rows=2)
    for frame, n in ((got.bars, 9), (got.rejects, 9), (got.files, 3)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert frame.count() == n


def test_whole_compressed_and_split_files_are_judged_alike(spark, tmp_path, monkeypatch):
    import gzip

    text = "notes, about price\r\n\r\n" + HEAD + '2020-01-01,1,2,0.5,"1,500",9\r,,,,,\n 2020-01-02,1,2,0.5,1.5\n\n2020-01-03,1,2,0.5,1.5,9'
    folder = tmp_path / "a"
    scan(spark, folder, {"A.csv": text, "B.csv": "\n \n", "C.csv": "no header\n"})
    with gzip.open(folder / "Z.csv.gz", "wb") as f:
        f.write(text.encode())

    def seen(got):
        return (rows(got.bars.drop("seq")), rows(got.rejects.select("symbol", "line", "reason")),
                sorted((tuple(r) for r in got.files.drop("file").collect()), key=str))

    whole = seen(bar_csv.scan(spark, str(folder), glob="*", min_rows=1))
    monkeypatch.setattr(bar_csv, "WHOLE_BYTES", -1)
    split = seen(bar_csv.scan(spark, str(folder), glob="*", min_rows=1))
    assert whole == split and {s for s, *_ in whole[2]} == {"A", "C", "Z"} and len(whole[0]) > 0
