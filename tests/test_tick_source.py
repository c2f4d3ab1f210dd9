import datetime as dt

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringContains
from test_sources import put

from candlewright.sources import tick_source
from candlewright.sources.tick_source import TickReader, TickStreamReader, Wanted, apart, list_files, split, tick_stream, tick_table, write_tick_files
from candlewright.sources.ticks import read_ticks, tick_files
from candlewright.streaming.runs import write_available

TICK = ["symbol", "ts", "seq", "price", "volume"]


def tree(tmp_path, symbols=("EURUSD", "USDJPY", "XAUUSD"), days=(30, 31), hours=range(0, 24, 3)):
    for k, symbol in enumerate(symbols):
        for day in days:
            for h in hours:
                put(tmp_path, symbol, f"2024/01/{day}", h, [(m * 1000, 100_000 + m, 100_000 + m + k, 1, m) for m in range(5)])
    return str(tmp_path)


def same_ticks(got, want):
    pd.testing.assert_frame_equal(rows(got.select(*TICK), "symbol", "ts", "seq"), rows(want.select(*TICK), "symbol", "ts", "seq"))


def test_the_source_equals_the_scan_of_all_files(spark, tmp_path):
    root = tree(tmp_path)
    put(tmp_path, "EURUSD", "2024/02/01", 0, [(1, 2, 3, 4, 5)], tail=b"\0" * 7)
    put(tmp_path, "EURUSD", "2024/02/01", 1, [], raw=b"damaged")
    put(tmp_path, "EURUSD", "2024/02/01", 2, [], raw=b"")
    (tmp_path / "EURUSD/2024/02/01/24h_ticks.bi5").write_bytes(b"no hour")
    (tmp_path / "EURUSD/2024/02/30").mkdir()
    (tmp_path / "notes").mkdir()
    read = apart(tick_table(spark, root))
    same_ticks(read.ticks, read_ticks(spark, root))
    assert sorted(r.path[-15:] for r in read.rejects.collect()) == ["1/01h_ticks.bi5", "1/02h_ticks.bi5"]


def opened(monkeypatch, reader, filters):
    """Files that a reader opens and folders it lists, for pushed conditions."""
    listed = []
    select = tick_source.fs.FileSelector
    monkeypatch.setattr(tick_source.fs, "FileSelector", lambda p: listed.append(p) or select(p))
    assert list(reader.pushFilters(filters)) == filters                 # Spark applies them to the rows as well
    files = [f for p in reader.partitions() for f in p.files]
    monkeypatch.undo()
    return files, listed


def test_conditions_decide_what_is_listed_and_opened(tmp_path, monkeypatch):
    root = tree(tmp_path)
    day = [GreaterThanOrEqual(("ts",), dt.datetime(2024, 1, 30, 6)), LessThan(("ts",), dt.datetime(2024, 1, 30, 12))]
    files, listed = opened(monkeypatch, TickReader({"path": root}), [EqualTo(("symbol",), "EURUSD"), *day])
    assert [(f.symbol, f.hour.day, f.hour.hour) for f in files] == [("EURUSD", 30, 6), ("EURUSD", 30, 9)]
    assert len(listed) == 5 and not any("USDJPY" in p or "/31" in p for p in listed)
    files, _ = opened(monkeypatch, TickReader({"path": root}), [In(("symbol",), ("XAUUSD", "none")), EqualTo(("hour_ts",), dt.datetime(2024, 1, 31, 3))])
    assert [(f.symbol, f.hour.hour) for f in files] == [("XAUUSD", 3)]
    files, _ = opened(monkeypatch, TickReader({"path": root}), [GreaterThan(("ts",), dt.datetime(2024, 1, 31, 21, 0, 4)), LessThanOrEqual(("hour_ts",), dt.datetime(2024, 1, 31, 21))])
    assert len(files) == 3
    files, listed = opened(monkeypatch, TickReader({"path": root}), [EqualTo(("symbol",), "EURUSD"), EqualTo(("symbol",), "USDJPY")])
    assert files == [] and listed == []
    files, _ = opened(monkeypatch, TickReader({"path": root}), [StringContains(("symbol",), "EUR"), EqualTo(("price",), 1.0)])
    assert len(files) == 48
    files, _ = opened(monkeypatch, TickReader({"path": root, "symbols": "usdjpy", "start": "2024-01-31", "end": "2024-01-31 05:00:00"}), [])
    assert [(f.symbol, f.hour.hour) for f in files] == [("USDJPY", 0), ("USDJPY", 3)]


def test_spark_pushes_the_conditions(spark, tmp_path):
    """Files outside are damaged after the plan is made, so that opening one would show."""
    root = tree(tmp_path)
    for path in tmp_path.rglob("*.bi5"):
        if "USDJPY/2024/01/31" not in str(path):
            path.write_bytes(b"damaged")
    got = tick_table(spark, root).where(
        (F.col("symbol") == "USDJPY") & (F.col("hour_ts") >= F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")))
    assert got.where("error IS NOT NULL").count() == 0 and got.count() == 40
    assert set(tick_table(spark, root).where("symbol IN ('XAUUSD', 'EURUSD')").where("error IS NULL").collect()) == set()


def test_partitions_are_of_even_size(tmp_path):
    files = list_files(tree(tmp_path), Wanted())
    sizes = [sum(f.size for f in p.files) for p in split(files, 0.0005)]
    assert [f for p in split(files, 0.0005) for f in p.files] == files
    assert len(sizes) > 3 and all(s <= 500 for s in sizes) and min(sizes[:-1]) > 300
    assert [len(p.files) for p in split(files, 0)] == [1] * 48 and split([], 1) == []


def test_stream_takes_new_late_and_changed_files_once(spark, tmp_path):
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    tree(raw, ("EURUSD",), (30,))
    def run():
        write_available(apart(tick_stream(spark, str(raw), settleSeconds="0")).ticks, out, check)
        return spark.read.parquet(out)
    same_ticks(run(), read_ticks(spark, str(raw)))
    assert run().count() == 40                                          # nothing new
    put(raw, "EURUSD", "2024/01/02", 4, [(7, 1, 2, 3, 4)])              # an old hour comes late
    put(raw, "EURUSD", "2024/01/30", 3, [(9, 1, 2, 3, 4), (10, 1, 2, 3, 4)])      # and one is replaced
    assert run().count() == 43
    reader = TickStreamReader({"path": str(raw), "settleseconds": "3600"})
    assert reader.latestOffset() == {"until": 0}                        # files must be old enough


def test_globs_prune_where_pyarrow_knows_no_file_system(spark, tmp_path):
    root = tree(tmp_path)
    some = tick_files(spark, root, symbols=["EURUSD", "XAUUSD", "NONE"], start="2024-01-31", end="2024-02-02")
    assert len(some.inputFiles()) == 16 and all("/01/31/" in f and "USDJPY" not in f for f in some.inputFiles())
    assert len(tick_files(spark, root, start="2024-01-30", end="2024-01-30").inputFiles()) == 24
    assert len(tick_files(spark, root, symbols=["EURUSD"]).inputFiles()) == 16


def test_written_files_come_back(spark, tmp_path):
    root = tree(tmp_path / "a")
    ticks = read_ticks(spark, root)
    write_tick_files(ticks, str(tmp_path / "b"))
    same_ticks(apart(tick_table(spark, f"file://{tmp_path}/b")).ticks, ticks)
    names = lambda k: sorted(str(p.relative_to(tmp_path / k)) for p in (tmp_path / k).rglob("*") if p.is_file())
    assert names("a") == names("b")
    write_tick_files(ticks.where("symbol = 'EURUSD'").withColumn("price", F.col("price") + 1), str(tmp_path / "b"))
    got = apart(tick_table(spark, f"{tmp_path}/b")).ticks
    assert got.count() == ticks.count() and got.where("symbol = 'EURUSD' AND price < 1.5").count() == 0
