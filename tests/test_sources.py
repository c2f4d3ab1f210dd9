import json
import lzma
import struct
from pathlib import Path

import pandas as pd
import pytest
from conftest import frame, indexed, rows, walk
from pyspark.sql import functions as F

from candlewright.operators.bars import ticks_to_bars
from candlewright.operators.candles import add_trigger
from candlewright.operators.risk import RiskRules
from candlewright.plans.strategy import Strategy, indicator_report, run_strategy, strategy_report, trades_of
from candlewright.session import stage, staged_tables, staging_root
from candlewright.sources import bars as sinks
from candlewright.sources.coverage import coverage, delta_hours, missing_hours, present_hours
from candlewright.sources.ticks import decode_files, load_ticks, read_ticks, rejects, tick_files


def put(root, symbol, day, hour, records, tail=b"", raw=None):
    folder = root / symbol / day
    folder.mkdir(parents=True, exist_ok=True)
    body = b"".join(struct.pack(">Iiiii", *r) for r in records) + tail
    data = raw if raw is not None else lzma.compress(body, format=lzma.FORMAT_ALONE)
    (folder / f"{hour:02d}h_ticks.bi5").write_bytes(data)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("ticks")
    put(root, "EURUSD", "2025/10/26", 0, [(1000, 110010, 110000, 5, -7), (1000, 110011, 110001, 1, 1), (1000, 110012, 110000, 9, 9)])
    put(root, "EURUSD", "2025/10/26", 1, [(59_999, 110050, 110040, 2, 2)], tail=b"\x00" * 7)
    put(root, "EURUSD", "2025/10/26", 2, [], raw=b"not lzma at all")
    put(root, "EURUSD", "2025/10/26", 3, [], raw=b"")
    put(root, "XAUUSD", "2025/10/26", 5, [(0, 2_000_100, 2_000_000, 1, 2), (3_599_999, 2_100_100, 2_100_000, 1, 2)])
    return root


def test_decode(spark, tree):
    got = rows(read_ticks(spark, str(tree)), "symbol", "ts", "seq")
    assert len(got) == 6
    assert got["price"].tolist() == [1.1, 1.10001, 1.1, 1.1004, 2000.0, 2100.0]
    assert got["volume"].tolist() == [2.0, 2.0, 18.0, 4.0, 3.0, 3.0]
    assert str(got["ts"].iloc[5]) == "2025-10-26 05:59:59.999000"


def test_rejects_are_reported(spark, tree):
    bad = rejects(decode_files(tick_files(spark, str(tree)))).toPandas()
    assert [p[-13:-10] for p in bad["path"]] == ["02h"]         # Spark does not list empty files


def test_fold_hours_stay_apart_in_bars(spark, tree):
    got = rows(ticks_to_bars(read_ticks(spark, str(tree)), 3600, "Europe/Berlin").where("symbol = 'EURUSD'"), "ts_utc")
    assert got["ts"].astype(str).tolist() == ["2025-10-26 02:00:00"] * 2
    assert got.loc[0, ["open", "close", "volume"]].tolist() == [1.10001, 1.1, 20.0]


def test_float_volumes(spark, tmp_path):
    word = struct.unpack(">i", struct.pack(">f", 1.5))[0]
    put(tmp_path, "EURUSD", "2024/01/02", 7, [(0, 1, 1, word, word)])
    assert read_ticks(spark, str(tmp_path), "float32").first().volume == 3.0


def test_coverage(spark, tree):
    hours = stage(present_hours(tick_files(spark, str(tree)).drop("content")), "hours")
    got = rows(coverage(hours), "symbol")
    assert got["hours"].tolist() == [3, 1]          # the empty file does not count
    missing = rows(missing_hours(hours, "2025-10-26 00:00:00", "2025-10-26 04:00:00"), "symbol", "hour_ts")
    assert [str(t)[11:13] for t in missing[missing["symbol"] == "EURUSD"]["hour_ts"]] == ["03", "04"]
    delta = rows(delta_hours(hours, "2025-10-26 07:40:00"), "symbol", "hour_ts")
    assert [str(t)[11:13] for t in delta[delta["symbol"] == "EURUSD"]["hour_ts"]] == ["03", "04", "05", "06"]
    late = delta_hours(hours, "2027-10-26 07:40:00").toPandas()
    assert not late["refused"].any() and len(late) > 2 * 365 * 24
    refused = delta_hours(hours, "2027-10-26 07:40:00", max_days=365).toPandas()
    assert refused["refused"].all() and refused["hour_ts"].isna().all()


def test_bar_files(spark, tmp_path):
    pdf = walk("A", 50)
    bars = frame(spark, pd.concat([pdf, walk("B", 50, seed=2)]))
    for name, folders, in_folders, in_scan in (
            ("d", ("trade_date",), "PartitionFilters: [isnotnull(trade_date", "EqualTo(symbol,A)"),
            ("s", ("symbol", "trade_date"), "PartitionFilters: [isnotnull(symbol", "GreaterThan(close,0.0)")):
        sinks.write_bars(bars, str(tmp_path / name), partition_by=folders)
        back = sinks.read_bars(spark, str(tmp_path / name))
        pd.testing.assert_frame_equal(rows(back.select(bars.columns), "symbol", "ts_utc"), rows(bars, "symbol", "ts_utc"))
        pruned = back.where((F.col("symbol") == "A") & (F.col("trade_date") == F.lit("2024-01-02").cast("date")) & (F.col("close") > 0))
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert in_folders in plan and in_scan in plan.split("PushedFilters")[1]
    sinks.write_bars(bars, str(tmp_path / "c"), "csv")
    text = next((tmp_path / "c" / "symbol=A").glob("*.csv")).read_text().splitlines()
    assert text[0] == "timestamp,open,high,low,close,volume" and len(text[1].split(",")[1].split(".")[1]) == 6
    again = rows(sinks.read_bars_csv(spark, str(tmp_path / "c" / "symbol=A"), "A"), "ts_utc")
    assert again["close"].round(6).tolist() == pdf["close"].round(6).tolist()
    assert sinks.bar_file_name("A", "1min", "2024-01-01", "2024-02-01") == "A_1min_20240101_20240201"


def test_csv_header_case(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Timestamp,Open,HIGH,low,Close,Volume\n2024-01-01 00:01:00,1,2,0.5,1.5,10\n")
    row = sinks.read_bars_csv(spark, str(tmp_path / "x.csv"), "Z").first()
    assert (row.symbol, row.high, str(row.ts)) == ("Z", 2.0, "2024-01-01 00:01:00")


def test_reports(spark, tmp_path):
    bars = indexed(spark, walk("A", 24 * 40, seed=5), walk("B", 24 * 30, seed=6))
    cfg = Strategy(htf_seconds=14400, rules=RiskRules(limit=0.2, allow_exceed=True))
    result = stage(run_strategy(bars, cfg), "run")
    sinks.write_report(strategy_report(result, cfg), str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["symbol"] for x in lines} == {"A", "B"}
    for x in lines:
        flow = x["signal_flow"]
        assert [s["stage"] for s in flow] == ["raw", "time", "rsi", "risk"]
        assert flow[0]["total"] >= flow[1]["total"] >= flow[2]["total"] >= flow[3]["total"] == x["performance"]["total_trades"]
        assert len(x["theoretical_scenarios"]) == 4 and len(x["buy_samples"]) <= 10
    sinks.write_trades(trades_of(result), str(tmp_path / "t"))
    head = next((tmp_path / "t").glob("*.csv")).read_text().splitlines()[0]
    assert head == "symbol,ts,signal,entry,sl,tp,sl_distance,tp_distance,comment"
    signals = add_trigger(bars, 14400)
    sinks.write_signals(signals.drop("volume"), str(tmp_path / "s"))
    head = next((tmp_path / "s").glob("*.csv")).read_text().splitlines()[0]
    assert head == "symbol,ts,open,high,low,close,candle_type,we_buy,we_sell"
    nested = indicator_report(signals).where("symbol = 'A'").first()
    assert nested.execution.total == nested.signal_analysis.total and nested.candle_distribution.unclassified == 1


def test_load_ticks_gives_both_outputs_and_staging_is_removed(spark, tree):
    with staged_tables(spark) as folder:
        got = load_ticks(spark, str(tree))
        assert Path(folder.removeprefix("file:")).exists()
        assert got.ticks.count() == read_ticks(spark, str(tree)).count()
        assert got.rejects.count() == rejects(decode_files(tick_files(spark, str(tree)))).distinct().count() > 0
    assert not Path(folder.removeprefix("file:")).exists() and staging_root(spark) != folder
