import uuid

import pandas as pd
import pytest
from conftest import indexed, rows, walk
from pyspark.sql import functions as F

from candlewright.operators import funnel
from candlewright.operators import studies as st
from candlewright.operators.risk import RiskRules
from candlewright.plans import outputs
from candlewright.plans.strategy import Strategy, run_strategy, trades_of
from candlewright.session import stage
from candlewright.sources import bars as sinks
from candlewright.sources.block_store import store_blocks, stored_bars, studies_on_blocks

def studies():
    return [st.ma_slope_gate(10, base=st.moving_average("SMA", 16)), st.roc(), st.cci()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    bars = indexed(spark, walk("A", 500, seed=1), walk("B", 90, seed=2), walk("C", 1, seed=3))
    name = f"blocks_{uuid.uuid4().hex}"
    store_blocks(bars, name, str(tmp_path_factory.mktemp("blocks") / "t"), 40, 4, block_rows=64)
    yield bars, name
    spark.sql(f"DROP TABLE {name}")


def test_stored_blocks_give_the_same_studies_without_an_exchange(spark, stored):
    bars, name = stored
    got = studies_on_blocks(spark, name, *studies())
    assert "Window" in plan(got) and "Exchange" not in plan(got)
    want = st.run_studies(bars, *studies())
    assert "Exchange" in plan(want)
    columns = ["symbol", "bar_no", "roc", "cci", *(f"{s.name}_{side}" for s in studies() for side in ("long", "short"))]
    pd.testing.assert_frame_equal(rows(got.select(*columns)), rows(want.select(*columns)))
    pd.testing.assert_frame_equal(rows(stored_bars(spark, name).select(*bars.columns)), rows(bars))


def test_stored_blocks_are_filtered_in_the_scan(spark, stored):
    bars, name = stored
    got = studies_on_blocks(spark, name, st.roc(), symbols=["A", "C"], start="2024-01-05 03:00:00", end="2024-01-09 00:00:00")
    pushed = plan(got).split("PushedFilters")[1]
    assert "symbol" in pushed and "LessThanOrEqual(ts_utc" in pushed and "Exchange" not in plan(got)
    want = st.run_studies(bars, st.roc()).where("symbol <> 'B'").where(F.col("ts_utc").between("2024-01-05 03:00:00", "2024-01-09 00:00:00"))
    columns = ["symbol", "bar_no", "roc", "roc_long"]
    assert got.count() > 50
    pd.testing.assert_frame_equal(rows(got.select(*columns)), rows(want.select(*columns)))


def test_stored_blocks_refuse_what_they_cannot_answer(spark, stored):
    for study in (st.roc(60), st.atr()):
        with pytest.raises(ValueError):
            studies_on_blocks(spark, stored[1], study)


def test_csv_folders_are_pruned(spark, tmp_path):
    bars = indexed(spark, walk("A", 50), walk("7", 30, seed=2))
    sinks.write_bars(bars, str(tmp_path / "c"), "csv")
    back = sinks.read_bars_csv_folder(spark, str(tmp_path / "c"))
    got = back.where("symbol = '7'")
    assert "PartitionFilters: [isnotnull(symbol" in plan(got) and got.count() == 30
    assert rows(back, "symbol", "ts_utc")["close"].tolist() == rows(bars, "symbol", "ts_utc")["close"].round(6).tolist()


@pytest.fixture(scope="module")
def result(spark):
    cfg = Strategy(htf_seconds=14_400, rules=RiskRules(limit=0.2))
    return cfg, stage(run_strategy(indexed(spark, walk("A", 24 * 40, seed=5), walk("B", 24 * 30, seed=6)), cfg), "run")


def test_outputs_of_a_run(spark, result, tmp_path):
    cfg, frame = result
    base = str(tmp_path)
    run = outputs.write_run(frame, cfg, base)
    assert outputs.committed_runs(spark, base) == [run]
    whole = funnel.flow_rows(frame.agg(*funnel.flow_columns()), ())
    assert outputs.run_funnel(spark, base, run).collect() == whole.collect()
    totals = outputs.run_totals(spark, base, run)
    assert totals["bars"] == frame.count() and totals["buy"] + totals["sell"] == frame.where("sig_raw IS NOT NULL").count()
    assert totals["first_ts"] == "2024-01-01 00:00:00"
    assert outputs.read_output(spark, base, run, "bars").count() == frame.count()
    got = outputs.read_output(spark, base, run, "trades")
    pd.testing.assert_frame_equal(rows(got, "symbol", "ts"), rows(trades_of(frame).select(got.columns), "symbol", "ts"))
    signals = outputs.read_output(spark, base, run, "signals")
    assert signals.where("we_buy").count() == totals["buy"] and signals.where("we_sell").count() == totals["sell"]
    assert outputs.read_output(spark, base, run, "report").count() == 2
    with pytest.raises(ValueError):
        outputs.write_run(frame, cfg, base, run)
    with pytest.raises(ValueError):
        outputs.read_output(spark, base, run, "other")


def test_a_run_that_fails_is_never_seen(spark, result, tmp_path, monkeypatch):
    cfg, frame = result
    base = str(tmp_path)
    assert outputs.committed_runs(spark, base) == outputs.discard(spark, base) == []
    whole = outputs.write_run(frame, cfg, base, "first")

    def fail(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(outputs.sinks, "write_report", fail)
        with pytest.raises(RuntimeError):
            outputs.write_run(frame, cfg, base, "second")
    assert (tmp_path / "run=second/trades").exists() and outputs.committed_runs(spark, base) == [whole]
    with pytest.raises(ValueError):
        outputs.read_output(spark, base, "second", "trades")
    outputs.write_run(frame, cfg, base, "second")                   # the same id again, over what was left
    assert outputs.committed_runs(spark, base) == ["first", "second"]
    (tmp_path / "run=third").mkdir()
    assert outputs.discard(spark, base) == ["third"] and not (tmp_path / "run=third").exists()
    assert outputs.read_output(spark, base, "second", "report").count() == 2
