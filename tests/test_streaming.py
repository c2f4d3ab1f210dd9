import pandas as pd
import pytest
from conftest import indexed, rows, walk
from pyspark.sql import types as T
from test_sources import put

from candlewright.operators.bars import ticks_to_bars
from candlewright.operators.structure import add_supertrend, add_zigzag
from candlewright.schema import BARS, TICKS
from candlewright.sources.ticks import read_ticks, rejects
from candlewright.streaming.closing import close, open_closing
from candlewright.streaming.maintained import maintain_bars, maintained_bars, stored_ticks, take_batch, touched_ticks
from candlewright.streaming.runs import late_rows, write_available
from candlewright.streaming.structure import stream_supertrend, stream_zigzag
from candlewright.streaming.tick_bars import stream_bars, stream_records, stream_tick_files
from candlewright.streaming.watch import watch

BAR = ["symbol", "ts_utc", "open", "high", "low", "close", "volume"]


def hour(h, base):
    return [(m * 60_000 + 500 * (m % 3), base + m, base - m, 3, m) for m in range(60)] + [(1_800_000, base, base - 30, 50, 0)]


def emitted(spark, path):
    return rows(spark.read.parquet(path).select(*BAR), "symbol", "ts_utc")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    for h in range(6):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 110_000 + h))
    write_available(stream_bars(stream_tick_files(spark, str(raw)), 900, "1 hour"), out, check)
    first = emitted(spark, out)
    for h in range(6, 10):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 110_000 + h))
    write_available(stream_bars(stream_tick_files(spark, str(raw)), 900, "1 hour"), out, check)
    got = emitted(spark, out)
    assert 0 < len(first) < len(got) and not got.duplicated(["symbol", "ts_utc"]).any()
    batch = rows(ticks_to_bars(read_ticks(spark, str(raw)), 900).select(*BAR), "symbol", "ts_utc")
    pd.testing.assert_frame_equal(got, batch.head(len(got)))
    assert len(batch) - len(got) <= 5            # only windows the watermark has not passed


def test_late_ticks_are_dropped_and_counted(spark, tmp_path):
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    for h in (5, 6, 7):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 110_000))
    write_available(stream_bars(stream_tick_files(spark, str(raw)), 900, "10 minutes"), out, check)
    before = emitted(spark, out)
    put(raw, "EURUSD", "2024/01/02", 1, hour(1, 90_000))
    query = write_available(stream_bars(stream_tick_files(spark, str(raw)), 900, "10 minutes"), out, check)
    assert late_rows(query) > 0
    pd.testing.assert_frame_equal(emitted(spark, out), before)


def test_late_counts_cover_all_batches_and_rejects_stream(spark, tmp_path):
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    for h in (20, 21, 22, 23):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 110_000))
    write_available(stream_bars(stream_tick_files(spark, str(raw)), 900, "10 minutes"), out, check)
    for h in range(8):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 90_000))
    (raw / "EURUSD/2024/01/02/09h_ticks.bi5").write_bytes(b"damaged")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        query = write_available(stream_bars(stream_tick_files(spark, str(raw), files_per_batch=1), 900, "10 minutes"), out, check)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    kept = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert late_rows(query) > kept
    refused = str(tmp_path / "refused")
    write_available(rejects(stream_records(spark, str(raw))), refused, str(tmp_path / "check2"))
    assert [r.path[-31:] for r in spark.read.parquet(refused).collect()] == ["EURUSD/2024/01/02/09h_ticks.bi5"]


# --- closing, late ticks, state machines --------------------------------------------------

def dropped(path, pdf, name):
    """One file of bars arrives."""
    path.mkdir(parents=True, exist_ok=True)
    pdf.to_parquet(path / f"{name}.parquet", index=False, coerce_timestamps="us")


def test_a_closing_row_drains_open_windows_and_ends_the_stream(spark, tmp_path):
    raw, out, check = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "check")
    closing = open_closing(spark, TICKS, str(tmp_path / "closing"))
    stream = lambda: stream_bars(stream_tick_files(spark, str(raw)).select(*TICKS.fieldNames()), 900, "2 hours", closing)
    for h in range(4):
        put(raw, "EURUSD", "2024/01/02", h, hour(h, 110_000 + h))
    write_available(stream(), out, check)
    batch = rows(ticks_to_bars(read_ticks(spark, str(raw)), 900).select(*BAR), "symbol", "ts_utc")
    assert 0 < len(emitted(spark, out)) < len(batch)
    close(spark, TICKS, "ts", closing)
    write_available(stream(), out, check)
    pd.testing.assert_frame_equal(emitted(spark, out), batch)
    put(raw, "EURUSD", "2024/01/02", 9, hour(9, 110_000))          # after the end all is late
    close(spark, TICKS, "ts", closing)
    assert late_rows(write_available(stream(), out, check)) > 0
    pd.testing.assert_frame_equal(emitted(spark, out), batch)


def test_late_ticks_replace_the_bars_of_their_slots_only(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path / "base")
    run = lambda: maintain_bars(stream_tick_files(spark, str(raw)), base, 900)
    for day in (2, 3, 4):
        put(raw, "EURUSD", f"2024/01/0{day}", 7, hour(7, 110_000 + day))
    run()
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "base/bars").rglob("*.parquet")}
    put(raw, "EURUSD", "2024/01/03", 7 + 1, hour(8, 90_000))
    put(raw, "EURJPY", "2024/01/03", 7, hour(7, 90_000))
    put(raw, "EURUSD", "2024/01/03", 2, [(5, 1, 2, 3, 4)])
    run()
    kept = {f: t for f, t in files.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert {f.parent.name for f in kept} == {"slot=19724", "slot=19726"} and len(files) == 3
    batch = ticks_to_bars(read_ticks(spark, str(raw)), 900)
    pd.testing.assert_frame_equal(rows(maintained_bars(spark, base).select(*BAR), "symbol", "ts_utc"), rows(batch.select(*BAR), "symbol", "ts_utc"))
    run()                                                           # nothing new
    assert maintained_bars(spark, base).count() == batch.count()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    put(tmp_path / "raw", "EURUSD", "2024/01/02", 7, hour(7, 110_000))
    ticks = read_ticks(spark, str(tmp_path / "raw"))
    for batch_id in (0, 0, 1):
        take_batch(ticks, batch_id, base, 900, "UTC", 86_400)
        assert stored_ticks(spark, base).count() == ticks.count() * (batch_id + 1)
        pd.testing.assert_frame_equal(
            rows(maintained_bars(spark, base).select(*BAR), "symbol", "ts_utc"), rows(ticks_to_bars(ticks, 900).select(*BAR), "symbol", "ts_utc"))


def test_only_touched_folders_of_ticks_are_read(spark, tmp_path):
    for batch_id, day in enumerate((2, 3, 4)):
        put(tmp_path / f"raw{day}", "EURUSD", f"2024/01/0{day}", 7, hour(7, 110_000))
        take_batch(read_ticks(spark, str(tmp_path / f"raw{day}")), batch_id, str(tmp_path), 900, "UTC", 86_400)
    plan = touched_ticks(spark, str(tmp_path), 1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def streamed(spark, source, out, check, closing, stream):
    bars = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(source))
    write_available(stream(bars, closing), out, check)
    return spark.read.parquet(out).toPandas().sort_values(["symbol", "ts_utc"], ignore_index=True)


@pytest.mark.parametrize("kind", ["zigzag", "supertrend"])
def test_state_machines_equal_the_batch_also_after_a_restart(spark, tmp_path, kind):
    bars = pd.concat([walk("A", 400, seed=1), walk("B", 250, seed=2), walk("C", 1, seed=3)], ignore_index=True)
    bars.loc[[5, 77, 401], ["high", "low", "close"]] = None
    source, out, check = tmp_path / "bars", str(tmp_path / "out"), str(tmp_path / "check")
    closing = open_closing(spark, T.StructType([BARS["symbol"], BARS["ts_utc"], *(BARS[c] for c in ("high", "low", "close"))]), str(tmp_path / "closing"))
    if kind == "zigzag":
        stream, batch = lambda b, c: stream_zigzag(b, 2.0, "1 day", c), lambda b: add_zigzag(b, 2.0)
        values = ["zz_trend", "zz_bias"]
    else:
        stream, batch = lambda b, c: stream_supertrend(b, 10, 1.5, "1 day", c), add_supertrend_15
        values = ["supertrend", "st_direction"]
    parts = [bars[bars["ts_utc"].dt.day <= 5], bars[bars["ts_utc"].dt.day > 5]]
    late = parts[0].sample(frac=1, random_state=1)                  # any order within a file
    dropped(source, late, "a")
    first = streamed(spark, source, out, check, closing, stream)
    dropped(source, parts[1].sample(frac=1, random_state=2), "b")
    second = streamed(spark, source, out, check, closing, stream)   # a new run resumes from the state store
    close(spark, spark.read.parquet(closing).schema, "ts_utc", closing)
    third = streamed(spark, source, out, check, closing, stream)
    want = rows(batch(indexed(spark, bars)).select("symbol", "ts_utc", *values), "symbol", "ts_utc")
    assert 0 < len(first) < len(second) < len(third) == len(want)
    pd.testing.assert_frame_equal(third, want, check_dtype=False)


def add_supertrend_15(bars):
    return add_supertrend(bars, 10, 1.5)


def test_gaps_silence_and_order_faults(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts_utc", T.TimestampNTZType()), T.StructField("seq", T.LongType())])
    closing = open_closing(spark, schema, str(tmp_path / "closing"))
    start = pd.Timestamp("2024-01-01")

    def arrive(name, **hours):
        rows_ = [(s, start + pd.Timedelta(hours=h), i) for s, hs in hours.items() for i, h in enumerate(hs)]
        dropped(source, pd.DataFrame(rows_, columns=["symbol", "ts_utc", "seq"]).sample(frac=1, random_state=0), name)
        stream = spark.readStream.schema(schema).parquet(str(source))
        write_available(watch(stream, 3600, 86_400, delay="5 hours", closing=closing), out, check)
        got = spark.read.parquet(out).toPandas()
        hour = lambda c: (got[c] - start) / pd.Timedelta(hours=1)
        return sorted((s, k, a, None if b != b else b) for s, k, a, b in zip(got["symbol"], got["kind"], hour("since"), hour("until")))

    got = arrive("a", A=[0, 1, 3, 2, 4], B=[0, 1], C=[10, 8, 9, 9])
    assert got == [("A", "order", 3, 2), ("C", "order", 10, 8)]
    got = arrive("b", A=[9, 12, 40])                                 # B is silent though no bar of its own comes
    assert got == [("A", "gap", 4, 9), ("A", "gap", 9, 12), ("A", "order", 3, 2), ("B", "silent", 1, None), ("C", "order", 10, 8), ("C", "silent", 10, None)]
    got = arrive("c", B=[41, 42], A=[41, 80])
    assert ("B", "gap", 1, 41) in got and ("A", "gap", 12, 40) in got and ("A", "silent", 12, None) not in got
    close(spark, schema, "ts_utc", closing)
    got = arrive("d", A=[0])
    assert [g for g in got if g[0] == "A" and g[1] != "order"] == [("A", "gap", 4, 9), ("A", "gap", 9, 12), ("A", "gap", 12, 40), ("A", "gap", 41, 80), ("A", "silent", 41, None), ("A", "silent", 80, None)]
    assert ("B", "silent", 42, None) in got and ("A", "order", 80, 0) not in got       # later than the delay
