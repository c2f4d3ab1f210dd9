import pandas as pd
import pytest
from conftest import rows
from test_sources import put

from candlewright.session import stage
from candlewright.sources import ledger as books
from candlewright.sources.coverage import coverage
from candlewright.sources.ticks import read_ticks

TICK = ["symbol", "ts", "seq", "price", "volume"]


def hour(n, price=100_000):
    return [(m * 1000, price + m, price + m, 1, m) for m in range(n)]


def check(spark, raw, base):
    """The taken ticks are those of a fresh scan."""
    got, want = books.taken_ticks(spark, base).select(*TICK), read_ticks(spark, str(raw)).select(*TICK)
    pd.testing.assert_frame_equal(rows(got, "symbol", "ts", "seq"), rows(want, "symbol", "ts", "seq"))


def test_files_are_taken_once_and_again_when_they_change(spark, tmp_path, monkeypatch):
    raw, base = tmp_path / "raw", str(tmp_path / "base")
    for h in range(3):
        put(raw, "EURUSD", "2024/01/02", h, hour(5))
    put(raw, "EURUSD", "2024/01/02", 3, [], raw=b"damaged")
    first = books.take_new(spark, str(raw), base)
    assert first[0] == 1 and first[2:] == (4, 1, 15)
    check(spark, raw, base)
    assert [r.path[-15:] for r in books.taken_rejects(spark, base).collect()] == ["2/03h_ticks.bi5"]

    def refuse(*_):
        raise AssertionError("nothing to decode")
    with monkeypatch.context() as m:
        m.setattr(books, "decode_files", refuse)
        assert books.take_new(spark, str(raw), base)[2:] == (0, 0, 0)
    put(raw, "EURUSD", "2024/01/02", 3, hour(4))                    # the damaged one is mended
    put(raw, "EURUSD", "2024/01/02", 1, hour(7))                    # one is replaced, and two are new
    put(raw, "EURUSD", "2023/12/31", 23, hour(2))
    put(raw, "EURJPY", "2024/01/02", 1, hour(2))
    assert books.take_new(spark, str(raw), base)[2:] == (4, 0, 15)
    check(spark, raw, base)
    assert books.taken_rejects(spark, base).count() == 0
    assert books.ledger(spark, base).count() == 8 and books.current(books.ledger(spark, base)).count() == 6
    got = {r.symbol: (str(r.last_hour), r.hours) for r in coverage(books.taken_hours(spark, base)).collect()}
    assert got == {"EURUSD": ("2024-01-02 03:00:00", 5), "EURJPY": ("2024-01-02 01:00:00", 1)}


def test_a_run_that_fails_before_its_rows_are_in_leaves_nothing(spark, tmp_path, monkeypatch):
    raw, base = tmp_path / "raw", str(tmp_path / "base")
    put(raw, "EURUSD", "2024/01/02", 0, hour(5))
    books.take_new(spark, str(raw), base)
    put(raw, "EURUSD", "2024/01/02", 1, hour(6))
    with monkeypatch.context() as m:
        m.setattr(books, "_records", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            books.take_new(spark, str(raw), base)
    assert len(list((tmp_path / "base/records").iterdir())) == 2    # its records are there, but no rows
    assert books.taken_ticks(spark, base).count() == 5
    assert books.take_new(spark, str(raw), base)[2:] == (1, 0, 6)
    check(spark, raw, base)


def test_only_files_asked_for_are_opened(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path / "base")
    for symbol in ("EURUSD", "USDJPY"):
        for day in ("2024/01/02", "2024/01/03"):
            put(raw, symbol, day, 0, hour(3))
    assert books.take_new(spark, str(raw), base, symbols=["EURUSD"], start="2024-01-03", end="2024-01-03")[2:] == (1, 0, 3)
    assert sorted(r.symbol + str(r.hour_ts) for r in books.ledger(spark, base).collect()) == ["EURUSD2024-01-03 00:00:00"]
    assert books.take_new(spark, str(raw), base)[2:] == (3, 0, 9)
    put(raw, "USDJPY", "2024/01/03", 5, hour(1))
    listed = stage(books.new_files(spark, str(raw), base).select("path", "length", "modificationTime"), "listed")
    opened = [f for f in books._only(spark, listed).inputFiles() if f.endswith(".bi5")]
    assert len(opened) == 2 and all("USDJPY/2024/01/03" in f for f in opened)


def test_an_empty_ledger(spark, tmp_path):
    base = str(tmp_path / "base")
    assert books.taken_ticks(spark, base).count() == books.taken_hours(spark, base).count() == books.ledger(spark, base).count() == 0
