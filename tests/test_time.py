import pytest
from pyspark.sql import functions as F

from candlewright.functions.columns import bucket_start, calendar_start, local_time
from candlewright.operators.bars import add_local_time
from candlewright.operators.sessions import Session, annotate_session, between, in_session, in_zone_session

DAY = Session.at("08:30", "20:30")


def times(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("clock, expected", [
    ("09:00", True), ("12:30", True), ("20:00", True), ("20:45", False), ("08:00", False), ("21:00", False),
    ("02:00", False), ("08:30", True), ("08:29", False), ("20:30", False), ("20:29", True)])
def test_session_table(spark, clock, expected):
    assert times(spark, f"2025-03-03 {clock}:00").select(in_session(DAY)).first()[0] is expected


def test_disabled_session_passes_everything(spark):
    off = Session(enabled=False)
    assert times(spark, "2025-03-03 02:00:00").where(in_session(off)).count() == 1


def test_start_not_before_end_is_an_error():
    with pytest.raises(ValueError):
        in_session(Session.at("20:30", "08:30"))


def test_overnight_zone_session(spark):
    night = Session.at("22:30", "06:30")
    df = times(spark, "2024-07-01 20:29:00", "2024-07-01 20:30:00", "2024-07-02 04:29:00", "2024-07-02 04:30:00")
    got = [r[0] for r in df.select(in_zone_session(night, "Europe/Paris", "ts")).collect()]
    assert got == [False, True, True, False]


def test_annotation(spark):
    row = annotate_session(times(spark, "2024-07-01 08:31:00"), DAY).first()
    assert (row.in_trading_hours, row.hour, row.minute, row.session_start, row.session_type) == (
        True, 8, 31, "08:30", "intraday")


def test_date_range_is_inclusive(spark):
    df = times(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01")
    assert df.where(between("2024-01-01", "2024-01-02 00:00:00")).count() == 2


def test_fold_keeps_two_keys_for_one_label(spark):
    bars = times(spark, "2025-10-26 00:30:00", "2025-10-26 01:30:00").select(
        F.lit("A").alias("symbol"), F.col("ts").alias("ts_utc"),
        *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")))
    got = add_local_time(bars, "Europe/Berlin").toPandas()
    assert got["ts_utc"].nunique() == 2 and set(got["ts"].astype(str)) == {"2025-10-26 02:30:00"}


def test_local_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = times(spark, "2024-03-10 07:30:00").select(
            local_time("ts", "Europe/Berlin").alias("b"), bucket_start("ts", 3600).alias("h"), calendar_start("ts", "week").alias("w"))
        assert [str(x) for x in df.first()] == ["2024-03-10 08:30:00", "2024-03-10 07:00:00", "2024-03-04 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_width_must_divide_a_day():
    with pytest.raises(ValueError):
        bucket_start("ts", 7 * 60)
