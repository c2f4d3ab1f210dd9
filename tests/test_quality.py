import numpy as np
import pandas as pd
import pytest
from conftest import frame, indexed, walk
from pyspark.sql import functions as F

from candlewright.operators import quality as q
from candlewright.operators.quantiles import exact_quantiles
from candlewright.plans.validation import validate_bars


def clean(n=60, minutes=1):
    pdf = walk("A", n, minutes, scale=0.1)
    return pdf


def statuses(df):
    return {r["check"]: r["status"] for r in df.collect()}


def test_clean_data_passes_everything(spark):
    got = validate_bars(indexed(spark, clean()), 60, start="2024-01-01 00:00:00", end="2024-01-01 00:59:00")
    assert set(statuses(got).values()) == {"PASS"} and got.count() == 11
    row = q.overall_status(got).first()
    assert (row.status, row.usable) == ("PASS", True)


def fault(name):
    pdf = clean()
    if name == "missing_values":
        pdf.loc[5, "volume"] = None
    elif name == "duplicates":
        pdf = pd.concat([pdf, pdf.iloc[[5]]], ignore_index=True)
    elif name == "ohlc_consistency":
        pdf.loc[5, "close"] = pdf.loc[5, "high"] + 1
    elif name == "price_validation":
        pdf.loc[5, ["low", "open"]] = -1.0
    elif name == "price_changes":
        pdf.loc[20:, ["open", "high", "low", "close"]] += 10
    elif name == "gaps":
        pdf.loc[20:, ["ts", "ts_utc"]] += pd.Timedelta("3h")
    elif name == "indicator_compatibility":
        pdf = pdf.head(9)
    return pdf


@pytest.mark.parametrize("name, status", [
    ("missing_values", "WARNING"), ("duplicates", "WARNING"), ("ohlc_consistency", "FAIL"), ("price_validation", "FAIL"),
    ("price_changes", "INFO"), ("gaps", "INFO"), ("indicator_compatibility", "FAIL")])
def test_one_fault_at_a_time(spark, name, status):
    got = statuses(validate_bars(indexed(spark, fault(name)), 60))
    assert got.pop(name) == status
    assert set(got.values()) == {"PASS"}


def test_gaps_over_a_day_and_single_bar(spark):
    pdf = clean(30, 1440 * 3)
    row = q.run_checks(q.bar_profile(indexed(spark, pdf), 60), q.gaps()).first()
    assert row.status == "WARNING" and row.metrics["large_gaps"] == 29 and row.metrics["max_gap_seconds"] == 3 * 86400
    assert q.run_checks(q.bar_profile(indexed(spark, clean(1)), 60), q.gaps()).first().status == "SKIP"


def test_arrival_order_is_checked_before_sorting(spark):
    pdf = clean(40)
    df = spark.createDataFrame(pdf.assign(seq=range(40))[["symbol", "ts", "seq"]], "symbol string, ts timestamp_ntz, seq long")
    assert q.time_order(df, "seq", chunk=8).first().status == "PASS"
    for at in (5, 7):     # inside a chunk and across two
        swapped = df.withColumn("seq", F.when(F.col("seq") == at, at + 1).when(F.col("seq") == at + 1, at).otherwise(F.col("seq")))
        row = q.time_order(swapped, "seq", chunk=8).first()
        assert row.status == "FAIL" and row.metrics["count"] == 1


def test_schema_check(spark):
    df = frame(spark, clean())
    assert [c["status"] for c in q.check_schema(df)] == ["PASS", "PASS"]
    assert [c["status"] for c in q.check_schema(df.drop("volume").withColumn("ts", F.lit("x")))] == ["FAIL", "FAIL"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 5000])
def test_quantiles_of_groups_of_any_size(spark, n):
    values = np.random.default_rng(n).normal(0, 1, n)
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    pdf = pd.DataFrame({"k": "a", "value": values})
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], probs).toPandas().set_index("prob")["quantile"]
    np.testing.assert_allclose([got[p] for p in probs], np.percentile(values, [p * 100 for p in probs]), rtol=1e-12)


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_quantiles_are_exact_on_skewed_values(spark, accuracy):
    rng = np.random.default_rng(0)
    skewed = np.concatenate([np.zeros(3000), np.full(1000, 7.0), rng.exponential(100, 5001), [1e12, -1e12]])
    pdf = pd.DataFrame({"k": "a", "value": rng.permutation(skewed)})
    probs = [0.25, 0.5, 0.75, 0.9]
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], probs, accuracy=accuracy).toPandas()
    want = dict(zip(probs, np.percentile(skewed, [p * 100 for p in probs])))
    for r in got.itertuples():
        assert np.isclose(r.quantile, want[r.prob], rtol=1e-12)


def test_describe_matches_pandas(spark):
    pdf = clean(101)
    got = q.describe(frame(spark, pdf), ["close", "volume"]).toPandas().set_index("column")
    for c in ("close", "volume"):
        want = pdf[c].describe()
        mine = got.loc[c, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float)
        np.testing.assert_allclose(mine, want)
    assert "p50" in q.describe(frame(spark, pdf), approximate=True).columns
