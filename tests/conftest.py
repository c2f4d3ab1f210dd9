import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from candlewright.operators.blocks import index_bars  # noqa: E402
from candlewright.schema import BARS  # noqa: E402
from candlewright.session import build_session, stage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(symbol="A", n=300, minutes=60, seed=1, start="2024-01-01", scale=1.0):
    """Random-walk bars as pandas."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, scale, n))
    opened = np.concatenate([[100.0], close[:-1]])
    spread = rng.uniform(0, scale, (2, n))
    ts = pd.date_range(start, periods=n, freq=f"{minutes}min")
    return pd.DataFrame({
        "symbol": symbol, "ts_utc": ts, "ts": ts, "open": opened,
        "high": np.maximum(opened, close) + spread[0], "low": np.minimum(opened, close) - spread[1],
        "close": close, "volume": rng.integers(1, 100, n).astype(float)})


def frame(spark, pdf):
    """Bars in random row order."""
    return spark.createDataFrame(pdf.sample(frac=1, random_state=0)[BARS.fieldNames()], BARS)


def indexed(spark, *pdfs):
    bars = stage(frame(spark, pd.concat(pdfs, ignore_index=True)), "bars")
    return stage(index_bars(bars), "indexed")


def rows(df, *order):
    return df.toPandas().sort_values(list(order or ("symbol", "bar_no")), ignore_index=True)
