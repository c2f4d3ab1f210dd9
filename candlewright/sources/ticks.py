"""Raw tick files: one LZMA file of 20-byte big-endian records per instrument and hour."""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.session import stage

# Price divisors by instrument.
DIVISORS = {
    "DEUIDXEUR": 1000.0, "XAUUSD": 1000.0, "USA500IDXUSD": 1000.0, "USA30IDXUSD": 1000.0,
    "USATECHIDXUSD": 1000.0, "FRAIDXEUR": 1000.0, "GBRIDXGBP": 1000.0, "EURJPY": 1000.0,
    "USDJPY": 1000.0,
    "AUDUSD": 100000.0, "EURUSD": 100000.0, "GBPUSD": 100000.0, "USDCAD": 100000.0,
    "USDCHF": 100000.0,
}
DEFAULT_DIVISOR = 100000.0

RECORD_BYTES = 20
FILE_GLOB = "*h_ticks.bi5"
PATH_PATTERN = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/(\d{2})h_ticks\.bi5$"
RECORD_SCHEMA = "path string, seq long, ms long, ask_raw long, bid_raw long, ask_vol double, bid_vol double, error string"


def path_keys(path: Column | str = "path") -> dict[str, Column]:
    """``symbol`` and ``hour_ts`` (UTC) from a file path; NULL where it does not match."""
    p = F.col(path) if isinstance(path, str) else path
    part = [F.nullif(F.regexp_extract(p, PATH_PATTERN, i), F.lit("")) for i in range(6)]
    stamp = F.concat(part[2], F.lit("-"), part[3], F.lit("-"), part[4], F.lit(" "), part[5], F.lit(":00:00"))
    return {"symbol": F.upper(part[1]), "hour_ts": F.try_to_timestamp(stamp).cast("timestamp_ntz")}


def divisor(symbol: Column | str = "symbol", table: dict[str, float] | None = None) -> Column:
    """Price divisor of an instrument; a literal map, so no join."""
    table = DIVISORS if table is None else table
    entries = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.coalesce(F.try_element_at(entries, symbol), F.lit(DEFAULT_DIVISOR))


_NUMBERS = ["seq", "ms", "ask_raw", "bid_raw", "ask_vol", "bid_vol"]
_FLUSH_ROWS = 250_000


def records_of(content: bytes, volume_type: str) -> list[np.ndarray]:
    """Whole records of one file; a short one at its end is left out."""
    if not content:
        raise ValueError("empty file")
    data = lzma.decompress(content)
    count = len(data) // RECORD_BYTES
    words = np.frombuffer(data, dtype=">u4", count=count * 5).reshape(count, 5)
    signed = words.view(">i4")
    volumes = words.view(">f4") if volume_type == "float32" else signed
    return [
        np.arange(count, dtype="int64"), words[:, 0].astype("int64"),
        signed[:, 1].astype("int64"), signed[:, 2].astype("int64"),
        volumes[:, 3].astype("float64"), volumes[:, 4].astype("float64"),
    ]


def _decoder(volume_type: str):
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, bad, rows = [], [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    part = records_of(content, volume_type)
                except Exception as exc:  # any unreadable file becomes a reject row
                    bad.append((path, f"{type(exc).__name__}: {exc}"))
                    continue
                good.append((path, part))
                rows += len(part[0])
                if rows >= _FLUSH_ROWS:
                    yield _tidy(good)
                    good, rows = [], 0
        if good:
            yield _tidy(good)
        if bad:
            yield pd.DataFrame(bad, columns=["path", "error"]).reindex(columns=["path", *_NUMBERS, "error"])

    return decode


def _tidy(files: list[tuple[str, list[np.ndarray]]]) -> pd.DataFrame:
    lengths = [len(part[0]) for _, part in files]
    out = {"path": np.repeat(np.array([path for path, _ in files], dtype=object), lengths)}
    for i, name in enumerate(_NUMBERS):
        out[name] = np.concatenate([part[i] for _, part in files])
    return pd.DataFrame({**out, "error": None})


def decode_files(files: DataFrame, volume_type: str = "int32") -> DataFrame:
    """Records of ``binaryFile`` rows, one file at a time; unreadable files give an ``error`` row.

    Stage the result if both ticks and rejects are wanted from it.
    """
    if volume_type not in ("int32", "float32"):
        raise ValueError(f"unknown volume type {volume_type!r}")
    decoded = files.select("path", "content").mapInPandas(_decoder(volume_type), RECORD_SCHEMA)
    return decoded.withColumns(path_keys()).withColumn(
        "error", F.coalesce("error", F.when(F.col("symbol").isNull() | F.col("hour_ts").isNull(), "unexpected path")))


def to_ticks(records: DataFrame) -> DataFrame:
    """Logical ticks: bid price scaled by instrument, volume of both sides."""
    zero = F.lit(0)
    offset = F.make_dt_interval(zero, zero, zero, (F.col("ms").cast("decimal(18,6)") / 1000).cast("decimal(18,6)"))
    return records.where(F.col("error").isNull() & F.col("ms").isNotNull()).select(
        "symbol",
        (F.col("hour_ts") + offset).alias("ts"),
        "seq",
        (F.col("bid_raw") / divisor()).alias("price"),
        F.abs(F.col("ask_vol") + F.col("bid_vol")).alias("volume"),
    )


def rejects(records: DataFrame) -> DataFrame:
    return records.where(F.col("error").isNotNull()).select("path", "error")


def tick_files(spark: SparkSession, root: str, symbols: list[str] | None = None,
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Tick files as ``binaryFile`` rows; their content is read only if it is selected.

    Without symbols and days everything below ``root`` is listed. With them, ``root`` holds the symbols'
    folders, spelt as asked for, and only folders of these symbols and days are looked into (first and last
    day inclusive).
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB)
    if symbols is None and start is None and end is None:
        return reader.option("recursiveFileLookup", "true").load(root)
    days = "*/*/*"
    if start is not None or end is not None:
        days = "{" + ",".join(f"{d:%Y/%m/%d}" for d in pd.date_range(start, end, freq="D")) + "}"
    names = "*" if symbols is None else "{" + ",".join(symbols) + "}"
    return reader.load(f"{root.rstrip('/')}/{names}/{days}/{FILE_GLOB}")


class TickRead(NamedTuple):
    ticks: DataFrame
    rejects: DataFrame


def load_ticks(spark: SparkSession, root: str, volume_type: str = "int32") -> TickRead:
    """Ticks below ``root``, and one row (path, error) for each file that gave none; decoded once and staged."""
    records = stage(decode_files(tick_files(spark, root), volume_type), "records")
    return TickRead(to_ticks(records), rejects(records).distinct())


def read_ticks(spark: SparkSession, root: str, volume_type: str = "int32") -> DataFrame:
    """The ticks alone; ``load_ticks`` also says which files could not be used."""
    return to_ticks(decode_files(tick_files(spark, root), volume_type))
