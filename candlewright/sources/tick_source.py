"""Tick files as a Spark data source: pruned by path, read in partitions of even size, streamed, written.

``root/SYMBOL/YYYY/MM/DD/HHh_ticks.bi5``. Conditions on ``symbol``, ``hour_ts`` and ``ts`` decide which
folders are listed and which files are opened, in a batch; a stream takes the same as options. A
stream's offset is a file modification time, so files of old hours that arrive late, or are
replaced, are taken as well.

Files are reached through pyarrow, which knows local folders, s3, gs and hdfs; for other file systems
there is ``ticks.tick_files``, which prunes by glob and lets Spark read.
"""

from __future__ import annotations

import calendar
import datetime as dt
import io
import lzma
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from candlewright.functions.columns import bucket_start
from candlewright.sources.ticks import DEFAULT_DIVISOR, DIVISORS, TickRead, divisor, records_of

SCHEMA = ("symbol string, ts timestamp_ntz, seq long, price double, volume double, "
          "hour_ts timestamp_ntz, path string, error string")
ARROW = pa.schema([
    ("symbol", pa.string()), ("ts", pa.timestamp("us")), ("seq", pa.int64()), ("price", pa.float64()), ("volume", pa.float64()),
    ("hour_ts", pa.timestamp("us")), ("path", pa.string()), ("error", pa.string())])
FILE_NAME = re.compile(r"(\d{2})h_ticks\.bi5$")
HOUR = dt.timedelta(hours=1)
LISTERS = 16


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/(?!/)", root):
        root = root.removeprefix("file:")
    return fs.FileSystem.from_uri(root)


@dataclass
class Wanted:
    """What is asked for: symbols (None: all) and an inclusive range of hours."""

    symbols: set[str] | None = None
    first: dt.datetime = dt.datetime.min
    last: dt.datetime = dt.datetime.max

    @classmethod
    def of(cls, options: dict) -> Wanted:
        symbols = options.get("symbols")
        return cls({s.strip().upper() for s in symbols.split(",")} if symbols else None,
                   dt.datetime.fromisoformat(options.get("start", "0001-01-01")),
                   dt.datetime.fromisoformat(options.get("end", "9999-12-31 23:00:00")))

    def narrow(self, condition: Filter) -> None:
        """Take a condition into account as far as paths can tell; Spark still applies it to the rows."""
        match condition:
            case EqualTo(("symbol",), value) if isinstance(value, str):
                self._symbols({value})
            case In(("symbol",), values):
                self._symbols({v for v in values if isinstance(v, str)})
            case EqualTo(("ts" | "hour_ts",), value) if isinstance(value, dt.datetime):
                self.first, self.last = max(self.first, _hour(value)), min(self.last, _hour(value))
            case GreaterThan(("ts" | "hour_ts",), value) | GreaterThanOrEqual(("ts" | "hour_ts",), value) if isinstance(value, dt.datetime):
                self.first = max(self.first, _hour(value))
            case LessThanOrEqual(("ts" | "hour_ts",), value) if isinstance(value, dt.datetime):
                self.last = min(self.last, _hour(value))
            case LessThan(("ts" | "hour_ts",), value) if isinstance(value, dt.datetime):
                self.last = min(self.last, _hour(value - dt.timedelta(microseconds=1)))

    def _symbols(self, found: set[str]) -> None:
        self.symbols = found if self.symbols is None else self.symbols & found


def _hour(value: dt.datetime) -> dt.datetime:
    return value.replace(minute=0, second=0, microsecond=0, tzinfo=None)


@dataclass(frozen=True)
class TickFile:
    path: str
    symbol: str
    hour: dt.datetime
    size: int
    modified: int       # nanoseconds


def _folders(system: fs.FileSystem, parents: list[tuple[str, tuple]], keep) -> list[tuple[str, tuple]]:
    """Folders below ``parents`` whose names, as numbers behind those of the parent, ``keep`` accepts."""
    def below(parent: tuple[str, tuple]) -> list[tuple[str, tuple]]:
        path, known = parent
        found = []
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.Directory and re.fullmatch(r"\d{4}" if len(known) == 1 else r"\d{2}", info.base_name):
                parts = (*known, int(info.base_name))
                if keep(parts):
                    found.append((info.path, parts))
        return found

    with ThreadPoolExecutor(LISTERS) as pool:
        return [x for part in pool.map(below, parents) for x in part]


def list_files(root: str, wanted: Wanted) -> list[TickFile]:
    """The files that are wanted; folders of other symbols, years, months and days are not opened."""
    system, base = file_system(root)
    first, last = wanted.first, wanted.last
    if first > last or wanted.symbols == set():
        return []

    def in_range(parts: tuple) -> bool:
        _, year, month, day = (*parts, None, None)[:4]
        if year < 1 or (month is not None and not 1 <= month <= 12):
            return False
        if day is not None and not 1 <= day <= calendar.monthrange(year, month)[1]:
            return False
        earliest = dt.datetime(year, month or 1, day or 1)
        latest = dt.datetime(year, month or 12, day or calendar.monthrange(year, month or 12)[1], 23)
        return latest >= first and earliest <= last

    level = [(i.path, (i.base_name.upper(),)) for i in system.get_file_info(fs.FileSelector(base))
             if i.type == fs.FileType.Directory and (wanted.symbols is None or i.base_name.upper() in wanted.symbols)]
    for _ in range(3):
        level = _folders(system, level, in_range)

    def files(folder: tuple[str, tuple]) -> list[TickFile]:
        path, (symbol, year, month, day) = folder
        found = []
        for info in system.get_file_info(fs.FileSelector(path)):
            name = FILE_NAME.fullmatch(info.base_name)
            if name and info.type == fs.FileType.File and int(name[1]) < 24:
                hour = dt.datetime(year, month, day, int(name[1]))
                if first <= hour <= last:
                    found.append(TickFile(info.path, symbol, hour, info.size, info.mtime_ns))
        return found

    with ThreadPoolExecutor(LISTERS) as pool:
        found = [x for part in pool.map(files, level) for x in part]
    return sorted(found, key=lambda f: (f.symbol, f.hour))


class Files(InputPartition):
    def __init__(self, files: list[TickFile]):
        super().__init__(None)
        self.files = files


def split(files: list[TickFile], mb: float) -> list[Files]:
    """Neighbouring files together up to ``mb`` megabytes, as they are stored; a larger file stands alone."""
    parts: list[Files] = []
    size = 0
    for f in files:
        if not parts or size + f.size > mb * 1e6:
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(f)
        size += f.size
    return parts


def decode(root: str, files: list[TickFile], volume_type: str) -> Iterator[pa.RecordBatch]:
    """Ticks of the files, one batch each; a file that is empty or unreadable gives one row with an error."""
    system, _ = file_system(root)
    for f in files:
        hour = np.datetime64(f.hour, "us")
        try:
            with system.open_input_file(f.path) as source:
                seq, ms, _, bid, ask_vol, bid_vol = records_of(source.read(), volume_type)
        except Exception as exc:  # any unreadable file becomes a reject row
            row = {"symbol": f.symbol, "hour_ts": f.hour, "path": f.path, "error": f"{type(exc).__name__}: {exc}"}
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)
            continue
        n = len(seq)
        yield pa.RecordBatch.from_arrays([
            pa.repeat(f.symbol, n), pa.array(hour + ms * np.timedelta64(1000, "us")), pa.array(seq),
            pa.array(bid / DIVISORS.get(f.symbol, DEFAULT_DIVISOR)), pa.array(np.abs(ask_vol + bid_vol)),
            pa.array(np.full(n, hour)), pa.repeat(f.path, n), pa.nulls(n, pa.string())], schema=ARROW)


class TickReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.mb = options["path"], float(options.get("partitionmb", 16))
        self.volume_type, self.wanted = options.get("volumetype", "int32"), Wanted.of(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            self.wanted.narrow(condition)
            yield condition

    def partitions(self) -> list[Files]:
        return split(list_files(self.root, self.wanted), self.mb) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return decode(self.root, partition.files, self.volume_type)


class TickStreamReader(DataSourceStreamReader):
    """Offsets are modification times; a file counts once it is ``settleseconds`` old, so none slips in behind one."""

    def __init__(self, options: dict):
        self.root, self.mb = options["path"], float(options.get("partitionmb", 16))
        self.volume_type, self.wanted = options.get("volumetype", "int32"), Wanted.of(options)
        self.settle = float(options.get("settleseconds", 2))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        ready = time.time_ns() - int(self.settle * 1e9)
        return {"until": max((f.modified for f in list_files(self.root, self.wanted) if f.modified <= ready), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fresh = [f for f in list_files(self.root, self.wanted) if start["until"] < f.modified <= end["until"]]
        return split(fresh, self.mb) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return decode(self.root, partition.files, self.volume_type)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class TickWriter(DataSourceArrowWriter):
    """Writes files under names of the job and moves them to their places when all tasks have ended."""

    def __init__(self, root: str):
        self.root, self.job = root, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.root)
        done, key, held = Written(), None, io.BytesIO()

        def flush() -> None:
            symbol, hour = key
            name = posixpath.join(symbol, f"{hour:%Y/%m/%d}", f"{hour:%H}h_ticks.bi5")
            temporary = posixpath.join(base, self.job, uuid.uuid4().hex)
            system.create_dir(posixpath.dirname(temporary), recursive=True)
            with system.open_output_stream(temporary) as out:
                out.write(lzma.compress(held.getvalue(), format=lzma.FORMAT_ALONE, preset=0))
            done.moves.append((temporary, posixpath.join(base, name)))

        for batch in iterator:
            symbols, hours = batch.column("symbol").to_pylist(), batch.column("hour_ts").to_numpy(zero_copy_only=False)
            words = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                              for c in ("ms", "ask_raw", "bid_raw", "ask_vol", "bid_vol")], axis=1)
            words = (words & 0xFFFFFFFF).astype(">u4")
            edges = [0, *(i for i in range(1, len(symbols)) if symbols[i] != symbols[i - 1] or hours[i] != hours[i - 1]), len(symbols)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                here = (symbols[a], hours[a].astype("datetime64[us]").item())
                if here != key:
                    if key is not None:
                        flush()
                    key, held = here, io.BytesIO()
                held.write(words[a:b].tobytes())
        if key is not None:
            flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.root)
        for temporary, place in (m for message in messages if message for m in message.moves):
            system.create_dir(posixpath.dirname(place), recursive=True)
            system.move(temporary, place)
        self._tidy(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(*file_system(self.root))

    def _tidy(self, system: fs.FileSystem, base: str) -> None:
        job = posixpath.join(base, self.job)
        if system.get_file_info(job).type == fs.FileType.Directory:
            system.delete_dir(job)


class TickFiles(DataSource):
    """Options: path; symbols (comma-separated), start and end (first and last hour); partitionMb, volumeType, settleSeconds."""

    @classmethod
    def name(cls) -> str:
        return "tickfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TickReader:
        return TickReader(dict(self.options))

    def streamReader(self, schema) -> TickStreamReader:
        return TickStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TickWriter:
        return TickWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format ``tickfiles`` known; conditions reach the source only with Spark's setting for that."""
    spark.dataSource.register(TickFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tick_table(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Rows of all tick files below ``root``: ticks, and one row with ``error`` for each file that gives none."""
    register(spark)
    return spark.read.format("tickfiles").options(path=root, **options).load()


def tick_stream(spark: SparkSession, root: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("tickfiles").options(path=root, **options).load()


def apart(rows: DataFrame) -> TickRead:
    """Ticks and rejects of a tick table or stream."""
    return TickRead(rows.where("error IS NULL").drop("path", "error"), rows.where("error IS NOT NULL").select("path", "error"))


def write_tick_files(ticks: DataFrame, root: str) -> None:
    """Logical ticks as files, one for each symbol and hour; a file that is there is replaced.

    Times are kept to the millisecond and prices to the instrument's divisor, as the format has it; the
    ask is the bid, and the volume stands on the ask side. All of an hour's ticks go in one file.
    """
    register(ticks.sparkSession)
    raw = F.round(F.col("price") * divisor()).cast("int")
    named = ticks.where("symbol IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL").select(
        F.upper("symbol").alias("symbol"), "ts", "seq", "price", F.coalesce("volume", F.lit(0)).cast("int").alias("ask_vol"))
    records = named.withColumn("hour_ts", bucket_start("ts", 3600)).select(
        "symbol", "hour_ts", F.timestamp_diff("MILLISECOND", "hour_ts", "ts").cast("long").alias("ms"),
        raw.alias("ask_raw"), raw.alias("bid_raw"), "ask_vol", F.lit(0).alias("bid_vol"), "seq")
    # a number of its own, or small inputs would end up in one task and its many files with them
    tasks = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (records.repartition(tasks, "symbol", "hour_ts").sortWithinPartitions("symbol", "hour_ts", "ms", "seq").drop("seq")
     .write.format("tickfiles").option("path", root).mode("append").save())

