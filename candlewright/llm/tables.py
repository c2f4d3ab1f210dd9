"""Helpers shared by the operators: stored tables, text batches and column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from candlewright.session import staging_root

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables an operator writes once and reads back, below the shared folder of the cluster.

    Writing cuts the lineage, so a lost executor costs a re-read. The shuffle
    files of the job that wrote a table go when it ends, and an intermediate
    table goes with ``drop`` once the next one is written. Tables behind a
    returned DataFrame stay until the folder is removed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of ``docs`` whatever else it holds; the text as UTF-8 bytes, null stays null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less the rows of an id and text of ``gone`` (doc_id, th); rows without id stay."""
    left = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    own = docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("own_th"),
                      F.struct(*docs.columns).alias("row"))
    kept = own.join(left, (F.col("own_id") == F.col("gone_id")) & (F.col("own_th") == F.col("gone_th")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def values(column: pa.Array) -> list:
    """What to_pylist() gives; by way of numpy, which takes a tenth of the time, where that gives the same."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_integer(kind) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind) and not column.null_count:
        flat, ends = values(column.flatten()), column.offsets.to_numpy()
        ends = (ends - ends[0]).tolist() if len(ends) else []
        return [flat[i:j] for i, j in zip(ends, ends[1:])]
    return column.to_pylist()


def map_batches(df: DataFrame, fn: Callable[..., dict[str, object]], schema: str, *columns: str) -> DataFrame:
    """``fn(*lists)`` for every Arrow batch, the lists being those of ``columns``.

    It returns columns, nothing, or an iterator of columns. Arrow's pool gives free memory back after
    each batch, as workers wait for other tasks with what they hold.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = fn(*(values(batch.column(c)) for c in columns))
            for part in [got] if isinstance(got, dict) else got or ():
                if part:
                    yield pa.RecordBatch.from_pydict(part, schema=kinds)
            batch = got = part = None
            pa.default_memory_pool().release_unused()
    return df.select(*columns).mapInArrow(run, schema)


def spans(texts: list[bytes | None], span: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about ``span`` bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= span:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it while a column of that name (in any case) is there."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
