"""Session settings and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_inside: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "candlewright", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` unset and let spark-submit decide; shuffle
    partitions are left to the cluster's own setting and AQE.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "65536",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may go without it; there a temporary folder is used.
    Inside ``staged_tables`` it is the folder of that block.
    """
    return _inside.get(spark.sparkContext.applicationId) or _outer(spark)


def _outer(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/candlewright/{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, cutting its lineage.

    Used where a result feeds two branches of one plan, so that neither branch
    recomputes it and a lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_tables(spark: SparkSession) -> Iterator[str]:
    """Everything staged inside the ``with`` is deleted when it ends; what must outlive it is written elsewhere first."""
    app = spark.sparkContext.applicationId
    outer, own = staging_root(spark), f"{staging_root(spark)}/{uuid.uuid4().hex}"
    _inside[app] = own
    try:
        yield own
    finally:
        if outer == _outer(spark):
            del _inside[app]
        else:
            _inside[app] = outer
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
