"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side of a join may have and still be sent to every executor (tens of MB at the widths used here).
BROADCAST_ROWS = 200_000

#: Settings every job of the engine expects; all can be changed at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A file's size says little of its rows: findings take a hundredth of their size in Parquet. So a side that is not marked
    # for broadcast is one only if it was measured to be small, after its shuffle.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Texts are handed to Python in batches of a few MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once_per_input(make):
    """make(spark, sf_dir), kept for later queries of the session that read the same documents: by their path, files, bytes and time of change."""
    kept: dict[tuple, object] = {}

    @wraps(make)
    def shared(spark: SparkSession, sf_dir: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        summary = files.getContentSummary(path)
        key = (spark.sparkContext.applicationId, sf_dir, summary.getLength(), summary.getFileCount(), files.getFileStatus(path).getModificationTime())
        if key not in kept:
            while len(kept) > 3:
                kept.pop(next(iter(kept)))
            kept[key] = make(spark, sf_dir)
        return kept[key]

    return shared


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for tables that a job writes on its way; a folder of its own only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="kbq-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while; a query that is started meanwhile keeps it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed(spark: SparkSession):
    """While a table is written: its shuffle files go when it is there, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Where `written` puts tables just now that nothing needs later.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession):
    """What is `written` meanwhile, by this thread, is removed at the end."""
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            removed(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later plans start from a plain scan, and a lost executor loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (paths := _passing.get()) is not None:
        paths.append(path)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most `rows` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
