"""Checks on arriving data, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.operators import store
from kbq.session import BROADCAST_ROWS, freed, passing, setting, small, written


def stream_table(spark: SparkSession, folder: str, like: DataFrame, names: str = "*", most: int | None = None) -> DataFrame:
    """Parquet files in a folder, as they arrive, as a stream with the schema of `like`; names: a pattern of file names, most: bytes of a batch, by whole files."""
    source = spark.readStream.schema(like.schema).option("pathGlobFilter", names)
    return (source if most is None else source.option("maxBytesPerTrigger", str(most))).parquet(folder)


def daily_health(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, events, mean) in tumbling days; rows later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("day"), "events", "mean_value")


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all that has arrived to `handle` in batches; the checkpoint makes each batch count once."""
    with freed(stream.sparkSession):
        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what a stream gives to a table until all that has arrived is read."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Runs stand a day apart on the clock that closes them.
_DAY = 86_400_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_runs(seen: DataFrame, lateness: int) -> DataFrame:
    """(run, signal_id), once each, of the closed runs of a stream (run, signal_id).

    A run may come in any number of batches, repeated and out of order; it is closed once a run `lateness` later has come.
    Rows of closed runs are dropped. A row without signal_id only moves the clock on. State is one entry a finding and open
    run, an aggregate of Spark's own in RocksDB: start the query under `setting(spark, *state_store())`.
    """
    timed = seen.select(F.col("run").cast("long").alias("run"), "signal_id", F.timestamp_millis(F.col("run").cast("long") * _DAY).alias("at")).withWatermark("at", f"{lateness} days")
    return timed.groupBy("at", "run", "signal_id").agg(F.count("*").alias("n")).select("run", "signal_id")


def folded(known: DataFrame | None, closed: DataFrame) -> DataFrame:
    """(signal_id, first_seen, last_seen, runs, gap) of the findings of closed (run, signal_id) after their known rows. Runs close in order, so one that is not after a finding's last was counted before."""
    if known is None:
        known = closed.sparkSession.createDataFrame([], "signal_id string, first_seen long, last_seen long, runs long, gap boolean")
    later = closed.join(known, "signal_id", "left").where("last_seen is null or run > last_seen")
    own = lambda c: F.first(c).alias(c)  # noqa: E731  the same in all rows of a finding
    per = later.groupBy("signal_id").agg(F.min("run").alias("a"), F.max("run").alias("b"), F.count("*").alias("n"), *map(own, ("first_seen", "last_seen", "runs", "gap")))
    gap = F.coalesce("gap", F.lit(False)) | (F.col("b") - F.col("a") + 1 > F.col("n")) | F.coalesce(F.col("a") - F.col("last_seen") > 1, F.lit(False))
    return per.select("signal_id", F.coalesce("first_seen", "a").alias("first_seen"), F.col("b").alias("last_seen"), (F.coalesce("runs", F.lit(0)) + F.col("n")).alias("runs"), gap.alias("gap"))


def state_store() -> tuple[str, str]:
    return "spark.sql.streaming.stateStore.providerClass", _ROCKSDB


def keep_lifecycle(seen: DataFrame, folder: str, checkpoint: str, lateness: int = 5) -> None:
    """Carry the lifecycle of findings over all that has arrived of a stream (run, signal_id) into the store in `folder`: each batch touches the buckets of its findings only, and one that is given twice changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        closed = written(batch.where("signal_id is not null"), "closed")
        if closed.isEmpty():
            return
        store.transact(batch.sparkSession, folder, lambda now: {"lifecycle": store.upserted(now, "lifecycle", folded(now.buckets("lifecycle", closed), closed), ["signal_id"], n=16)})

    with setting(seen.sparkSession, *state_store()):
        query = closed_runs(seen, lateness).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def lifecycle_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """(signal_id, first_seen, last_seen, runs, status) after the last closed run; None before the first."""
    kept = store.load(spark, folder, "lifecycle")
    if kept is None:
        return None
    last = kept.agg(F.max("last_seen").alias("last_run"))
    status = F.when(F.col("last_seen") < F.col("last_run"), "resolved").when(F.col("gap"), "recurring").when(F.col("first_seen") == F.col("last_run"), "new").otherwise("persistent")
    return kept.join(F.broadcast(last)).select("signal_id", "first_seen", "last_seen", "runs", status.alias("status"))


def split_bad(batch: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows to park)."""
    ok = F.coalesce(valid, F.lit(False))
    return batch.where(ok), batch.where(~ok)


def once_by_key(stream: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """A stream with the first row of each key among those that come within `lateness` of each other by their time `at`."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


_ROW = "_row"


def _of_rows(rows: DataFrame, first: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows whose number stands in first, which are all or are told apart by the shorter list, if there is a short one: rows are wide."""
    every, kept = rows.count(), first.count()
    if every - kept == 0:
        return rows
    if kept > most and every - kept <= most:
        return rows.join(F.broadcast(rows.select(_ROW).join(first.select(_ROW), _ROW, "left_anti")), _ROW, "left_anti")
    return rows.join(small(first.select(_ROW), most), _ROW, "left_semi")


def assess_once(folder: str, key: str, assess: Callable[[DataFrame], DataFrame], name: str = "assessed") -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that adds assess(rows) to a table of the store for rows whose key is not recorded yet, and records the keys in the same version.

    So a delivery counts once however often it comes: in one batch, in later ones, or under another checkpoint. Which rows
    are new is found by their keys alone. What a batch writes on its way is removed when it is through.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with passing(spark):
            rows = written(batch.withColumn(_ROW, F.monotonically_increasing_id()), "arrived")

            def change(now: store.Snapshot) -> dict:
                first = rows.groupBy(key).agg(F.min(_ROW).alias(_ROW))
                known = now.buckets("keys", first.select(key)) if "keys" in now.tables else None
                first = written(first if known is None else first.join(known.select(key), key, "left_anti"), "unseen")
                found = written(assess(_of_rows(rows, first).drop(_ROW)), "found")
                return {name: store.upserted(now, name, found, [key, *[c for c in found.columns if c != key]], n=16), "keys": store.upserted(now, "keys", first.select(key), [key], n=16)}

            store.transact(spark, folder, change)

    return handle
