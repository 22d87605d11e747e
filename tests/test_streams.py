"""Streams with keyed state, out of order and repeated."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kbq import session
from kbq.operators import history, store
from kbq.session import prepare
from kbq.streaming import runs


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("signal_id", "first_seen", "last_seen", "runs", "status").collect())


def test_lifecycle_of_late_and_repeated_runs(spark, tmp_path):
    """A run in many batches, late and repeated rows give the batch lifecycle; so does going on from a checkpoint."""
    rng = random.Random(4)
    seen = [(run, f"s{k}") for run in range(1, 13) for k in range(6) if rng.random() < 0.6]
    arrivals = sorted([(run + rng.randint(0, 2), run, s) for run, s in seen] + [(run + 1, run, s) for run, s in seen[::3]])
    like = spark.createDataFrame(seen, "run long, signal_id string")

    def deliver(rows):
        spark.createDataFrame(rows, like.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arrivals")

    def run():
        stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/arrivals")
        runs.keep_lifecycle(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", lateness=4)

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (range(0, 7), range(7, 20)):
        deliver([(run, s) for at, run, s in arrivals if at in part])
        run()
    deliver([(1, "s0"), (1, "too late")])  # run 1 was closed long ago
    deliver([(99, None)])
    run()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    assert rows_of(runs.lifecycle_state(spark, f"{tmp_path}/store")) == rows_of(history.lifecycle(like))


def test_a_delivery_counts_once(spark, tmp_path):
    """Twice in a batch, again later, and under another checkpoint."""
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "dedup_key string, n int").withColumn("at", F.timestamp_seconds(F.col("n")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    rows.where("n = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    handler = runs.assess_once(f"{tmp_path}/store", "dedup_key", lambda new: new.select("dedup_key", (F.col("n") * 10).alias("score")))
    for checkpoint in ("one", "two"):
        stream = runs.once_by_key(runs.stream_table(spark, f"{tmp_path}/in", rows), "dedup_key", "at", "1 hour")
        runs.run_once(stream, handler, f"{tmp_path}/{checkpoint}")
    assert sorted(tuple(r) for r in store.load(spark, f"{tmp_path}/store", "assessed").collect()) == [("a", 10), ("b", 20), ("c", 30)]


@pytest.mark.parametrize("most", [0, 5, 100])
def test_batches_are_not_shuffled_to_tell_what_is_new(spark, tmp_path, monkeypatch, most):
    """A batch's rows are written once, told apart by their keys, and gone when it is through; so is what is written to assess them."""
    monkeypatch.setattr(session, "shared_folder", lambda _: f"{tmp_path}/shared")
    plain, seen = runs._of_rows, []
    monkeypatch.setattr(runs, "_of_rows", lambda rows, first: seen.append(plain(rows, first, most)) or seen[-1])
    handler = runs.assess_once(f"{tmp_path}/store", "id", lambda new: session.written(new.select("id", F.length("text").alias("n")), "passing"))
    rows = spark.createDataFrame([(f"k{i % 12}", "x" * (i % 12)) for i in range(20)], "id string, text string").coalesce(1)
    plans = []
    for batch in (rows.where("id < 'k5'"), rows, rows):
        handler(batch, 0)
        plans.append(seen[-1]._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(tuple(r) for r in store.load(spark, f"{tmp_path}/store", "assessed").collect()) == sorted((f"k{i}", i) for i in range(12))
    assert os.listdir(f"{tmp_path}/shared") == []
    assert "groupBy" not in "".join(plans) and not any("Aggregate" in p for p in plans)
    assert most < 100 or all("broadcast" in p for p in plans)


def test_batches_are_bounded(spark, tmp_path):
    """What arrives at once is read in batches of so many bytes, each document once over all of them."""
    rows = spark.createDataFrame([(i % 7, i) for i in range(21)], "id int, n int").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    for part in range(3):
        rows.where(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sizes = []
    stream = runs.once_by_key(runs.stream_table(spark, f"{tmp_path}/in", rows, most=1), "id", "at", "1 hour")
    runs.run_once(stream, lambda batch, number: sizes.append(batch.count()), f"{tmp_path}/checkpoint")
    assert len(sizes) >= 3 and sum(sizes) == 7
