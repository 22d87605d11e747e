"""Runs compared: signal and dimension differences, lifecycles, trends, strategy scores. Everything is a join or a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbq.operators.scoring import RANKS

_rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair]), F.col(c))


def signal_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(signal_id, change, severity_before, severity_after); change is new, resolved, persistent, worse or better."""
    old = before.select("signal_id", F.col("severity").alias("severity_before")).dropDuplicates(["signal_id"])
    new = after.select("signal_id", F.col("severity").alias("severity_after")).dropDuplicates(["signal_id"])
    a, b = _rank("severity_before"), _rank("severity_after")
    change = F.when(F.col("severity_before").isNull(), "new").when(F.col("severity_after").isNull(), "resolved").when(b > a, "worse").when(b < a, "better").otherwise("persistent")
    return old.join(new, "signal_id", "full_outer").withColumn("change", change)


def dimension_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dimension, before, after, delta); a missing dimension counts zero."""
    both = before.select("dimension", F.col("score").alias("before")).join(after.select("dimension", F.col("score").alias("after")), "dimension", "full_outer").fillna(0)
    return both.withColumn("delta", F.col("after") - F.col("before"))


def lifecycle(seen: DataFrame) -> DataFrame:
    """(signal_id, first_seen, last_seen, runs, status) from (run, signal_id), where runs are numbered without gaps.

    Resolved: absent from the last run. Recurring: present, after a gap. New: first seen in the last run. Else persistent.
    """
    last = seen.agg(F.max("run").alias("last_run"))
    w = Window.partitionBy("signal_id").orderBy("run")
    gaps = seen.select("signal_id", "run").distinct().withColumn("gap", (F.col("run") - F.lag("run").over(w) > 1).cast("int"))
    per = gaps.groupBy("signal_id").agg(F.min("run").alias("first_seen"), F.max("run").alias("last_seen"), F.count("*").alias("runs"), F.max("gap").alias("gap")).crossJoin(F.broadcast(last))
    status = F.when(F.col("last_seen") < F.col("last_run"), "resolved").when(F.col("gap") == 1, "recurring").when(F.col("first_seen") == F.col("last_run"), "new").otherwise("persistent")
    return per.withColumn("status", status).drop("gap", "last_run")


def oldest_open(state: DataFrame, n: int) -> DataFrame:
    """The n oldest findings of a lifecycle state that are open."""
    return state.where(F.col("status").isin("new", "persistent", "recurring")).orderBy("first_seen", "signal_id").limit(n)


def advance(state: DataFrame, current: DataFrame, run: int) -> DataFrame:
    """The lifecycle state after one more run: state(signal_id, first_seen, last_seen, runs, status), current(signal_id)."""
    now = current.select("signal_id").distinct().withColumn("here", F.lit(True))
    both = state.join(now, "signal_id", "full_outer")
    old = F.col("status")
    status = (
        F.when(F.col("here").isNull(), F.when(old.isin("new", "persistent", "recurring"), "resolved").otherwise(old))
        .when(old.isNull(), "new").when(old == "resolved", "recurring").when(old == "recurring", "recurring").otherwise("persistent")
    )
    here = F.coalesce("here", F.lit(False))
    return both.select("signal_id", F.coalesce("first_seen", F.lit(run)).alias("first_seen"), F.when(here, F.lit(run)).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("runs", F.lit(0)) + here.cast("int")).alias("runs"), status.alias("status"))


def trajectory(runs: DataFrame) -> DataFrame:
    """One row (runs, first_score, last_score, trend) over the last three runs of (run, score)."""
    order = Window.orderBy(F.desc("run"))
    recent = runs.orderBy(F.desc("run")).limit(3).withColumn("r", F.row_number().over(order))
    one = recent.agg(F.count("*").alias("runs"), F.max_by("score", "r").alias("first_score"), F.min_by("score", "r").alias("last_score"))
    delta = F.col("last_score") - F.col("first_score")
    return one.withColumn("trend", F.when(F.col("runs") < 2, "unknown").when(delta > 3, "improving").when(delta < -3, "worsening").otherwise("stable"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(uri, event, links_changed) from snapshots (uri, content_hash, links_hash)."""
    old = before.select("uri", F.col("content_hash").alias("old_content"), F.col("links_hash").alias("old_links"))
    both = old.join(after, "uri", "full_outer")
    event = F.when(F.col("old_content").isNull(), "added").when(F.col("content_hash").isNull(), "deleted").when(F.col("old_content") != F.col("content_hash"), "modified")
    return both.withColumn("event", event).where("event is not null").select("uri", "event", (~F.col("old_links").eqNullSafe(F.col("links_hash"))).alias("links_changed"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows in place of current ones with the same key; other rows stay."""
    return current.join(incoming, key, "left_anti").unionByName(incoming)


def ema(outcomes: DataFrame, alpha: float = 0.3, start: float | None = 0.5) -> DataFrame:
    """(issue_type, strategy, n, ema) of outcomes (issue_type, strategy, at, value) in time order.

    start: the value before the first outcome; None takes the first outcome itself. A step x -> (1 - alpha) x + alpha v
    composes, so a history is cut by time into blocks, which fold apart and are then joined in order: a strategy with a
    large share of the outcomes lies in many partitions, and none of them waits for another.
    """
    key, keep = ["issue_type", "strategy"], F.lit(1 - alpha)
    dealt = outcomes.select(*key, "at", F.col("value").cast("double").alias("value")).repartitionByRange(*key, "at").withColumn("block", F.spark_partition_id())
    inside = Window.partitionBy(*key, "block")
    placed = dealt.withColumn("i", F.row_number().over(inside.orderBy("at", "value"))).withColumn("m", F.count("*").over(inside))
    folded = placed.groupBy(*key, "block").agg(F.max("m").alias("n"), F.sum(F.pow(keep, F.col("m") - F.col("i")) * F.lit(alpha) * F.col("value")).alias("own"), F.min_by("value", "i").alias("head"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = folded.withColumn("later", later).withColumn("first", F.row_number().over(Window.partitionBy(*key).orderBy("block")) == 1)
    own = F.col("own")
    if start is None:  # the first outcome counts whole
        own = own + F.when(F.col("first"), keep * F.pow(keep, F.col("n") - 1) * F.col("head")).otherwise(F.lit(0.0))
    total = F.sum(own * F.pow(keep, F.col("later")))
    if start is not None:
        total = total + F.lit(start) * F.pow(keep, F.sum("n"))
    return joined.groupBy(*key).agg(F.sum("n").alias("n"), total.alias("ema"))


def floored(scores: DataFrame, share: float, by: list[str]) -> DataFrame:
    """scores (key..., strategy, n, ema) with `adjusted`, no less than `share` of the best of its key, and `floor_applied`. One row a strategy."""
    floor = F.lit(share) * F.max("ema").over(Window.partitionBy(*by))
    return scores.withColumn("adjusted", F.greatest("ema", floor)).withColumn("floor_applied", F.col("ema") < floor)


def next_run(outcomes: DataFrame) -> DataFrame:
    """(run_idx): one more than the outcomes recorded."""
    return outcomes.agg((F.count("*") + 1).alias("run_idx"))


def eligibility(current: DataFrame, last: DataFrame | None) -> DataFrame:
    """One row (eligible, new, unchanged, removed) from the ids (signal_id) of a run and of the one analysed last (None: the first): a run is worth an analysis if it is the first or has new findings."""
    now = current.select("signal_id").distinct()
    if last is None:
        return now.agg(F.lit(True).alias("eligible"), F.count("*").alias("new"), F.lit(0).cast("long").alias("unchanged"), F.lit(0).cast("long").alias("removed"))
    both = now.withColumn("now", F.lit(True)).join(last.select("signal_id").distinct().withColumn("before", F.lit(True)), "signal_id", "full_outer")
    return both.agg(F.count_if(F.col("before").isNull()).alias("new"), F.count_if(F.col("now") & F.col("before")).alias("unchanged"), F.count_if(F.col("now").isNull()).alias("removed")).select((F.col("new") > 0).alias("eligible"), "new", "unchanged", "removed")


def series(runs: DataFrame) -> DataFrame:
    """(run, score, delta, trend): the score of every run, its step from the run before and the trajectory up to it: over three runs, more than 3 points are improving or worsening. One row a run."""
    order = Window.orderBy("run")
    back = F.coalesce(F.lag("score", 2).over(order), F.lag("score", 1).over(order))
    step = F.col("score") - back
    trend = F.when(back.isNull(), "unknown").when(step > 3, "improving").when(step < -3, "worsening").otherwise("stable")
    return runs.select("run", "score", (F.col("score") - F.lag("score").over(order)).alias("delta"), trend.alias("trend"))


def with_status(state: DataFrame, statuses: list[str], run: int | None = None) -> DataFrame:
    """Rows of a lifecycle state with one of the statuses. run: only those that were last seen in the run before it, as those that it resolved were."""
    found = state.where(F.col("status").isin(statuses))
    return found if run is None else found.where(F.col("last_seen") == run - 1)


def clipped_rises(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, rise): how much each metric (metric, value) of a run exceeds the one before, zero if it doesn't; a missing one counts zero."""
    both = before.select("metric", F.col("value").alias("a")).join(after.select("metric", F.col("value").alias("b")), "metric", "full_outer").fillna(0)
    return both.select("metric", F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("rise"))


def diagnosis_quality(pairs: DataFrame, last: int = 100, least: int = 20) -> DataFrame:
    """(n, r, low, high, status) of (id, confidence, outcome): how far confidence foretells outcome over the last pairs."""
    recent = pairs.orderBy(F.desc("id")).limit(last)
    one = recent.agg(F.count("*").alias("n"), F.coalesce(F.corr("confidence", "outcome"), F.lit(0.0)).alias("r"))
    r = F.least(F.greatest(F.when(F.isnan("r"), F.lit(0.0)).otherwise(F.col("r")), F.lit(-0.999)), F.lit(0.999))
    z, se = F.lit(0.5) * F.log((1 + r) / (1 - r)), F.lit(1.96) / F.sqrt(F.col("n") - 3)
    status = F.when(F.col("n") < least, "insufficient_data").when(F.col("r") > 0.3, "healthy").when(F.col("r") < -0.3, "inverted").when(F.abs("r") < 0.1, "noise").otherwise("weak")
    enough = F.col("n") >= least
    bound = lambda x: F.round(F.when(enough, F.tanh(x)).otherwise(F.lit(0.0)), 6)
    return one.select("n", F.round(F.when(enough, F.col("r")).otherwise(F.lit(0.0)), 6).alias("r"), bound(z - se).alias("low"), bound(z + se).alias("high"), status.alias("status"))
