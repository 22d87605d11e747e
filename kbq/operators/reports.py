"""What a reader sees after a run: causes, contributors, explanations, differences and the reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import scoring as S


def severity_rank(c: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in S.RANKS.items() for x in pair]), F.col(c))


def causes(kb: C.KnowledgeBase) -> DataFrame:
    """(uri, collector_id, signal_type, line, cause): a heading's text, the target or phrase that a document's finding names most often (the first of equals), else the kind itself."""
    heads = C.heading_quality(kb).select("uri", "collector_id", "signal_type", "line", F.col("heading").alias("cause"))
    most = F.max_by("ref", F.struct("n", -F.col("first")))
    broken = kb.resolved.where("resolved is null").groupBy("uri", F.col("target").alias("ref")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    phrases = C.dangling_phrases(kb.traits).groupBy("uri", "ref").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    of = lambda refs, collector, kind: refs.groupBy("uri").agg(most.alias("cause")).select("uri", F.lit(collector).alias("collector_id"), F.lit(kind).alias("signal_type"), F.lit(None).cast("int").alias("line"), "cause")
    return heads.union(of(broken, "link_integrity", "broken_link")).union(of(phrases, "context_independence", "dangling_reference"))


def top_contributors(contributors: DataFrame, n: int, *by: str) -> DataFrame:
    """The n contributors that are worth most: by gain, findings and severity."""
    return contributors.orderBy(F.desc("score_gain"), F.desc("signals"), F.desc(severity_rank("severity")), "collector_id", "signal_type", *by).limit(n)


def contributor_changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(key..., collector_id, signal_type, gain_delta, signals_delta, change) of two runs' contributors; a missing one counts zero."""
    keys = [*by, "collector_id", "signal_type"]
    side = lambda df, name: df.select(*keys, F.col("score_gain").alias(f"gain_{name}"), F.col("signals").alias(f"n_{name}"))
    both = side(before, "a").join(side(after, "b"), keys, "full_outer").fillna(0, ["gain_a", "gain_b", "n_a", "n_b"])
    gain, n = F.round(F.col("gain_b") - F.col("gain_a"), 6), F.col("n_b") - F.col("n_a")
    change = F.when((gain > 0) | ((gain == 0) & (n > 0)), "regression").when((gain < 0) | (n < 0), "improvement").otherwise("unchanged")
    return both.select(*keys, gain.alias("gain_delta"), n.alias("signals_delta"), change.alias("change"))


def top_changes(changes: DataFrame, n: int) -> DataFrame:
    """The n greatest changes: by the size of the gain's step, then of the count's."""
    return changes.orderBy(F.desc(F.abs("gain_delta")), F.desc(F.abs("signals_delta")), *[c for c in changes.columns if c not in ("gain_delta", "signals_delta", "change")]).limit(n)


def changed_ids(before: DataFrame, after: DataFrame, n: int = 20) -> DataFrame:
    """(collector_id, signal_type, change, uri): of each kind the first n documents that gained or lost it."""
    keys = ["collector_id", "signal_type", "uri"]
    one, other = before.select(keys).distinct(), after.select(keys).distinct()
    moved = other.join(one, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(one.join(other, keys, "left_anti").withColumn("change", F.lit("removed")))
    w = Window.partitionBy("collector_id", "signal_type", "change").orderBy("uri")
    return moved.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def diff_summary(diff: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: counts of signal_diff's changes, new findings of high severity, the score's step and what to do. before, after: one row each with `adjusted`."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    counts = diff.agg(*[n(k) for k in ("new", "resolved", "persistent", "worse", "better")], F.count_if((F.col("change") == "new") & F.col("severity_after").isin("HIGH", "CRITICAL")).alias("new_high"))
    one = counts.crossJoin(F.broadcast(before.select(F.col("adjusted").alias("score_before")))).crossJoin(F.broadcast(after.select(F.col("adjusted").alias("score_after"))))  # one row each
    step = F.col("score_after") - F.col("score_before")
    text = F.concat(F.lit("Score "), F.col("score_before").cast("string"), F.lit(" to "), F.col("score_after").cast("string"), F.lit(": "), F.col("new").cast("string"), F.lit(" new, "), F.col("resolved").cast("string"), F.lit(" resolved."))
    advice = F.when(F.col("new_high") > 0, "Look at the new findings of high severity first.").when(step < 0, "Look at what made the score fall.").when(F.col("new") > 0, "Look at the new findings.").otherwise("Nothing to do.")
    return one.select("*", step.alias("step"), text.alias("summary"), advice.alias("advice"))


def health_summary(before: DataFrame, after: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """One row from two runs' dimensions (dimension, score): how many improved, regressed or stayed, and the mean scores."""
    both = before.select("dimension", F.col("score").alias("a")).join(after.select("dimension", F.col("score").alias("b")), "dimension", "full_outer").fillna(0)
    step = F.col("b") - F.col("a")
    return both.agg(F.count_if(step > tolerance).alias("improved"), F.count_if(step < -tolerance).alias("regressed"), F.count_if(F.abs(step) <= tolerance).alias("unchanged"), F.round(F.avg("a"), 6).alias("before"), F.round(F.avg("b"), 6).alias("after"))


def explanation(scorecard: DataFrame, contributors: DataFrame, by: list[str]) -> DataFrame:
    """(key..., adjusted, lost, greatest, worst, critical, reduction, estimate): what each score lost, its greatest contributor, the worst and the critical dimensions, what reduced or capped it, and what mending the three greatest contributors is worth (null if no more than five points)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score_gain"), F.desc("signals"), "collector_id", "signal_type")
    top = contributors.withColumn("r", F.row_number().over(w)).where("r <= 3")
    gained = top.groupBy(*by).agg(F.round(F.sum("score_gain"), 6).alias("gain"), F.min_by(F.concat_ws("/", "collector_id", "signal_type"), "r").alias("greatest"))
    pairs = F.array(*[F.struct(F.col(d).alias("score"), F.lit(d).alias("dimension")) for d in sorted(S.WEIGHTS)])
    critical = F.array_join(F.transform(F.filter(pairs, lambda p: p["score"] < 50), lambda p: p["dimension"]), ",")
    estimate = F.least(F.lit(100), F.col("adjusted") + F.floor(F.coalesce("gain", F.lit(0.0))).cast("int"))
    reduced = F.when(F.col("adjusted") < F.col("base"), F.concat(F.lit("reduced from "), F.col("base").cast("string"), F.when(F.col("caps") != "", F.concat(F.lit(" by "), F.col("caps"))).otherwise(""))).otherwise("")
    return scorecard.join(gained, by, "left").select(
        *by, "adjusted", (100 - F.col("adjusted")).alias("lost"), F.coalesce("greatest", F.lit("")).alias("greatest"), F.array_min(pairs)["dimension"].alias("worst"), critical.alias("critical"), reduced.alias("reduction"),
        F.when(estimate > F.col("adjusted") + 5, estimate).alias("estimate"),
    )


def collector_metrics(known: DataFrame, interpreted: DataFrame) -> DataFrame:
    """(collector_id, metric, value): of every registered check its findings, the documents that have one, their share of all, and the findings of each severity."""
    spark = known.sparkSession
    checks = spark.createDataFrame([(name,) for name in C.REGISTRY], "collector_id string")
    per = interpreted.groupBy("collector_id").agg(F.count("*").alias("findings"), F.countDistinct("uri").alias("documents"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in S.RANKS])
    total = known.agg(F.count("*").alias("total"))
    wide = checks.join(per, "collector_id", "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    values = {"findings": F.col("findings"), "documents": F.col("documents"), "share": F.when(F.col("total") > 0, F.round(F.col("documents") / F.col("total"), 6)).otherwise(0.0)} | {s.lower(): F.col(s.lower()) for s in S.RANKS}
    return wide.select("collector_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("m")).select("collector_id", "m.*")


def collector_reports(kb: C.KnowledgeBase, found: DataFrame) -> DataFrame:
    """(collector_id, score, severity): what each check says of the whole corpus by itself, before any policy, from its findings' number or share."""
    n = lambda kind: F.count_if(F.col("signal_type") == kind)
    of = lambda collector: F.count_if(F.col("collector_id") == collector)
    counts = found.agg(
        n("mixed_topics").alias("mixed"), n("dangling_reference").alias("dangling"), of("heading_quality").alias("headings"), (n("placeholder") + n("numbered_only")).alias("bad_headings"), of("terminology_consistency").alias("terms"), of("contradiction_detection").alias("claims"),
        n("missing_canonical_source").alias("canonical"), n("stale_content").alias("stale"), n("no_date_signal").alias("undated"), n("orphan_artifact").alias("unreached"), n("orphan").alias("orphans"), n("incomplete_workflow").alias("incomplete"),
    )
    shared = C.signatures(kb.traits).groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    one = [kb.artifacts.agg(F.count("*").alias("total")), kb.resolved.agg(F.count_if(F.col("resolved").isNull()).alias("broken")), shared.agg(F.count("*").alias("copies")), C.guides(kb.traits).agg(F.count("*").alias("guides")), C.topic_measures(kb.artifacts).agg(F.coalesce(F.avg("entropy"), F.lit(0.0)).alias("entropy"))]
    for x in one:
        counts = counts.crossJoin(F.broadcast(x))  # one row each
    c = F.col
    share = lambda x, of_what, most: (x * most / F.greatest(of_what, F.lit(1))).cast("int")
    graded = lambda high, medium: F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    told = {
        "topic_purity": (100 - c("mixed") * 15 - (c("entropy") * 10).cast("int"), F.when(c("mixed") > 0, "HIGH").otherwise("LOW")),
        "context_independence": (100 - c("dangling") * 10, F.when(c("dangling") > 0, "MEDIUM").otherwise("LOW")),
        "heading_quality": (100 - c("headings") * 5, graded(c("bad_headings") > 0, c("headings") > 0)),
        "terminology_consistency": (100 - share(c("terms"), c("total"), 50), graded(c("terms") > c("total") * 0.2, c("terms") > 0)),
        "contradiction_detection": (100 - c("claims") * 10, graded(c("claims") > 5, c("claims") > 0)),
        "canonical_source": (100 - c("canonical") * 3 - c("copies") * 10, graded(c("copies") > 3, (c("canonical") > 0) | (c("copies") > 0))),
        "freshness": (100 - share(c("stale") + c("undated"), c("total"), 100), graded(c("stale") > c("total") * 0.3, (c("stale") > 0) | (c("undated") > c("total") * 0.5))),
        "knowledge_connectivity": (100 - share(c("unreached"), c("total"), 100), graded(c("unreached") > c("total") * 0.3, c("unreached") > 0)),
        "link_integrity": (100 - c("broken") * 5 - c("orphans") * 2, graded(c("broken") > 5, (c("broken") > 0) | (c("orphans") > 0))),
        "workflow_completeness": (F.when(c("guides") == 0, 100).otherwise(share(c("guides") - c("incomplete"), c("guides"), 100)), graded(c("incomplete") > c("guides") * 0.5, c("incomplete") > 0)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("collector_id"), F.greatest(F.lit(0), score).cast("int").alias("score"), severity.alias("severity")) for k, (score, severity) in told.items()])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def examples(interpreted: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(severity, r, uri, collector_id, signal_type): of each severity as many examples as its limit says."""
    w = Window.partitionBy("severity").orderBy("uri", "collector_id", "signal_type", "signal_id", "occurrence")
    most = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("severity"))
    few = interpreted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(limits.values()))
    return few.where(F.col("r") <= F.coalesce(most, F.lit(0))).select("severity", "r", "uri", "collector_id", "signal_type")


def type_summary(interpreted: DataFrame, n: int = 5) -> DataFrame:
    """(signal_type, signals, documents, sample): counts by kind, with the first n documents."""
    counts = interpreted.groupBy("signal_type").agg(F.count("*").alias("signals"), F.countDistinct("uri").alias("documents"))
    w = Window.partitionBy("signal_type").orderBy("uri")
    first = interpreted.select("signal_type", "uri").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return counts.join(first.groupBy("signal_type").agg(F.array_join(F.array_sort(F.collect_list("uri")), " ").alias("sample")), "signal_type")


def documents_with_signals(known: DataFrame, interpreted: DataFrame) -> DataFrame:
    """(uri, signals, kinds): every document with its findings' number and the sorted set of their kinds."""
    per = interpreted.groupBy("uri").agg(F.count("*").alias("signals"), F.array_join(F.array_sort(F.collect_set("signal_type")), ",").alias("kinds"))
    return known.select("uri").join(per, "uri", "left").select("uri", F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def first_rows(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group. Each task keeps n of a group before anything is shuffled (a limit on the rank, which Spark applies to parts and then to their union), so a group may have any size."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n)


def _sampled(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """(key..., sample): the first n findings of each group as `uri:line`, one after another."""
    mark = F.concat_ws(":", "uri", F.col("line").cast("string"))
    few = first_rows(rows, by, ["uri", F.col("line").asc_nulls_first(), "signal_id", "occurrence"], n)
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", mark.alias("mark")))), lambda x: x["mark"]), " ").alias("sample"))


def contributor_details(interpreted: DataFrame, causes: DataFrame, n: int = 5) -> DataFrame:
    """What costs how much, by dimension, check, kind and cause: findings, documents, highest severity, penalty, the gains of mending them, recommendation and the first n findings. causes: see `causes`; findings without one have their kind as cause."""
    spark = interpreted.sparkSession
    checks = spark.createDataFrame([(name, d) for name, (d, _, _) in C.REGISTRY.items()], "collector_id string, dimension string")
    sizes = checks.groupBy("dimension").agg(F.count("*").alias("checks")).join(spark.createDataFrame(list(S.WEIGHTS.items()), "dimension string, weight double"), "dimension")
    named = causes.select("uri", "collector_id", "signal_type", F.coalesce("line", F.lit(-1)).alias("at"), "cause").groupBy("uri", "collector_id", "signal_type", "at").agg(F.min("cause").alias("cause"))
    keys = ["dimension", "collector_id", "signal_type", "cause"]
    found = interpreted.withColumn("at", F.coalesce("line", F.lit(-1))).join(named, ["uri", "collector_id", "signal_type", "at"], "left").withColumn("cause", F.coalesce("cause", "signal_type")).join(F.broadcast(checks), "collector_id")  # one row a check
    per = found.groupBy(*keys).agg(F.count("*").alias("signals"), F.countDistinct("uri").alias("documents"), F.sum("penalty").alias("penalty"), F.max_by("severity", severity_rank("severity")).alias("severity"), F.min("recommendation").alias("recommendation"))
    total = interpreted.groupBy("collector_id").agg(F.sum("penalty").alias("total"))
    gain = F.greatest(F.lit(0), 100 - F.greatest(F.lit(0), F.col("total") - F.col("penalty"))) - F.greatest(F.lit(0), 100 - F.col("total"))
    joined = per.join(F.broadcast(total), "collector_id").join(F.broadcast(sizes), "dimension").withColumn("collector_gain", gain)  # a row a check, a row a dimension
    scored = joined.withColumn("dimension_gain", F.round(F.col("collector_gain") / F.col("checks"), 6)).withColumn("score_gain", F.round(F.col("collector_gain") / F.col("checks") * F.col("weight"), 6))
    return scored.join(_sampled(found, keys, n), keys).select(*keys, "signals", "documents", "severity", "penalty", "collector_gain", "dimension_gain", "score_gain", "recommendation", "sample")


def type_details(interpreted: DataFrame, n: int = 5) -> DataFrame:
    """(signal_type, severity, signals, documents, sample): counts by kind and severity with the first n findings."""
    keys = ["signal_type", "severity"]
    return interpreted.groupBy(*keys).agg(F.count("*").alias("signals"), F.countDistinct("uri").alias("documents")).join(_sampled(interpreted, keys, n), keys)


def cluster_details(interpreted: DataFrame) -> DataFrame:
    """(collector_id, signal_type, uri, n, representative, ids): the findings of one kind in one document, the first of them in words, and the ids of all; a cluster is part of one document."""
    text = F.concat(*[x for c, name in (("collector_id", "collector"), ("signal_type", "type"), ("severity", "severity"), ("uri", "artifact")) for x in (F.lit(f"{name}="), F.col(c), F.lit(", "))], F.lit("recommendation="), F.coalesce("recommendation", F.lit("")))
    first = F.min_by(text, F.struct(F.coalesce("line", F.lit(-1)), "signal_id", "occurrence"))
    return interpreted.groupBy("collector_id", "signal_type", "uri").agg(F.count("*").alias("n"), first.alias("representative"), F.array_join(F.array_sort(F.collect_set("signal_id")), " ").alias("ids"))


def top_directions(changes: DataFrame, n: int = 5) -> DataFrame:
    """The n greatest regressions and the n greatest improvements of contributor_changes."""
    keys = [c for c in changes.columns if c not in ("gain_delta", "signals_delta", "change")]
    order = [F.desc(F.abs("gain_delta")), F.desc(F.abs("signals_delta")), *keys]
    return first_rows(changes.where("change <> 'unchanged'"), ["change"], order, n)


def strategy_rates(outcomes: DataFrame) -> DataFrame:
    """(strategy, outcomes, successes, rate, mean_attempts) of outcomes (strategy, success, attempt): each strategy's share of successes and the mean attempt of those."""
    won = F.col("success")
    return outcomes.groupBy("strategy").agg(F.count("*").alias("outcomes"), F.count_if(won).alias("successes"), F.round(F.avg(won.cast("int")), 6).alias("rate"), F.round(F.coalesce(F.avg(F.when(won, F.col("attempt"))), F.lit(0.0)), 6).alias("mean_attempts"))


#: Reporting views over stored tables, read by Spark SQL and DuckDB alike; {as_of} is a timestamp literal.
VIEWS = {
    "knowledge_health": "SELECT assessment_id, score, dimensions, signals_count, created_at FROM {assessments} ORDER BY created_at DESC, assessment_id DESC LIMIT 1",
    "signals": "SELECT signal_id, artifact_uri, collector_id, signal_type, severity, score, recommendation, ai_impact, status, last_seen, access_count, created_at FROM {signals}",
    "problem_queue": "SELECT problem_id, category, artifact_uris, salience, encoding_score, outcome_score, retrieval_score, staleness_factor, status, description, created_at, updated_at FROM {problems} WHERE salience > 0",
    "remediation_history": "SELECT outcome_id, issue_type, strategy, strategy_description, verification_outcome, score_before, score_after, proposal_reasoning, tokens_used, latency_ms, forked, created_at FROM {outcomes}",
    "health_trend": "SELECT date_trunc('day', created_at) AS day, avg(score) AS avg_score, count(*) AS assessment_count, avg(signals_count) AS avg_signals FROM {assessments} WHERE created_at > {as_of} - INTERVAL '30' DAY GROUP BY date_trunc('day', created_at)",
    "decision_traces": "SELECT t.trace_id, t.outcome_id, t.stage, t.reasoning, t.llm_metadata, t.created_at, h.issue_type, h.strategy FROM {traces} t LEFT JOIN {outcomes} h ON t.outcome_id = h.outcome_id",
    "remediation_metrics": "SELECT count(*) AS total_workflows, count(*) FILTER (WHERE verification_outcome = 'resolved') AS problems_resolved, count(*) FILTER (WHERE verification_outcome = 'partially_resolved') AS problems_partially_resolved, round(avg(score_after - score_before), 6) AS avg_score_improvement, round(avg(tokens_used), 6) AS avg_tokens_per_workflow FROM {outcomes}",
    "assessment_history": "SELECT assessment_id, score, dimensions, signals_count, source, git_commit, created_at FROM {assessments}",
    "remediation_context": "SELECT outcome_id, issue_type, strategy, strategy_description, verification_outcome, score_before, score_after, proposal_reasoning, modification_steps, tokens_used, created_at FROM {outcomes}",
}


def view(spark: SparkSession, name: str, as_of: str = "TIMESTAMP '2024-01-31 00:00:00'", **tables: DataFrame) -> DataFrame:
    """A reporting view over DataFrames named as in its text."""
    return spark.sql(VIEWS[name].replace("{as_of}", as_of), **tables)
