"""What past remediations tell: strategies, similar problems, steps that failed, and which proposals and steps to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbq.session import small, written

# Strategies that say nothing, step types and what becomes of them, and the kinds of findings of each category.
GENERIC_STRATEGIES = ["unknown", "", "manual_review", "fix", "improve"]
IMPLEMENTED_STEPS = ["add_metadata", "update_document", "create_relationship", "create_document"]
DISABLED_STEPS = ["remove_relationship", "archive_artifact", "merge_artifacts", "split_artifact"]
CATEGORY_KINDS = {
    "missing_metadata": ["no_date_signal", "stale_content"],
    "freshness": ["no_date_signal", "stale_content"],
    "stale_content": ["stale_content"],
    "missing_canonical_source": ["missing_canonical_source"],
    "missing_context": ["missing_canonical_source"],
    "broken_links": ["broken_link"],
    "dangling_references": ["dangling_reference"],
    "orphaned_documents": ["orphan_artifact"],
    "orphan_artifact": ["orphan_artifact"],
    "poor_structure": [],
    "duplicate_content": ["duplicate_content"],
    "terminology_inconsistency": ["terminology_variant"],
}


def strategy_outcomes(outcomes: DataFrame) -> DataFrame:
    """(issue_type, strategy, succeeded, failed, mean_gain) of outcomes (issue_type, strategy, verification_outcome, score_before, score_after)."""
    ok, bad = F.col("verification_outcome") == "resolved", F.col("verification_outcome").isin("unchanged", "regressed", "misdiagnosed")
    return outcomes.groupBy("issue_type", "strategy").agg(F.count_if(ok).alias("succeeded"), F.count_if(bad).alias("failed"), F.round(F.avg(F.col("score_after") - F.col("score_before")), 6).alias("mean_gain"))


def strategies_for(issues: DataFrame, outcomes: DataFrame, n: int = 3) -> DataFrame:
    """(issue_type, strategy, succeeded, fallback): of each issue in issues(issue_type) the n strategies that succeeded most; an issue without history takes those of all issues."""
    won = strategy_outcomes(outcomes).where("succeeded > 0").select("issue_type", "strategy", "succeeded")
    best = won.withColumn("r", F.row_number().over(Window.partitionBy("issue_type").orderBy(F.desc("succeeded"), "strategy"))).where(F.col("r") <= n).drop("r")
    asked = issues.select("issue_type").distinct()
    known = asked.join(best, "issue_type").withColumn("fallback", F.lit(False))
    overall = won.groupBy("strategy").agg(F.sum("succeeded").alias("succeeded")).orderBy(F.desc("succeeded"), "strategy").limit(n)
    rest = asked.join(best.select("issue_type"), "issue_type", "left_anti").crossJoin(F.broadcast(overall)).withColumn("fallback", F.lit(True))  # n rows
    return known.unionByName(rest)


def similar(problems: DataFrame, outcomes: DataFrame, n: int = 5) -> DataFrame:
    """(problem_id, outcome_id, overlaps): of each problem (problem_id, issue_type, uris) the n newest outcomes (outcome_id, issue_type, uris, created_at) of its type that share a document, or, if none does, the n newest of its type.

    Of a type and document only the n newest outcomes can be among a problem's n newest, so those are found before problems
    meet them by an equi-join on (type, document): a problem meets n outcomes a document, however many there are.
    """
    order = [F.desc("created_at"), F.col("outcome_id")]
    first = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")
    newest = first(outcomes, "issue_type").select("issue_type", "outcome_id")
    mine = problems.select("problem_id", "issue_type", F.explode(F.array_distinct("uris")).alias("uri"))
    each = outcomes.select("issue_type", "outcome_id", "created_at", F.explode(F.array_distinct("uris")).alias("uri")).groupBy("issue_type", "uri", "outcome_id").agg(F.max("created_at").alias("created_at"))
    theirs = written(first(each, "issue_type", "uri"), "newest")
    met = mine.join(theirs, ["issue_type", "uri"]).groupBy("problem_id", "outcome_id").agg(F.max("created_at").alias("created_at"))
    close = written(first(met, "problem_id").select("problem_id", "outcome_id", F.lit(True).alias("overlaps")), "close")
    other = problems.select("problem_id", "issue_type").join(close.select("problem_id").distinct(), "problem_id", "left_anti").join(newest, "issue_type")
    return close.unionByName(other.select("problem_id", "outcome_id", F.lit(False).alias("overlaps")))


def drop_failed(steps: DataFrame, failed: DataFrame) -> DataFrame:
    """steps without those whose (signal_type, uri) failed before."""
    return steps.join(failed.select("signal_type", "uri").distinct(), ["signal_type", "uri"], "left_anti")


def first_of_duplicates(steps: DataFrame) -> DataFrame:
    """steps (proposal, step, step_type, uri, description) without later ones of the same type, document and description (in small letters, white space as one space)."""
    plain = F.lower(F.trim(F.regexp_replace("description", r"\s+", " ")))
    w = Window.partitionBy("step_type", "uri", plain).orderBy("proposal", "step")
    return steps.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def distinct_proposals(steps: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals (proposal, ...) with n_steps, the steps that are left to them by `first_of_duplicates`; emptied ones are dropped."""
    return proposals.join(first_of_duplicates(steps).groupBy("proposal").agg(F.count("*").alias("n_steps")), "proposal")


def acceptable(proposals: DataFrame, failed: DataFrame) -> DataFrame:
    """proposals (strategy, description, n_steps) that name a strategy, describe it in 20 characters or more, have a step and did not fail before."""
    low = F.lower("strategy")
    kept = proposals.where(~F.coalesce(low, F.lit("")).isin(GENERIC_STRATEGIES) & (F.length(F.trim("description")) >= 20) & (F.col("n_steps") > 0))
    return kept.join(failed.select(low.alias("lost")).distinct(), F.lower("strategy") == F.col("lost"), "left_anti")


def constrain(steps: DataFrame, replacements: DataFrame) -> DataFrame:
    """steps (step_type, signal_type, ...) with `action` and `to_type`: implemented types are kept; disabled ones are replaced by the type that replacements(signal_type, to_type) gives for the finding, or skipped; unknown ones are skipped."""
    joined = steps.join(small(replacements), "signal_type", "left")
    ready, off = F.col("step_type").isin(IMPLEMENTED_STEPS), F.col("step_type").isin(DISABLED_STEPS)
    action = F.when(ready, "kept").when(off & F.col("to_type").isNotNull(), "replaced").when(off, "skipped_disabled").otherwise("skipped_unknown")
    return joined.withColumn("action", action).withColumn("to_type", F.when(ready, F.col("step_type")).when(F.col("action") == "replaced", F.col("to_type")))


def kinds_of(categories: DataFrame) -> DataFrame:
    """categories(category) with the kinds of findings they stand for, one row each."""
    rows = [(c, k) for c, kinds in CATEGORY_KINDS.items() for k in kinds]
    return categories.join(F.broadcast(categories.sparkSession.createDataFrame(rows, "category string, signal_type string")), "category")


def step_results(steps: DataFrame, by: list[str]) -> DataFrame:
    """(key..., steps, applied, skipped, failed, verify) of executed steps (applied, success): whether there is anything to verify: a step applied, none failed."""
    per = steps.groupBy(*by).agg(F.count("*").alias("steps"), F.count_if(F.col("applied") & F.col("success")).alias("applied"), F.count_if(~F.col("applied")).alias("skipped"), F.count_if(F.col("applied") & ~F.col("success")).alias("failed"))
    return per.withColumn("verify", (F.col("applied") > 0) & (F.col("failed") == 0))


def modified_uris(steps: DataFrame) -> DataFrame:
    """Documents that an applied step changed."""
    return steps.where(F.col("applied") & F.col("success")).select("uri").distinct()


def queue_summary(queue: DataFrame) -> DataFrame:
    """(status, category, problems, salience): the queue counted by status and by category (the other is null)."""
    return queue.groupingSets([[F.col("status")], [F.col("category")]], "status", "category").agg(F.count("*").alias("problems"), F.round(F.sum("salience"), 4).alias("salience"))


def memory_summary(outcomes: DataFrame) -> DataFrame:
    """(issue_type, avoided, reused, best): of each type the failures to avoid, strategies used more than once, and the one of those with the highest mean gain."""
    per = strategy_outcomes(outcomes).withColumn("uses", F.col("succeeded") + F.col("failed"))
    again = F.col("uses") > 1
    best = F.max_by(F.when(again, F.col("strategy")), F.when(again, F.struct("mean_gain", "strategy")))
    return per.groupBy("issue_type").agg(F.sum("failed").alias("avoided"), F.count_if(again).alias("reused"), best.alias("best"))


#: What a proposed step of a type settles besides the kind it names.
IMPLIED_KINDS = {"add_metadata:date": ["no_date_signal", "stale_content"], "update_document:add_canonical_link": ["missing_canonical_source"], "create_relationship:": ["orphan_artifact"]}


def covered(steps: DataFrame) -> DataFrame:
    """(signal_type, uri) that steps (step_type, signal_type, uri, detail) settle: the kind a step names, and those that its type and detail (metadata key or action) imply."""
    rows = [(k.split(":")[0], k.split(":")[1], kind) for k, kinds in IMPLIED_KINDS.items() for kind in kinds]
    implied = steps.sparkSession.createDataFrame(rows, "step_type string, needs string, implied string")
    more = steps.join(F.broadcast(implied), "step_type").where("needs = '' or needs = detail").select(F.col("implied").alias("signal_type"), "uri")
    return steps.where(F.coalesce("signal_type", F.lit("")) != "").select("signal_type", "uri").unionByName(more).distinct()


def uncovered(concrete: DataFrame, steps: DataFrame, failed: DataFrame) -> DataFrame:
    """The mapped steps (signal_type, uri, ...) of findings that no proposed step settles and that did not fail before."""
    return drop_failed(concrete, failed).join(covered(steps), ["signal_type", "uri"], "left_anti")


def place_mapped(steps: DataFrame, concrete: DataFrame, failed: DataFrame, confidence: DataFrame, outcomes: DataFrame, by: str, sure: float = 0.6) -> DataFrame:
    """(by, settled, uncovered, first): whether the mapped steps go before a run's own proposals.

    They do, unless they were tried and failed (outcomes: by, strategy, verification_outcome), or the proposals are a
    better challenger: they settle more mapped findings than are left, and the first one's confidence (confidence: by,
    confidence) is at least `sure`. All rows carry the run's key `by`; without uncovered steps there is nothing to place.
    """
    keys = [by, "signal_type", "uri"]
    rows = [(k.split(":")[0], k.split(":")[1], kind) for k, kinds in IMPLIED_KINDS.items() for kind in kinds]
    implied = steps.sparkSession.createDataFrame(rows, "step_type string, needs string, implied string")
    more = steps.join(F.broadcast(implied), "step_type").where("needs = '' or needs = detail").select(by, F.col("implied").alias("signal_type"), "uri")
    settled = steps.where(F.coalesce("signal_type", F.lit("")) != "").select(*keys).unionByName(more).distinct().withColumn("hit", F.lit(True))
    open_steps = concrete.select(*keys).distinct().join(failed.select("signal_type", "uri").distinct(), ["signal_type", "uri"], "left_anti")
    per = open_steps.join(settled, keys, "left").groupBy(by).agg(F.count_if(F.col("hit")).alias("settled"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    lost = outcomes.where((F.lower("strategy") == "signal_mapped_remediation") & F.col("verification_outcome").isin("misdiagnosed", "unchanged", "regressed")).select(by).distinct().withColumn("lost", F.lit(True))
    judged = per.join(confidence.groupBy(by).agg(F.max("confidence").alias("confidence")), by, "left").join(lost, by, "left").where("uncovered > 0")
    challenger = (F.col("settled") > F.col("uncovered")) & (F.coalesce("confidence", F.lit(0.0)) >= sure)
    return judged.select(by, "settled", "uncovered", (F.col("lost").isNull() & ~challenger).alias("first"))


def outcome_records(runs: DataFrame) -> DataFrame:
    """What is remembered of runs (run_id, stage, categories, strategies, score_before, score_after, outcome, explanation, attempt): a success if the run was completed, else a failure with its explanation; the first category and strategy, or `unknown`."""
    done = F.col("stage") == "completed"
    first = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(1)), F.lit("unknown"))
    return runs.select(
        "run_id", first("categories").alias("issue_type"), first("strategies").alias("strategy"), F.when(done, "success").otherwise("failure").alias("result"), "score_before", "score_after", (F.col("score_after") - F.col("score_before")).alias("score_change"),
        F.when(done, "").otherwise(F.coalesce("explanation", F.lit(""))).alias("failure_reason"), F.coalesce("attempt", F.lit(1)).alias("attempt"), F.coalesce("outcome", F.lit("")).alias("verification_outcome"),
    )


def memory_influence(issues: DataFrame, outcomes: DataFrame, scores: DataFrame) -> DataFrame:
    """(issue_type, retrieved, avoided, reused, rationale): what earlier outcomes say of each issue in issues(issue_type).

    A strategy that succeeded with the greatest change of score is reused; else failed ones are avoided; else the best of
    scores (issue_type, strategy, adjusted) is suggested; else there is nothing to go by.
    """
    ok, bad = F.col("verification_outcome") == "resolved", F.col("verification_outcome").isin("unchanged", "regressed", "misdiagnosed")
    change = F.col("score_after") - F.col("score_before")
    per = outcomes.groupBy("issue_type").agg(F.count("*").alias("retrieved"), F.countDistinct(F.when(bad, F.col("strategy"))).alias("avoided"), F.max_by(F.when(ok, F.col("strategy")), F.when(ok, F.struct(change, "strategy"))).alias("won"))
    best = scores.groupBy("issue_type").agg(F.max_by("strategy", F.struct("adjusted", "strategy")).alias("suggested"))
    joined = issues.select("issue_type").distinct().join(per, "issue_type", "left").join(best, "issue_type", "left").fillna(0, ["retrieved", "avoided"])
    rationale = F.when(F.col("won").isNotNull(), "reused").when(F.col("avoided") > 0, "avoided").when(F.col("suggested").isNotNull(), "suggested").otherwise("none")
    return joined.select("issue_type", "retrieved", "avoided", F.coalesce("won", F.when(rationale == "suggested", F.col("suggested"))).alias("reused"), rationale.alias("rationale"))


def merged_context(issues: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(issue_type, source, attempts, successful, failed): the history of each issue from the primary store's outcomes, or from the secondary's where the primary has none; strategies in alphabetical order."""

    def told(outcomes: DataFrame, name: str) -> DataFrame:
        names = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("strategy")))), ",")
        good = F.col("verification_outcome").isin("resolved", "partially_resolved")
        return outcomes.groupBy("issue_type").agg(F.lit(name).alias("source"), F.count("*").alias("attempts"), names(good).alias("successful"), names(~good).alias("failed"))

    asked = issues.select("issue_type").distinct()
    one, two = told(primary, "primary"), told(secondary, "secondary")
    found = asked.join(one, "issue_type").unionByName(asked.join(one, "issue_type", "left_anti").join(two, "issue_type"))
    none = asked.join(found, "issue_type", "left_anti").select("issue_type", F.lit("none").alias("source"), F.lit(0).cast("long").alias("attempts"), F.lit("").alias("successful"), F.lit("").alias("failed"))
    return found.unionByName(none)
