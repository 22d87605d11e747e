"""Histories in blocks, samples, hubs, memory and configurations on hand-written cases."""

import random

import pytest
from pyspark.sql import functions as F

from kbq.operators import collectors, graph, history, incremental, memory, reports, scoring, store, validation
from kbq.operators import problems as P
from kbq.session import prepare


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_ema_in_blocks_equals_the_loop(spark):
    """One strategy with most outcomes, cut into many blocks; both starts."""
    rng = random.Random(1)
    data = [("i", "hot", at, rng.choice([0.0, 0.5, 1.0])) for at in range(400)] + [("i", "rare", 3, 1.0), ("j", "hot", 5, 0.0), ("j", "hot", 4, 1.0)]
    df = spark.createDataFrame(data, "issue_type string, strategy string, at long, value double").repartition(6)
    for start in (0.5, None):
        want = {}
        for issue, strategy, _, value in sorted(data, key=lambda r: r[2]):
            old = want.get((issue, strategy), start)
            want[issue, strategy] = value if old is None else 0.7 * old + 0.3 * value
        found = {(r["issue_type"], r["strategy"]): r["ema"] for r in history.ema(df, start=start).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    best = history.floored(history.ema(df), 0.9, ["issue_type"])
    assert all(r["adjusted"] >= r["ema"] and r["floor_applied"] == (r["adjusted"] > r["ema"]) for r in best.collect())


def test_runs_and_series(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "signal_id string")
    assert rows(history.eligibility(ids("a", "a", "b"), None)) == [(True, 2, 0, 0)]
    assert rows(history.eligibility(ids("a", "b"), ids("b", "c"))) == [(True, 1, 1, 1)]
    assert rows(history.eligibility(ids("b"), ids("b", "c"))) == [(False, 0, 1, 1)]
    runs = spark.createDataFrame([(1, 50), (2, 53), (3, 54), (4, 40)], "run int, score int")
    assert rows(history.series(runs)) == [(1, 50, None, "unknown"), (2, 53, 3, "stable"), (3, 54, 1, "improving"), (4, 40, -14, "worsening")]
    metrics = lambda **v: spark.createDataFrame(list(v.items()), "metric string, value int")
    assert rows(history.clipped_rises(metrics(a=3, b=1), metrics(a=1, c=2))) == [("a", 0), ("b", 0), ("c", 2)]


def test_neighbours(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "uri string")
    edges = spark.createDataFrame([("a", "b", "parent_child"), ("a", "a", "cross_reference"), ("b", "a", "cross_reference"), ("c", "c", "cross_reference")], "source_uri string, target_uri string, relation_type string")
    assert rows(graph.neighbours(known, edges)) == [("a", 1, 0, 1, 2, True), ("b", 0, 1, 1, 0, True), ("c", 0, 0, 1, 1, False)]


def test_details_of_reports(spark):
    kb = collectors.KnowledgeBase.of(spark.createDataFrame([(f"d{i}.md", "# TODO\n\nSee above, see above.\n\n## TODO\n\n[x](gone.md)") for i in range(7)], "uri string, text string"))
    found = scoring.interpret(collectors.signals(kb), scoring.policy(spark))
    details = reports.contributor_details(found, reports.causes(kb), n=3).where("signal_type in ('placeholder', 'broken_link')")
    assert rows(details, "signal_type", "cause", "signals", "documents", "sample") == [("broken_link", "gone.md", 7, 7, "d0.md d1.md d2.md"), ("placeholder", "TODO", 14, 7, "d0.md:1 d0.md:5 d1.md:1")]
    clusters = reports.cluster_details(found.where("signal_type = 'placeholder' and uri = 'd0.md'"))
    assert rows(clusters, "n") == [(2,)] and clusters.first()["representative"].startswith("collector=heading_quality, type=placeholder, severity=")
    tried = spark.createDataFrame([("a", True, 1), ("a", True, 2), ("a", False, 9), ("b", False, 1)], "strategy string, success boolean, attempt int")
    assert rows(reports.strategy_rates(tried)) == [("a", 3, 2, 0.666667, 1.5), ("b", 1, 0, 0.0, 0.0)]


def test_hubs(spark):
    docs = spark.createDataFrame([("h1", "one  \n"), ("h2", "two"), ("o1", "x"), ("o2", "y")], "uri string, text string")
    titles = spark.createDataFrame([("h1", "Install guide"), ("h2", "Other"), ("o1", "The Guide book"), ("o2", "Guide install")], "uri string, title string")
    hubs, lost = docs.where("uri like 'h%'").select("uri"), docs.where("uri like 'o%'").select("uri")
    found = dict(rows(validation.link_from_hubs(docs, lost, hubs, titles, ["the"])))
    assert found == {"h1": "one\n\n## Additional Resources\n\n- [Guide install](o2)\n- [The Guide book](o1)\n", "h2": "two", "o1": "x", "o2": "y"}


def test_steps_and_memory(spark):
    steps = spark.createDataFrame([("add_metadata", None, "a", "date"), ("create_relationship", "", "b", ""), ("update_document", "placeholder", "c", "rewrite")], "step_type string, signal_type string, uri string, detail string")
    assert rows(memory.covered(steps), "signal_type", "uri") == [("no_date_signal", "a"), ("orphan_artifact", "b"), ("placeholder", "c"), ("stale_content", "a")]
    mapped = spark.createDataFrame([("no_date_signal", "a"), ("no_date_signal", "b"), ("orphan_artifact", "c"), ("orphan_artifact", "d")], "signal_type string, uri string")
    failed = spark.createDataFrame([("orphan_artifact", "d")], "signal_type string, uri string")
    assert rows(memory.uncovered(mapped, steps, failed)) == [("no_date_signal", "b"), ("orphan_artifact", "c")]
    runs = spark.createDataFrame([("r", "completed", ["c1", "c2"], [], 5, 9, "resolved", "why", None), ("s", "failed", [], ["x"], 5, 4, None, None, 3)], "run_id string, stage string, categories array<string>, strategies array<string>, score_before int, score_after int, outcome string, explanation string, attempt int")
    assert rows(memory.outcome_records(runs)) == [("r", "c1", "unknown", "success", 5, 9, 4, "", 1, "resolved"), ("s", "unknown", "x", "failure", 5, 4, -1, "", 3, "")]


def test_verified_lifecycle_and_configuration(spark):
    state = spark.createDataFrame([("a", "1", "1", "persistent"), ("b", "1", "1", "resolved"), ("c", "1", "1", "resolved")], "signal_id string, first_run string, last_run string, status string")
    told = spark.createDataFrame([("a", True), ("b", False)], "signal_id string, gone boolean")
    assert rows(store.verified(state, told), "signal_id", "status") == [("a", "resolved"), ("b", "recurring"), ("c", "resolved")]
    plain, fewer = incremental.configuration(spark), incremental.configuration(spark, [n for n in collectors.REGISTRY if n != "freshness"], versions={"topic_purity": "2.0"})
    assert rows(incremental.mismatch(plain, fewer)) == [("check=freshness@1.0", "removed"), ("check=topic_purity@1.0", "removed"), ("check=topic_purity@2.0", "added")]
    heavier = incremental.configuration(spark, policy=scoring.policy(spark).withColumn("penalty", F.col("penalty") + 1))
    digest = lambda df: incremental.fingerprint(df.withColumn("k", F.lit(1)), ["k"]).first()["digest"]
    assert len({digest(plain), digest(fewer), digest(heavier)}) == 3 and incremental.mismatch(plain, incremental.configuration(spark)).count() == 0


def test_frozen_constants(spark):
    """Policy and weights against the table they are to equal: nothing is left on either side."""
    expected = [
        ("topic_purity", "mixed_topics", "HIGH", 15), ("context_independence", "dangling_reference", "MEDIUM", 10), ("freshness", "stale_content", "MEDIUM", 10), ("freshness", "no_date_signal", "LOW", 5), ("knowledge_connectivity", "orphan_artifact", "MEDIUM", 10),
        ("contradiction_detection", "version_conflict", "HIGH", 15), ("canonical_source", "duplicate_content", "HIGH", 15), ("terminology_consistency", "terminology_variant", "MEDIUM", 10), ("workflow_completeness", "incomplete_workflow", "MEDIUM", 10),
    ]
    names = "collector_id string, signal_type string, severity string, penalty int"
    held = scoring.policy(spark).select("collector_id", "signal_type", "severity", "penalty")
    assert spark.createDataFrame(expected, names).join(held, [n.split()[0] for n in names.split(", ")], "left_anti").collect() == []
    assert abs(sum(scoring.WEIGHTS.values()) - 1) < 1e-12 and set(scoring.WEIGHTS) == {d for d, _, _ in collectors.REGISTRY.values()}


def test_proposals_without_more_knowledge(spark):
    """The first cause is addressed unless it has no category or was tried; a problem for each hypothesis; steps of clusters, the most salient first."""
    rows = [("a", 1, "x", "h1", ["e1", "e2"], ["u1", "u2"]), ("a", 0, "y", "h0", [], ["u1"]), ("b", 0, None, "h", None, None), ("c", 0, "y", "h", ["e"], []), ("d", 0, "", "h", ["e"], ["u"])]
    causes = spark.createDataFrame(rows, "run_id string, idx long, category string, hypothesis string, evidence array<string>, uris array<string>")
    tried = spark.createDataFrame([("c", "y"), ("c", "y"), ("a", "x")], "run_id string, strategy string")
    got = {r["run_id"]: (r["strategy"], r["causes"]) for r in P.basic_proposals(causes, tried).collect()}
    assert got == {"a": ("address_y", 2), "b": ("manual_review", 1), "c": ("manual_review", 1), "d": ("manual_review", 1)}
    found = sorted((r["run_id"], r["problem_id"], r["evidence_summary"] or "", r["uri"] or "") for r in P.hypothesis_problems(causes).collect())
    assert found == [("a", "kp_x_1", "e1; e2", "u1"), ("a", "kp_x_1", "e1; e2", "u2"), ("a", "kp_y_0", "", "u1"), ("b", "kp_unknown_0", "", ""), ("c", "kp_y_0", "e", ""), ("d", "kp_unknown_0", "e", "u")]
    clustered = spark.createDataFrame([("p1", "u1", "directory", "d/"), ("p2", "u1", "directory", "d/"), ("p3", "u2", "category", "k"), ("p4", "u3", "category", "l"), ("p5", "u4", "singleton", "p5")], "problem_id string, uri string, pattern string, cluster string")
    ranked = spark.createDataFrame([("p1", 0.2), ("p2", 0.4), ("p3", 0.9), ("p4", 0.9)], "problem_id string, salience double")
    steps = sorted((r["cluster"], r["strategy"], r["salience"], r["proposed"], r["uri"]) for r in P.systemic_steps(clustered, ranked, ["systemic_directory"]).collect())
    assert steps == [("d/", "systemic_directory_v2", 0.4, False, "u1"), ("k", "systemic_category", 0.9, True, "u2"), ("l", "systemic_category", 0.9, False, "u3")]
    assert P.systemic_steps(clustered.where("false"), ranked).count() == 0 and P.basic_proposals(causes.where("false"), tried).count() == 0
