"""Queries over details of reports, histories in blocks, hubs, and runs persisted whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import graph
from kbq.operators import history as H
from kbq.operators import incremental as I
from kbq.operators import memory as M
from kbq.operators import reports as R
from kbq.operators import scoring as S
from kbq.operators import store
from kbq.operators import validation as V
from kbq.operators import vector_index
from kbq.plans import oracle, scores, work
from kbq.plans.checks import _big, kb
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import _list, sql
from kbq.plans.runs import _CHANGES, assessments, contributor_changes, outcomes, run_pair, two_runs
from kbq.plans.runs import ORACLES as _RUN_ORACLES
from kbq.plans.scores import _weight, interpreted, run_scores, seen
from kbq.session import prepare, shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle_sql is not None:
            ORACLES[f.__name__] = sql(oracle_sql)
        return f

    return add


@query(f"SELECT issue_type, strategy, n, round(ema, 6) AS ema, round(greatest(ema, 0.3::DOUBLE * max(ema) OVER (PARTITION BY issue_type)), 6) AS adjusted, ema < 0.3::DOUBLE * max(ema) OVER (PARTITION BY issue_type) AS floor_applied FROM (SELECT issue_type, strategy, max(n) AS n, sum(CASE WHEN i = 1 THEN power(0.7::DOUBLE, n - 1) ELSE power(0.7::DOUBLE, n - i) * 0.3::DOUBLE END * value) AS ema FROM {scores._NUMBERED} GROUP BY ALL)")
def strategy_ema_floor(spark, sf_dir):
    found = H.floored(H.ema(scores.outcomes(spark, sf_dir), start=None), 0.3, ["issue_type"])
    return found.select("issue_type", "strategy", "n", F.round("ema", 6).alias("ema"), F.round("adjusted", 6).alias("adjusted"), "floor_applied")


@query("SELECT count(*) + 1 AS run_idx FROM events")
def run_index(spark, sf_dir):
    return H.next_run(outcomes(spark, sf_dir))


@query("SELECT 'first' AS analysis, true AS eligible, count(*) AS \"new\", 0::BIGINT AS unchanged, 0::BIGINT AS removed FROM (SELECT DISTINCT signal_id FROM seen WHERE run = 2) UNION ALL SELECT 'second', count(*) FILTER (p IS NULL) > 0, count(*) FILTER (p IS NULL), count(*) FILTER (p = c), count(*) FILTER (c IS NULL) FROM (SELECT DISTINCT signal_id AS c FROM seen WHERE run = 3) FULL JOIN (SELECT DISTINCT signal_id AS p FROM seen WHERE run = 2) ON p = c UNION ALL SELECT 'same', false, 0, count(DISTINCT signal_id), 0 FROM seen WHERE run = 3")
def signal_delta(spark, sf_dir):
    """Whether a first run, a second one and the same again are worth an analysis."""
    of = lambda n: seen(spark, sf_dir).where(F.col("run") == n)
    rows = {"first": H.eligibility(of(2), None), "second": H.eligibility(of(3), of(2)), "same": H.eligibility(of(3), of(3))}
    out = [df.select(F.lit(k).alias("analysis"), "*") for k, df in rows.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


_back = "coalesce(lag(score, 2) OVER (ORDER BY run), lag(score) OVER (ORDER BY run))"


@query(f"SELECT run, score, score - lag(score) OVER (ORDER BY run) AS delta, CASE WHEN {_back} IS NULL THEN 'unknown' WHEN score - {_back} > 3 THEN 'improving' WHEN score - {_back} < -3 THEN 'worsening' ELSE 'stable' END AS trend FROM runs")
def trend_series(spark, sf_dir):
    return _big(H.series(run_scores(spark, sf_dir)), "run").withColumn("score", F.col("score").cast("int")).withColumn("delta", F.col("delta").cast("int"))


@query("""SELECT signal_id, last_seen::BIGINT AS last_seen, CASE WHEN last_seen = (SELECT max(run) FROM seen) THEN 'recurring' ELSE 'resolved' END AS status FROM (SELECT signal_id, max(run) AS last_seen, coalesce(bool_or(run - p > 1), false) AS gap FROM (SELECT *, lag(run) OVER (PARTITION BY signal_id ORDER BY run) AS p FROM seen) GROUP BY signal_id)
  WHERE (last_seen = (SELECT max(run) FROM seen) AND gap) OR last_seen = (SELECT max(run) FROM seen) - 1""")
def returned_and_resolved(spark, sf_dir):
    """Findings that came back, and those that the last run resolved."""
    state = H.lifecycle(seen(spark, sf_dir))
    last = seen(spark, sf_dir).agg(F.max("run")).first()[0]
    return _big(H.with_status(state, ["recurring"]).unionByName(H.with_status(state, ["resolved"], last)).select("signal_id", "last_seen", "status"), "last_seen")


@query("""SELECT a.uri, 0::BIGINT AS children, 0::BIGINT AS parents, count(DISTINCT o.target_uri) AS "references", count(DISTINCT i.source_uri) AS referenced_by, count(DISTINCT o.target_uri) FILTER (o.target_uri <> a.uri) + count(DISTINCT i.source_uri) FILTER (i.source_uri <> a.uri) > 0 AS linked
  FROM art a LEFT JOIN edge o ON o.source_uri = a.uri LEFT JOIN edge i ON i.target_uri = a.uri GROUP BY a.uri""")
def document_neighbours(spark, sf_dir):
    k = kb(spark, sf_dir)
    return graph.neighbours(k.artifacts, k.edges)


@query()
def contributor_details(spark, sf_dir):
    """By dimension, check, kind and cause, with the first five findings."""
    return R.contributor_details(interpreted(spark, sf_dir), R.causes(kb(spark, sf_dir)))


_rank = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_cause_body = _RUN_ORACLES["signal_causes"]
_mark = "uri || coalesce(':' || line, '')"


def _sample(by: str, source: str) -> str:
    return f"(SELECT {by}, string_agg({_mark}, ' ' ORDER BY r) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY uri, line NULLS FIRST, signal_id, occurrence) AS r FROM {source}) WHERE r <= 5 GROUP BY {by})"


_caused = f"(SELECT i.*, c.dimension, coalesce(k.cause, i.signal_type) AS cause FROM interp i JOIN chk c ON i.collector_id = c.collector_id LEFT JOIN (SELECT uri, collector_id, signal_type, line, min(cause) AS cause FROM ({_cause_body}) GROUP BY ALL) k ON i.uri = k.uri AND i.collector_id = k.collector_id AND i.signal_type = k.signal_type AND coalesce(i.line, -1) = coalesce(k.line, -1))"
ORACLES["contributor_details"] = sql(f"""SELECT g.*, s.sample FROM (SELECT dimension, collector_id, signal_type, cause, signals, documents, severity, penalty, gain AS collector_gain, round(gain / checks::DOUBLE, 6) AS dimension_gain, round(gain / checks::DOUBLE * ({_weight}), 6) AS score_gain, recommendation FROM (
  SELECT g.*, (SELECT count(*) FROM chk x WHERE x.dimension = g.dimension) AS checks, greatest(0, 100 - greatest(0, total - penalty)) - greatest(0, 100 - total) AS gain FROM (SELECT dimension, collector_id, signal_type, cause, count(*) AS signals, count(DISTINCT uri) AS documents, sum(penalty)::BIGINT AS penalty, arg_max(severity, {_rank}) AS severity, min(recommendation) AS recommendation FROM {_caused} GROUP BY ALL) g
  JOIN (SELECT collector_id, sum(penalty)::BIGINT AS total FROM interp GROUP BY collector_id) t USING (collector_id)) g) g JOIN {_sample('dimension, collector_id, signal_type, cause', _caused)} s USING (dimension, collector_id, signal_type, cause)""")


@query(f"SELECT * FROM (SELECT signal_type, severity, count(*) AS signals, count(DISTINCT uri) AS documents FROM interp GROUP BY ALL) JOIN {_sample('signal_type, severity', 'interp')} USING (signal_type, severity)")
def type_details(spark, sf_dir):
    return R.type_details(interpreted(spark, sf_dir))


@query("SELECT collector_id, signal_type, uri, count(*) AS n, 'collector=' || collector_id || ', type=' || signal_type || ', severity=' || first(severity ORDER BY line NULLS FIRST) || ', artifact=' || uri || ', recommendation=' || first(coalesce(recommendation, '') ORDER BY line NULLS FIRST) AS representative, string_agg(DISTINCT signal_id, ' ' ORDER BY signal_id) AS ids FROM interp GROUP BY collector_id, signal_type, uri")
def cluster_details(spark, sf_dir):
    return R.cluster_details(interpreted(spark, sf_dir))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY abs(gain_delta) DESC, abs(signals_delta) DESC, uri, collector_id, signal_type) AS r FROM ({_CHANGES}) WHERE change <> 'unchanged') WHERE r <= 5")
def top_regressions_and_improvements(spark, sf_dir):
    """The report's five greatest steps either way."""
    return _big(R.top_directions(contributor_changes(spark, sf_dir)), "r")


@query("SELECT strategy, count(*) AS outcomes, count(*) FILTER (verification_outcome = 'resolved') AS successes, round(avg((verification_outcome = 'resolved')::INT), 6) AS rate, round(coalesce(avg(1 + tokens_used % 3) FILTER (verification_outcome = 'resolved'), 0)::DOUBLE, 6) AS mean_attempts FROM outc GROUP BY strategy")
def strategy_rates(spark, sf_dir):
    rows = outcomes(spark, sf_dir).select("strategy", (F.col("verification_outcome") == "resolved").alias("success"), (1 + F.col("tokens_used") % 3).alias("attempt"))
    return R.strategy_rates(rows)


_words = f"list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z]{{3,}}')), lambda w: w NOT IN ({_list(C.STOPWORDS)}))"


@query(f"""SELECT kb.uri, sha256(CASE WHEN l.links IS NULL THEN text ELSE regexp_replace(text, '\\s+\\z', '') || chr(10) || chr(10) || '## Additional Resources' || chr(10) || chr(10) || l.links || chr(10) END) AS fixed FROM kb LEFT JOIN (SELECT hub, string_agg('- [' || title || '](' || uri || ')', chr(10) ORDER BY '- [' || title || '](' || uri || ')') AS links FROM (
  SELECT DISTINCT h.hub, o.uri, o.title FROM (SELECT k.uri AS hub, unnest({_words}) AS w FROM kb k JOIN title t ON t.uri = k.uri WHERE doc_id % 50 = 5) h JOIN (SELECT k.uri, title, unnest({_words}) AS w FROM kb k JOIN title t ON t.uri = k.uri WHERE doc_id % 10 = 3) o ON h.w = o.w AND h.hub <> o.uri) GROUP BY hub) l ON l.hub = kb.uri""")
def hubs_linked(spark, sf_dir):
    """Every fiftieth document as a hub for every tenth one; the hubs' own texts are in the result."""
    docs = kb_docs(spark, sf_dir)
    pick = lambda kept: docs.where(kept).select("uri")
    found = V.link_from_hubs(docs.select("uri", "text"), pick("doc_id % 10 = 3"), pick("doc_id % 50 = 5"), kb(spark, sf_dir).artifacts.select("uri", "title"), C.STOPWORDS)
    return found.select("uri", F.sha2("text", 256).alias("fixed"))


@query("""SELECT 'signals' AS kept, coalesce(n.signal_id, o.signal_id) AS signal_id, CASE WHEN o.status = 'resolved' THEN o.status ELSE coalesce(n.status, o.status) END AS status, coalesce(n.last_run, o.last_run)::VARCHAR AS last_run FROM sold o FULL JOIN snew n ON o.signal_id = n.signal_id
  UNION ALL SELECT 'lifecycle', coalesce(n.signal_id, o.signal_id), 'persistent', CASE WHEN n.signal_id IS NULL THEN '1' ELSE '2' END FROM sold o FULL JOIN snew n ON o.signal_id = n.signal_id UNION ALL SELECT 'links', signal_id, '1', NULL FROM sold UNION ALL SELECT 'links', signal_id, '2', NULL FROM snew
  UNION ALL SELECT 'assessments', '1', 'done', NULL UNION ALL SELECT 'assessments', '2', 'done', NULL UNION ALL SELECT 'artifacts', uri, sha256(title), NULL FROM title""")
def persisted_runs(spark, sf_dir):
    """Two runs persisted whole, one after the other: all five tables as the store has them."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    artifacts = kb(spark, sf_dir).artifacts.select("uri", "title")
    for run, found in zip(("1", "2"), two_runs(spark, sf_dir)):
        store.persist(spark, folder, run, artifacts, found, spark.createDataFrame([(run, "done")], "assessment_id string, status string"))
    now = store.Snapshot.newest(spark, folder)
    none = F.lit(None).cast("string").alias("last_run")
    rows = [
        now.load("signals").select(F.lit("signals").alias("kept"), "signal_id", "status", F.col("last_run").cast("string").alias("last_run")), now.load("lifecycle").select(F.lit("lifecycle").alias("kept"), "signal_id", "status", "last_run"),
        now.load("links").select(F.lit("links").alias("kept"), "signal_id", F.col("assessment_id").alias("status"), none), now.load("assessments").select(F.lit("assessments").alias("kept"), F.col("assessment_id").alias("signal_id"), "status", none),
        now.load("artifacts").select(F.lit("artifacts").alias("kept"), F.col("uri").alias("signal_id"), F.sha2("title", 256).alias("status"), none),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT signal_id, access_count FROM (SELECT user_id::VARCHAR || ':' || event_type AS signal_id, count(*) FILTER (value >= 90)::BIGINT + 1 AS access_count FROM events GROUP BY 1) WHERE signal_id LIKE '7%'")
def touched_signals(spark, sf_dir):
    """Findings read by key, their access counts raised in their buckets alone; those of users whose number begins with seven."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = table(prepare(spark), sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id"), "value")
    known = rows.select("signal_id").distinct().select("signal_id", F.lit(1).cast("long").alias("access_count"), F.lit(0).alias("last_access"))
    store.publish(spark, folder, {"signals": store.Keyed(known, ["signal_id"], 32)})
    read = rows.where("value >= 90").select("signal_id")
    store.transact(spark, folder, lambda now: {"signals": store.upserted(now, "signals", store.touch(now.matching("signals", read), read, F.lit(7)), ["signal_id"])})
    asked = known.where("signal_id LIKE '7%'")
    return store.Snapshot.newest(spark, folder).matching("signals", asked).select("signal_id", "access_count")


@query(work.ORACLES["cosine_topk"])
def cosine_topk_indexed(spark, sf_dir):
    """The five nearest rows of every vector whose id is divisible by 20, by the index."""
    rows = table(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    found, _ = vector_index.search(vector_index.build(rows), rows.where("vec_id % 20 = 0"))
    return _big(found, "rank")


#: Each source's runs use all checks but one; that and the policy are what a digest is made of.
_WITHOUT = {"alpha": "freshness", "beta": "topic_purity"}


def _parts_sql(source):
    rows = [f"policy_version={I.POLICY_VERSION}", f"schema_version={I.SCHEMA_VERSION}"] + [f"check={n}@1.0" for n in C.REGISTRY if n != _WITHOUT[source]] + [f"weight={d}:{w}" for d, w in S.WEIGHTS.items()]
    listed = " UNION ALL ".join(f"SELECT '{r}' AS part" for r in rows)
    return f"SELECT '{source}' AS source, part FROM ({listed} UNION ALL SELECT 'policy=' || collector_id || '|' || signal_type || '|' || severity || '|' || penalty FROM pol)"


@query(f"SELECT assessment_id, digest, coalesce(digest = lag(digest) OVER (ORDER BY run), true) AS comparable FROM assess JOIN (SELECT source, sha256(string_agg(DISTINCT part, chr(10) ORDER BY part)) AS digest FROM ({_parts_sql('alpha')} UNION ALL {_parts_sql('beta')}) GROUP BY source) USING (source)")
def comparable_runs(spark, sf_dir):
    """The digest of each run's configuration, and whether it can be compared with the run before."""
    parts = [I.configuration(spark, [n for n in C.REGISTRY if n != left_out]).withColumn("source", F.lit(source)) for source, left_out in _WITHOUT.items()]
    digests = I.fingerprint(parts[0].unionByName(parts[1]), ["source"])
    runs = assessments(spark, sf_dir).join(F.broadcast(digests), "source")  # a row a source
    return runs.select("assessment_id", "digest", F.expr("coalesce(digest = lag(digest) over (order by run), true)").alias("comparable"))


oracle.PARTS |= {
    "mapped": "SELECT DISTINCT signal_type, uri, lang FROM interp WHERE signal_type IN ('no_date_signal', 'orphan_artifact', 'missing_canonical_source')",
    "proposed": "SELECT uri, lang, CASE doc_id % 4 WHEN 0 THEN 'add_metadata' WHEN 1 THEN 'create_relationship' WHEN 2 THEN 'update_document' ELSE 'add_metadata' END AS step_type, CASE doc_id % 4 WHEN 0 THEN 'date' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'add_canonical_link' ELSE 'rewrite' END ELSE '' END AS detail, CASE WHEN doc_id % 4 = 3 THEN 'missing_canonical_source' END AS signal_type FROM kb WHERE doc_id % 5 <> 0 AND lang <> 'en'",
    "settled": "SELECT DISTINCT uri, k AS signal_type FROM (SELECT uri, unnest(list_concat(CASE WHEN signal_type IS NULL THEN [] ELSE [signal_type] END, CASE WHEN step_type = 'add_metadata' AND detail = 'date' THEN ['no_date_signal', 'stale_content'] WHEN step_type = 'update_document' AND detail = 'add_canonical_link' THEN ['missing_canonical_source'] WHEN step_type = 'create_relationship' THEN ['orphan_artifact'] ELSE [] END)) AS k FROM proposed)",
}


def mapped_steps(spark, sf_dir):
    """(signal_type, uri, lang): findings that have a mapped step."""
    return interpreted(spark, sf_dir).where("signal_type in ('no_date_signal', 'orphan_artifact', 'missing_canonical_source')").select("signal_type", "uri", "lang").distinct()


def proposed_steps(spark, sf_dir):
    d = F.col("doc_id")
    kind = F.when(d % 4 == 1, "create_relationship").when(d % 4 == 2, "update_document").otherwise("add_metadata")
    detail = F.when(d % 4 == 0, "date").when(d % 4 == 2, F.when(d % 3 == 0, "add_canonical_link").otherwise("rewrite")).otherwise("")
    return kb_docs(spark, sf_dir).where("doc_id % 5 <> 0 and lang <> 'en'").select("uri", "lang", kind.alias("step_type"), detail.alias("detail"), F.when(d % 4 == 3, "missing_canonical_source").alias("signal_type"))


def _failed(spark, sf_dir):
    return mapped_steps(spark, sf_dir).where("uri like '%9.md'").select("signal_type", "uri")


@query("SELECT signal_type, uri FROM mapped WHERE uri NOT LIKE '%9.md' AND (uri, signal_type) NOT IN (SELECT uri, signal_type FROM settled)")
def uncovered_steps(spark, sf_dir):
    """Mapped steps that no proposal settles and that did not fail before."""
    return M.uncovered(mapped_steps(spark, sf_dir).select("signal_type", "uri"), proposed_steps(spark, sf_dir), _failed(spark, sf_dir))


@query("SELECT lang, settled, uncovered, lang <> 'de' AND NOT (settled > uncovered AND lang = 'fr') AS first FROM (SELECT lang, count(*) FILTER ((uri, signal_type) IN (SELECT uri, signal_type FROM settled)) AS settled, count(*) FILTER ((uri, signal_type) NOT IN (SELECT uri, signal_type FROM settled)) AS uncovered FROM mapped WHERE uri NOT LIKE '%9.md' GROUP BY lang) WHERE uncovered > 0")
def mapped_steps_placed(spark, sf_dir):
    """By language as runs: whether mapped steps go first. Those of de failed before; only the proposals for fr are sure."""
    docs = kb_docs(spark, sf_dir).select("lang").distinct()
    sure = docs.select("lang", F.when(F.col("lang") == "fr", 0.7).otherwise(0.4).alias("confidence"))
    past = docs.where("lang = 'de'").select("lang", F.lit("signal_mapped_remediation").alias("strategy"), F.lit("unchanged").alias("verification_outcome"))
    return M.place_mapped(proposed_steps(spark, sf_dir), mapped_steps(spark, sf_dir), _failed(spark, sf_dir), sure, past, "lang")


@query("SELECT outcome_id AS run_id, CASE WHEN tokens_used % 11 = 0 THEN 'unknown' ELSE issue_type END AS issue_type, CASE WHEN tokens_used % 13 = 0 THEN 'unknown' ELSE strategy END AS strategy, CASE WHEN tokens_used % 4 = 0 THEN 'failure' ELSE 'success' END AS result, score_before, score_after, score_after - score_before AS score_change, CASE WHEN tokens_used % 4 = 0 AND tokens_used % 8 <> 0 THEN proposal_reasoning ELSE '' END AS failure_reason, CASE WHEN tokens_used % 5 = 0 THEN 1 ELSE tokens_used % 5 END AS attempt, verification_outcome FROM outc")
def recorded_outcomes(spark, sf_dir):
    """Outcome records of runs, some without category, strategy, explanation or attempt."""
    t = F.col("tokens_used")
    none = F.array().cast("array<string>")
    runs = outcomes(spark, sf_dir).select(
        F.col("outcome_id").alias("run_id"), F.when(t % 4 == 0, "failed").otherwise("completed").alias("stage"), F.when(t % 11 == 0, none).otherwise(F.array("issue_type")).alias("categories"), F.when(t % 13 == 0, none).otherwise(F.array("strategy", F.lit("x"))).alias("strategies"),
        "score_before", "score_after", F.col("verification_outcome").alias("outcome"), F.when(t % 8 != 0, F.col("proposal_reasoning")).alias("explanation"), F.when(t % 5 != 0, t % 5).alias("attempt"),
    )
    return M.outcome_records(runs)


_history = "SELECT * FROM outc WHERE NOT (issue_type < '05' AND verification_outcome = 'resolved') AND NOT (issue_type < '03' AND verification_outcome <> 'partially_resolved') AND issue_type > '00'"


@query(f"""SELECT issue_type, coalesce(retrieved, 0) AS retrieved, coalesce(avoided, 0) AS avoided, coalesce(won, CASE WHEN coalesce(avoided, 0) = 0 THEN suggested END) AS reused, CASE WHEN won IS NOT NULL THEN 'reused' WHEN avoided > 0 THEN 'avoided' WHEN suggested IS NOT NULL THEN 'suggested' ELSE 'none' END AS rationale
  FROM (SELECT DISTINCT issue_type FROM outc) LEFT JOIN (SELECT issue_type, count(*) AS retrieved, count(DISTINCT strategy) FILTER (verification_outcome IN ('unchanged', 'regressed', 'misdiagnosed')) AS avoided, first(strategy ORDER BY score_after - score_before DESC, strategy DESC) FILTER (verification_outcome = 'resolved') AS won FROM ({_history}) GROUP BY issue_type) USING (issue_type)
  LEFT JOIN (SELECT issue_type, max(strategy) AS suggested FROM ({_history}) GROUP BY issue_type) USING (issue_type)""")
def memory_rationales(spark, sf_dir):
    """What is reused, avoided or suggested: some issues have no success, some only partial ones, one no history."""
    rows = outcomes(spark, sf_dir)
    kept = rows.where("not (issue_type < '05' and verification_outcome = 'resolved') and not (issue_type < '03' and verification_outcome <> 'partially_resolved') and issue_type > '00'")
    ranks = kept.select("issue_type", "strategy").distinct().withColumn("adjusted", F.lit(0.5))
    return M.memory_influence(rows.select("issue_type"), kept, ranks)


_told = lambda rows, name: f"SELECT issue_type, '{name}' AS source, count(*) AS attempts, coalesce(string_agg(DISTINCT strategy, ',' ORDER BY strategy) FILTER (verification_outcome IN ('resolved', 'partially_resolved')), '') AS successful, coalesce(string_agg(DISTINCT strategy, ',' ORDER BY strategy) FILTER (verification_outcome NOT IN ('resolved', 'partially_resolved')), '') AS failed FROM outc WHERE {rows} GROUP BY issue_type"
_FIRST, _SECOND = "issue_type >= '10'", "issue_type < '10' AND issue_type >= '02' AND tokens_used % 2 = 0"


@query(f"SELECT * FROM ({_told(_FIRST, 'primary')}) UNION ALL SELECT * FROM ({_told(_SECOND, 'secondary')}) UNION ALL SELECT DISTINCT issue_type, 'none', 0, '', '' FROM outc WHERE issue_type < '02'")
def merged_contexts(spark, sf_dir):
    """History of every issue, from the store that has it."""
    rows = outcomes(spark, sf_dir)
    return M.merged_context(rows, rows.where(_FIRST), rows.where("issue_type >= '02' AND tokens_used % 2 = 0"))


_of = lambda c: f"(SELECT count(*) FROM signal WHERE collector_id = '{c}')"
_kind = lambda k: f"(SELECT count(*) FROM signal WHERE signal_type = '{k}')"
_all = "(SELECT count(*) FROM art)"
_guides = f"(SELECT count(*) FROM txt JOIN title USING (uri) WHERE regexp_matches(lower(all_text), '{'|'.join(C.WORKFLOW)}') OR regexp_matches(lower(title), '{'|'.join(C.WORKFLOW)}'))"
_entropy = "(SELECT avg(e) FROM (SELECT -sum(p * log2(p)) AS e FROM (SELECT uri, n / sum(n) OVER (PARTITION BY uri) AS p FROM clu) GROUP BY uri))"
_copies = "(SELECT count(*) FROM (SELECT signature FROM sig WHERE length(signature) > 50 GROUP BY signature HAVING count(*) > 1))"
_broken = "(SELECT count(*) FROM res WHERE resolved IS NULL)"
_graded = lambda high, medium: f"CASE WHEN {high} THEN 'HIGH' WHEN {medium} THEN 'MEDIUM' ELSE 'LOW' END"
_told = {
    "topic_purity": (f"100 - {_kind('mixed_topics')} * 15 - trunc({_entropy} * 10)", f"CASE WHEN {_kind('mixed_topics')} > 0 THEN 'HIGH' ELSE 'LOW' END"),
    "context_independence": (f"100 - {_of('context_independence')} * 10", f"CASE WHEN {_of('context_independence')} > 0 THEN 'MEDIUM' ELSE 'LOW' END"),
    "heading_quality": (f"100 - {_of('heading_quality')} * 5", _graded(f"{_kind('placeholder')} + {_kind('numbered_only')} > 0", f"{_of('heading_quality')} > 0")),
    "terminology_consistency": (f"100 - trunc({_of('terminology_consistency')} * 50 / {_all})", _graded(f"{_of('terminology_consistency')} > {_all} * 0.2", f"{_of('terminology_consistency')} > 0")),
    "contradiction_detection": (f"100 - {_of('contradiction_detection')} * 10", _graded(f"{_of('contradiction_detection')} > 5", f"{_of('contradiction_detection')} > 0")),
    "canonical_source": (f"100 - {_kind('missing_canonical_source')} * 3 - {_copies} * 10", _graded(f"{_copies} > 3", f"{_kind('missing_canonical_source')} + {_copies} > 0")),
    "freshness": (f"100 - trunc({_of('freshness')} * 100 / {_all})", _graded(f"{_kind('stale_content')} > {_all} * 0.3", f"{_kind('stale_content')} > 0 OR {_kind('no_date_signal')} > {_all} * 0.5")),
    "knowledge_connectivity": (f"100 - trunc({_kind('orphan_artifact')} * 100 / {_all})", _graded(f"{_kind('orphan_artifact')} > {_all} * 0.3", f"{_kind('orphan_artifact')} > 0")),
    "link_integrity": (f"100 - {_broken} * 5 - {_kind('orphan')} * 2", _graded(f"{_broken} > 5", f"{_broken} + {_kind('orphan')} > 0")),
    "workflow_completeness": (f"trunc(({_guides} - {_kind('incomplete_workflow')}) * 100 / {_guides})", _graded(f"{_kind('incomplete_workflow')} > {_guides} * 0.5", f"{_kind('incomplete_workflow')} > 0")),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS collector_id, greatest(0, {score})::INT AS score, {severity} AS severity" for k, (score, severity) in _told.items()))
def collector_reports(spark, sf_dir):
    return R.collector_reports(kb(spark, sf_dir), interpreted(spark, sf_dir))


_diff = "SELECT signal_id, CASE WHEN o.signal_id IS NULL THEN 'new' WHEN n.signal_id IS NULL THEN 'resolved' ELSE 'persistent' END AS change FROM sold o FULL JOIN snew n USING (signal_id)"


@query(f"""SELECT signal_id, '{{"signal_id":"' || signal_id || '","change":"' || change || '"}}' AS json FROM ({_diff})""")
def exported_diff(spark, sf_dir):
    """The changes between two runs as JSON objects."""
    first, second = two_runs(spark, sf_dir)
    return store.to_json(H.signal_diff(first, second).select("signal_id", "change"), ["signal_id"])


@query(f"""SELECT run, '{{"run":' || run || ',"score":' || score || ',"trend":"' || trend || '"}}' AS json FROM (SELECT run, score, CASE WHEN {_back} IS NULL THEN 'unknown' WHEN score - {_back} > 3 THEN 'improving' WHEN score - {_back} < -3 THEN 'worsening' ELSE 'stable' END AS trend FROM runs)""")
def exported_trend(spark, sf_dir):
    rows = H.series(run_scores(spark, sf_dir)).select(F.col("run").cast("long").alias("run"), F.col("score").cast("int").alias("score"), "trend")
    return store.to_json(rows, ["run"])


@query("SELECT metric, greatest(0, sum(CASE WHEN r = 'b' THEN 1 ELSE -1 END))::BIGINT AS rise FROM (SELECT 'a' AS r, signal_type AS metric FROM ra UNION ALL SELECT 'b', signal_type FROM rb) GROUP BY metric")
def metric_rises(spark, sf_dir):
    """How much the number of findings of each kind rose between two runs, zero where it fell."""
    counted = [x.groupBy(F.col("signal_type").alias("metric")).agg(F.count("*").alias("value")) for x in run_pair(spark, sf_dir)]
    return H.clipped_rises(*counted)


@query()
def validation_measures(spark, sf_dir):
    """All measures of the corpus before and after: links to missing documents became text, half of the front matter went."""
    docs = kb_docs(spark, sf_dir)
    mended = F.regexp_replace("text", r"\[gone\]\(missing_\d+\.md\)", "gone")
    bare = F.when(F.col("doc_id") % 6 == 3, F.regexp_replace(mended, r"\A---\n(?s:.*?)\n---\n", "")).otherwise(mended)
    return V.validate(docs.select("uri", "text"), docs.select("uri", bare.alias("text")))


ORACLES["validation_measures"] = sql("""SELECT measure, a AS before, b AS after, CASE WHEN a = b THEN 'neutral' WHEN (b > a) = (measure = 'with_metadata') THEN 'improved' ELSE 'degraded' END AS effect FROM (
  SELECT 'broken_links' AS measure, count(*) FILTER (resolved IS NULL) AS a, count(*) FILTER (resolved IS NULL AND clean NOT LIKE 'missing%') AS b FROM res UNION ALL SELECT 'heading_issues', 0, 0 UNION ALL SELECT 'with_metadata', count(*) FILTER (doc_id % 3 = 0), count(*) FILTER (doc_id % 6 = 0) FROM kb
  UNION ALL SELECT 'unreferenced', count(*), count(*) FROM art WHERE uri NOT IN (SELECT resolved FROM res WHERE resolved IS NOT NULL AND resolved <> uri)) UNION ALL SELECT 'overall', NULL, NULL, 'neutral'""")


@query()
def proposals_left(spark, sf_dir):
    """Proposals with the steps that are left once later duplicates are dropped; those that have none are gone."""
    rows = table(prepare(spark), sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("proposal"), F.col("doc_id").alias("step"), F.concat(F.lit("kind "), (F.col("doc_id") % 3).cast("string")).alias("step_type"), (F.col("doc_id") % 90).cast("string").alias("uri"), F.concat(F.lit("Do  it "), F.upper("lang")).alias("description"))
    return M.distinct_proposals(rows, rows.select("proposal").distinct())


ORACLES["proposals_left"] = sql("SELECT proposal, count(*) AS n_steps FROM (SELECT doc_id // 100 AS proposal, row_number() OVER (PARTITION BY doc_id % 3, doc_id % 90, lower(lang) ORDER BY doc_id // 100, doc_id) AS r FROM documents) WHERE r = 1 GROUP BY proposal")
