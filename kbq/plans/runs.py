"""Queries over stored runs: persistence, incremental assessment, explanations, differences and the reporting views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import history as H
from kbq.operators import incremental as I
from kbq.operators import maintained as M
from kbq.operators import reports as R
from kbq.operators import scoring as S
from kbq.operators import store
from kbq.plans import oracle, scores
from kbq.plans.checks import _big, kb
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import sql
from kbq.plans.scores import interpreted, seen
from kbq.session import once_per_input, prepare, shared_folder, table
from kbq.streaming import runs as stream_runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Read by Spark SQL and by DuckDB alike: a day of events is a run of one of two sources, an event is a remediation.
ASSESSMENTS_SQL = """SELECT 'run-' || lpad(cast(run as string), 3, '0') AS assessment_id, run, score, 'events=' || cast(signals_count as string) AS dimensions, signals_count, CASE WHEN run % 3 = 0 THEN 'beta' ELSE 'alpha' END AS source, substring(md5(cast(run as string)), 1, 8) AS git_commit, created_at
  FROM (SELECT row_number() OVER (ORDER BY created_at) AS run, score, signals_count, created_at FROM (SELECT date_trunc('day', ts) AS created_at, cast(round(100 * avg(cast(CASE WHEN value < 50 THEN 1 ELSE 0 END as double))) as int) AS score, count(*) AS signals_count FROM {events} GROUP BY 1))"""
OUTCOMES_SQL = """SELECT cast(event_id as string) AS outcome_id, lpad(cast(user_id % 20 as string), 2, '0') AS issue_type, event_type AS strategy, CASE WHEN value >= 75 THEN 'resolved' WHEN value >= 50 THEN 'partially_resolved' WHEN value >= 10 THEN 'unchanged' ELSE 'regressed' END AS verification_outcome,
  cast(floor(value) as int) AS score_before, cast(floor(value) as int) + cast(event_id % 7 as int) - 2 AS score_after, cast(event_id % 1000 as int) AS tokens_used, 'try ' || event_type AS strategy_description, 'because of ' || cast(user_id % 7 as string) AS proposal_reasoning, cast(event_id % 500 as int) AS latency_ms, event_id % 9 = 0 AS forked, 'set_date:kb/s' || cast(event_id % 20 as string) AS modification_steps, 'kb/s' || cast(user_id % 500 as string) AS uri, ts AS created_at FROM {events}"""
TRACES_SQL = "SELECT 't' || cast(event_id as string) AS trace_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE cast(event_id as string) END AS outcome_id, event_type AS stage, 'step ' || cast(event_id % 4 as string) AS reasoning, 'tokens ' || cast(event_id % 90 as string) AS llm_metadata, ts AS created_at FROM {events} WHERE event_id % 3 = 0"
_of_run = lambda kept, more: f"SELECT signal_id, uri, severity, {more} FROM interp JOIN (SELECT uri, doc_id FROM kb) USING (uri) WHERE occurrence = 1 AND {kept}"
_pair = "SELECT i.*, k.doc_id FROM interp i JOIN (SELECT uri, doc_id FROM kb) k USING (uri) WHERE NOT (doc_id % 10 = {0} AND collector_id = '{1}')"
oracle.PARTS |= {
    "assess": ASSESSMENTS_SQL.format(events="events"),
    "outc": OUTCOMES_SQL.format(events="events"),
    "trace": TRACES_SQL.format(events="events"),
    "sold": _of_run("doc_id % 10 <> 0", "CASE WHEN doc_id % 7 = 0 THEN 'resolved' ELSE 'persistent' END AS status, 1 AS last_run, doc_id % 5 AS access_count"),
    "snew": _of_run("doc_id % 10 <> 1", "'persistent' AS status, 2 AS last_run, 0 AS access_count"),
    "ra": _pair.format(0, "heading_quality"),
    "rb": _pair.format(1, "terminology_consistency"),
}
for _x in "ab":
    oracle.PARTS |= {f"ucol{_x}": oracle.PARTS["ucol"].replace("interp", f"r{_x}"), f"udim{_x}": oracle.PARTS["udim"].replace("ucol", f"ucol{_x}"), f"ucard{_x}": scores._overall("uri").format(dims=f"udim{_x}")}
_contributors = lambda source, by: f"""SELECT {by}, dimension, collector_id, signal_type, signals, severity, round((greatest(0, 100 - greatest(0, total - penalty)) - greatest(0, 100 - total)) / checks * ({scores._weight}), 6) AS score_gain
  FROM (SELECT *, sum(penalty) OVER (PARTITION BY {by}, collector_id) AS total, (SELECT count(*) FROM chk x WHERE x.dimension = g.dimension) AS checks FROM (
  SELECT i.{by}, c.dimension, i.collector_id, signal_type, count(*) AS signals, sum(penalty)::BIGINT AS penalty, any_value(severity) AS severity FROM {source} i JOIN chk c ON i.collector_id = c.collector_id GROUP BY ALL) g)"""  # noqa: E731
oracle.PARTS |= {"con": _contributors("interp", "uri"), "cona": _contributors("ra", "uri"), "conb": _contributors("rb", "uri")}


def query(oracle_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle_sql is not None:
            ORACLES[f.__name__] = sql(oracle_sql)
        return f

    return add


def _events(spark, sf_dir, text):
    return prepare(spark).sql(text, events=table(spark, sf_dir, "events"))


def assessments(spark, sf_dir):
    return _events(spark, sf_dir, ASSESSMENTS_SQL)


def outcomes(spark, sf_dir):
    return _events(spark, sf_dir, OUTCOMES_SQL)


def _plain_times(df):
    """Timestamps without a zone, as the files have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes])


def two_runs(spark, sf_dir):
    """Stored findings of a run and the findings of the next one."""
    found = interpreted(spark, sf_dir).where("occurrence = 1")
    pick = lambda kept, status, run, n: found.where(kept).select("signal_id", "uri", "severity", status.alias("status"), F.lit(run).alias("last_run"), n.cast("long").alias("access_count"))
    resolved = F.when(F.col("doc_id") % 7 == 0, "resolved").otherwise("persistent")
    return pick("doc_id % 10 <> 0", resolved, 1, F.col("doc_id") % 5), pick("doc_id % 10 <> 1", F.lit("persistent"), 2, F.lit(0))


def run_pair(spark, sf_dir):
    """Two runs that differ: one lacks some documents' heading findings, the other others' findings on terms."""
    found = interpreted(spark, sf_dir)
    return tuple(found.where(f"NOT (doc_id % 10 = {k} AND collector_id = '{c}')") for k, c in ((0, "heading_quality"), (1, "terminology_consistency")))


@query("""SELECT coalesce(n.signal_id, o.signal_id) AS signal_id, coalesce(n.uri, o.uri) AS uri, coalesce(n.severity, o.severity) AS severity, CASE WHEN o.status = 'resolved' THEN o.status ELSE coalesce(n.status, o.status) END AS status,
  coalesce(n.last_run, o.last_run)::INT AS last_run, coalesce(o.access_count, n.access_count)::BIGINT AS access_count FROM sold o FULL JOIN snew n ON o.signal_id = n.signal_id""")
def persisted_signals(spark, sf_dir):
    """Two runs published one after the other; the findings read back from the store."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    first, second = two_runs(spark, sf_dir)
    store.publish(spark, folder, {"signals": first, "runs": spark.createDataFrame([(1,)], "run int")})
    store.publish(spark, folder, {"signals": store.merge_signals(store.load(spark, folder, "signals"), second)})
    return store.load(spark, folder, "signals")


@query("SELECT uri, source, max(m)::BIGINT AS modified_at FROM (SELECT uri, source, doc_id % 9 AS m FROM kb WHERE doc_id % 10 = 2 UNION ALL SELECT uri, source, doc_id % 11 FROM kb WHERE doc_id % 10 IN (2, 3)) GROUP BY ALL")
def modified_documents(spark, sf_dir):
    docs = kb_docs(spark, sf_dir)
    rows = lambda kept, at: docs.where(kept).select("uri", "source", (F.col("doc_id") % at).alias("modified_at"))
    return store.record_modified(rows("doc_id % 10 = 2", 9), rows("doc_id % 10 in (2, 3)", 11))


@query("SELECT assessment_id, signal_id FROM seen JOIN assess USING (run) WHERE source <> 'beta'")
def cleared_source(spark, sf_dir):
    """Links from runs to findings that stay when a source is cleared."""
    runs = assessments(spark, sf_dir)
    links = seen(spark, sf_dir).join(F.broadcast(runs.select("run", "assessment_id")), "run").select("assessment_id", "signal_id")
    return store.clear_source(runs, links, "beta")[1]


@query("SELECT signal_id, count(*) FILTER (value >= 90)::BIGINT + 1 AS access_count, CASE WHEN count(*) FILTER (value >= 90) > 0 THEN 7 ELSE 0 END::INT AS last_access FROM (SELECT user_id::VARCHAR || ':' || event_type AS signal_id, value FROM events) GROUP BY signal_id")
def access_counts(spark, sf_dir):
    rows = table(prepare(spark), sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id"), "value")
    known = rows.select("signal_id").distinct().select("signal_id", F.lit(1).cast("long").alias("access_count"), F.lit(0).alias("last_access"))
    return store.touch(known, rows.where("value >= 90").select("signal_id"), F.lit(7))


@query("SELECT s.assessment_id, s.signal_id, d.n FROM (SELECT assessment_id, signal_id FROM seen JOIN assess USING (run)) s JOIN (SELECT user_id::VARCHAR || ':' || event_type AS signal_id, count(*) AS n FROM events GROUP BY 1) d USING (signal_id)")
def assessment_signals(spark, sf_dir):
    links = seen(spark, sf_dir).join(F.broadcast(assessments(spark, sf_dir).select("run", "assessment_id")), "run").select("assessment_id", "signal_id")
    known = table(spark, sf_dir, "events").groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id")).agg(F.count("*").alias("n"))
    return store.of_assessment(links, known)


@query("SELECT assessment_id, lag(assessment_id) OVER (PARTITION BY source ORDER BY run) AS previous, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS back FROM assess")
def previous_assessments(spark, sf_dir):
    return _big(store.with_previous(assessments(spark, sf_dir)).select("assessment_id", "previous", "back"), "back")


@query("SELECT DISTINCT source || ':' || score AS dedup_key FROM assess WHERE run > 15 AND source || ':' || score NOT IN (SELECT source || ':' || score FROM assess WHERE run <= 15)")
def unseen_runs(spark, sf_dir):
    runs = assessments(spark, sf_dir).withColumn("dedup_key", F.concat_ws(":", "source", F.col("score").cast("string")))
    return store.not_seen(runs.where("run > 15"), runs.where("run <= 15")).select("dedup_key")


@query("""SELECT assessment_id, '{"assessment_id":"' || assessment_id || '","score":' || score || ',"source":"' || source || '"}' AS json FROM assess""")
def exported_assessments(spark, sf_dir):
    return store.to_json(assessments(spark, sf_dir).select("assessment_id", "score", "source"), ["assessment_id"])


@query("""SELECT signal_id, first_seen::BIGINT AS first_seen, status FROM (SELECT signal_id, first_seen, CASE WHEN last_seen < (SELECT max(run) FROM seen) THEN 'resolved' WHEN gap THEN 'recurring' WHEN first_seen = (SELECT max(run) FROM seen) THEN 'new' ELSE 'persistent' END AS status
  FROM (SELECT signal_id, min(run) AS first_seen, max(run) AS last_seen, coalesce(bool_or(run - p > 1), false) AS gap FROM (SELECT *, lag(run) OVER (PARTITION BY signal_id ORDER BY run) AS p FROM seen) GROUP BY signal_id)) WHERE status <> 'resolved' ORDER BY first_seen, signal_id LIMIT 20""")
def oldest_open_signals(spark, sf_dir):
    """The report's twenty oldest open findings."""
    return _big(H.oldest_open(H.lifecycle(seen(spark, sf_dir)), 20).select("signal_id", "first_seen", "status"), "first_seen")


_CHANGED = "SELECT doc_id, lang, source, uri, CASE WHEN doc_id % 10 = 2 THEN text || chr(10) || 'See above. Use RESTful calls. [more](doc_' || doc_id || '.md)' || chr(10) ELSE text END AS text FROM ({kb}) WHERE doc_id % 10 <> 1"


#: Read by Spark SQL and by DuckDB alike: navigation edges, among them some whose ends come, go or are reached by nothing else.
NAVIGATION_SQL = "SELECT uri AS source_uri, 'kb/s' || cast((doc_id + 2) % 20 as string) || '/doc_' || cast(doc_id + 2 as string) || '.md' AS target_uri, CASE WHEN doc_id % 24 = 0 THEN 'navigation' ELSE 'parent_child' END AS relation_type FROM {kb} AS docs WHERE doc_id % 12 = 0"


@once_per_input
def kept_assessment(spark, sf_dir):
    """A store with the assessment of nine tenths of the documents, navigation edges included."""
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    docs = kb_docs(spark, sf_dir)
    M.build(spark, folder, docs.where("doc_id % 10 <> 0").select("uri", "text"), spark.sql(NAVIGATION_SQL, kb=docs))
    return folder


def edits(spark, sf_dir):
    """(uri, text, event): a tenth of the documents is new, another gone, another edited."""
    docs = kb_docs(spark, sf_dir).where("doc_id % 10 in (0, 1, 2)")
    edited = F.concat("text", F.lit("\nSee above. Use RESTful calls. [more](doc_"), F.col("doc_id").cast("string"), F.lit(".md)\n"))
    return docs.select("doc_id", "uri", F.when(F.col("doc_id") % 10 == 2, edited).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 10 == 1, "deleted").otherwise("written").alias("event"))


_nav = "(SELECT * FROM (" + NAVIGATION_SQL.format(kb=f"({oracle.PARTS['kb']})") + ") WHERE source_uri IN (SELECT uri FROM kb) AND target_uri IN (SELECT uri FROM kb))"
_NAV_PARTS = {
    "kb": _CHANGED.format(kb=oracle.PARTS["kb"]),
    "edge": f"{oracle.PARTS['edge']} UNION ALL SELECT source_uri, target_uri, relation_type FROM {_nav}",
    "c_orphan": f"{oracle.PARTS['c_orphan']} AND uri NOT IN (SELECT target_uri FROM {_nav}) AND uri NOT IN (SELECT source_uri FROM {_nav})",
}


@query()
def incremental_signals(spark, sf_dir):
    """The findings after the edits, from the indexes of the assessment before."""
    folder = store.fork(spark, kept_assessment(spark, sf_dir), f"{shared_folder(spark)}/edited-{uuid.uuid4().hex}")
    rows = edits(spark, sf_dir)
    M.edit(spark, folder, rows.where("event <> 'deleted'"), rows.where("event = 'deleted'"))
    return _big(M.load(spark, folder)[1], "occurrence")


@query()
def stream_maintained(spark, sf_dir):
    """The same edits, as a change stream of two deliveries of which the second repeats part of the first."""
    folder = store.fork(spark, kept_assessment(spark, sf_dir), f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}")
    rows = edits(spark, sf_dir)
    files = max(1, rows.count() // 4000)  # as many in either delivery, so that one is one batch
    for at, kept in enumerate(("doc_id % 20 < 10", "doc_id % 20 >= 5")):
        rows.where(kept).select("uri", "text", "event", F.lit(at).alias("at")).repartition(files).write.mode("append").parquet(f"{folder}-changes")
    changes = spark.readStream.schema("uri string, text string, event string, at int").option("maxFilesPerTrigger", files).parquet(f"{folder}-changes")
    stream_runs.run_once(changes, M.changes(folder), f"{folder}-checkpoint")
    return _big(M.load(spark, folder)[1], "occurrence")


for _name in ("incremental_signals", "stream_maintained"):
    ORACLES[_name] = sql("SELECT uri, collector_id, signal_type, line, mark AS discriminator, signal_id, occurrence::BIGINT AS occurrence FROM signal", _NAV_PARTS)


@query("SELECT lang, sha256(string_agg(DISTINCT part, chr(10) ORDER BY part)) AS digest FROM (SELECT lang, collector_id || '|' || signal_type || '|' || severity || '|' || penalty AS part FROM interp) GROUP BY lang")
def comparability(spark, sf_dir):
    """What the findings of each language were judged by: equal digests can be compared."""
    part = F.concat_ws("|", "collector_id", "signal_type", "severity", F.col("penalty").cast("string"))
    return I.fingerprint(interpreted(spark, sf_dir).select("lang", part.alias("part")), ["lang"])


@query("""SELECT part, 'added' AS change FROM (SELECT collector_id || '|' || signal_type AS part FROM interp WHERE uri LIKE '%5.md' EXCEPT SELECT collector_id || '|' || signal_type FROM interp WHERE uri LIKE '%7.md')
  UNION ALL SELECT part, 'removed' FROM (SELECT collector_id || '|' || signal_type AS part FROM interp WHERE uri LIKE '%7.md' EXCEPT SELECT collector_id || '|' || signal_type FROM interp WHERE uri LIKE '%5.md')""")
def comparability_mismatch(spark, sf_dir):
    """By which kinds of findings two parts of the corpus differ."""
    parts = lambda ends: interpreted(spark, sf_dir).where(F.col("uri").endswith(ends)).select(F.concat_ws("|", "collector_id", "signal_type").alias("part")).distinct()
    return I.mismatch(parts("7.md"), parts("5.md"))


_refs = "unnest(regexp_extract_all(lower(text), '" + "|".join(C.DANGLING) + "'))"


@query(f"""SELECT uri, collector_id, signal_type, line, cause FROM (SELECT uri, 'heading_quality' AS collector_id, signal_type, line, heading AS cause FROM c_heading
  UNION ALL SELECT uri, 'link_integrity', 'broken_link', NULL, first(target ORDER BY n DESC, p) FROM (SELECT uri, target, count(*) AS n, min(pos) AS p FROM res WHERE resolved IS NULL GROUP BY uri, target) GROUP BY uri
  UNION ALL SELECT uri, 'context_independence', 'dangling_reference', NULL, first(ref ORDER BY n DESC, p) FROM (SELECT uri, ref, count(*) AS n, min(p) AS p FROM (SELECT uri, ref, row_number() OVER (PARTITION BY uri ORDER BY pos, i) AS p FROM (SELECT uri, pos, {_refs} AS ref, generate_subscripts(regexp_extract_all(lower(text), '{"|".join(C.DANGLING)}'), 1) AS i FROM para)) GROUP BY uri, ref) GROUP BY uri)""")
def signal_causes(spark, sf_dir):
    return R.causes(kb(spark, sf_dir))


@query("SELECT uri, adjusted, 100 - adjusted AS lost, coalesce(greatest_one, '') AS greatest, worst, critical, CASE WHEN adjusted < base THEN 'reduced from ' || base || CASE WHEN caps <> '' THEN ' by ' || caps ELSE '' END ELSE '' END AS reduction, CASE WHEN least(100, adjusted + floor(coalesce(gain, 0))) > adjusted + 5 THEN least(100, adjusted + floor(coalesce(gain, 0)))::INT END AS estimate "
       "FROM ucard LEFT JOIN (SELECT uri, round(sum(score_gain), 6) AS gain, first(collector_id || '/' || signal_type ORDER BY r) AS greatest_one FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY score_gain DESC, signals DESC, collector_id, signal_type) AS r FROM con) WHERE r <= 3 GROUP BY uri) USING (uri) "
       "JOIN (SELECT uri, first(dimension ORDER BY score, dimension) AS worst, coalesce(string_agg(dimension, ',' ORDER BY dimension) FILTER (score < 50), '') AS critical FROM udim GROUP BY uri) USING (uri)")
def score_explanations(spark, sf_dir):
    found = interpreted(spark, sf_dir).repartition("uri")  # all that follows is by document
    return R.explanation(S.scorecards(found, kb_docs(spark, sf_dir).select("uri")), S.contributors(found, ["uri"]), ["uri"])


@query(f"SELECT uri, collector_id, signal_type, score_gain, signals FROM con ORDER BY score_gain DESC, signals DESC, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, collector_id, signal_type, uri LIMIT 50")
def top_contributors(spark, sf_dir):
    """The report's fifty contributors of single documents that are worth most."""
    return R.top_contributors(S.contributors(interpreted(spark, sf_dir), ["uri"]), 50, "uri").select("uri", "collector_id", "signal_type", "score_gain", "signals")


_CHANGES = """SELECT uri, collector_id, signal_type, round(gb - ga, 6) AS gain_delta, (nb - na)::BIGINT AS signals_delta, CASE WHEN round(gb - ga, 6) > 0 OR (round(gb - ga, 6) = 0 AND nb > na) THEN 'regression' WHEN round(gb - ga, 6) < 0 OR nb < na THEN 'improvement' ELSE 'unchanged' END AS change
  FROM (SELECT uri, collector_id, signal_type, coalesce(a.score_gain, 0) AS ga, coalesce(b.score_gain, 0) AS gb, coalesce(a.signals, 0) AS na, coalesce(b.signals, 0) AS nb FROM cona a FULL JOIN conb b USING (uri, collector_id, signal_type))"""


@query(_CHANGES)
def contributor_changes(spark, sf_dir):
    a, b = (S.contributors(x, ["uri"]) for x in run_pair(spark, sf_dir))
    return R.contributor_changes(a, b, ["uri"])


@query(f"SELECT * FROM ({_CHANGES}) ORDER BY abs(gain_delta) DESC, abs(signals_delta) DESC, uri, collector_id, signal_type LIMIT 10")
def top_contributor_changes(spark, sf_dir):
    """The report's ten greatest changes."""
    return R.top_changes(contributor_changes(spark, sf_dir), 10)


_ids = lambda one, other: f"(SELECT DISTINCT collector_id, signal_type, uri FROM {one} EXCEPT SELECT DISTINCT collector_id, signal_type, uri FROM {other})"


@query(f"SELECT collector_id, signal_type, change, uri FROM (SELECT *, row_number() OVER (PARTITION BY collector_id, signal_type, change ORDER BY uri) AS r FROM (SELECT *, 'added' AS change FROM {_ids('rb', 'ra')} UNION ALL SELECT *, 'removed' FROM {_ids('ra', 'rb')})) WHERE r <= 20")
def changed_documents(spark, sf_dir):
    """The report's first twenty documents that gained or lost each kind of finding."""
    return R.changed_ids(*run_pair(spark, sf_dir))


_DIFF = "SELECT signal_id, CASE WHEN a.severity IS NULL THEN 'new' WHEN b.severity IS NULL THEN 'resolved' ELSE 'persistent' END AS change, b.severity AS sev FROM (SELECT DISTINCT signal_id, severity FROM ra) a FULL JOIN (SELECT DISTINCT signal_id, severity FROM rb) b USING (signal_id)"


@query(f"""SELECT *, b - a AS step, 'Score ' || a || ' to ' || b || ': ' || "new" || ' new, ' || resolved || ' resolved.' AS summary, CASE WHEN new_high > 0 THEN 'Look at the new findings of high severity first.' WHEN b - a < 0 THEN 'Look at what made the score fall.' WHEN "new" > 0 THEN 'Look at the new findings.' ELSE 'Nothing to do.' END AS advice
  FROM (SELECT count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'resolved') AS resolved, count(*) FILTER (change = 'persistent') AS persistent, 0::BIGINT AS worse, 0::BIGINT AS better, count(*) FILTER (change = 'new' AND sev IN ('HIGH', 'CRITICAL')) AS new_high FROM ({_DIFF})),
  (SELECT round(avg(adjusted))::INT AS a FROM ucarda), (SELECT round(avg(adjusted))::INT AS b FROM ucardb)""".replace("SELECT *, b - a", 'SELECT "new", resolved, persistent, worse, better, new_high, a AS score_before, b AS score_after, b - a'))
def diff_report(spark, sf_dir):
    a, b = run_pair(spark, sf_dir)
    docs = kb_docs(spark, sf_dir).select("uri")
    score = lambda run: S.overall(S.dimension_scores(S.collector_scores(run, docs), ["uri"]), ["uri"]).agg(F.round(F.avg("adjusted")).cast("int").alias("adjusted"))
    return R.diff_summary(H.signal_diff(a, b), score(a), score(b))


_mean = lambda x: f"(SELECT dimension, avg(score) AS s FROM udim{x} GROUP BY dimension)"


@query(f"SELECT count(*) FILTER (y.s - x.s > 0.001) AS improved, count(*) FILTER (y.s - x.s < -0.001) AS regressed, count(*) FILTER (abs(y.s - x.s) <= 0.001) AS unchanged, round(avg(x.s), 6) AS before, round(avg(y.s), 6) AS after FROM {_mean('a')} x JOIN {_mean('b')} y USING (dimension)")
def health_summary(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("uri")
    means = [S.dimension_scores(S.collector_scores(run, docs), ["uri"]).groupBy("dimension").agg(F.avg("score").alias("score")) for run in run_pair(spark, sf_dir)]
    return R.health_summary(*means)


@query(f"SELECT dimension, round(x.s, 6) AS before, round(y.s, 6) AS after, round(y.s - x.s, 6) AS delta FROM {_mean('a')} x JOIN {_mean('b')} y USING (dimension)")
def dimension_deltas(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("uri")
    means = [S.dimension_scores(S.collector_scores(run, docs), ["uri"]).groupBy("dimension").agg(F.avg("score").alias("score")) for run in run_pair(spark, sf_dir)]
    found = H.dimension_deltas(*means)
    return found.select("dimension", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("SELECT severity, r, uri, collector_id, signal_type FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY uri, collector_id, signal_type, signal_id, occurrence) AS r FROM interp) WHERE r <= CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 3 ELSE 0 END")
def severity_examples(spark, sf_dir):
    """The report's few examples of each severity."""
    return _big(R.examples(interpreted(spark, sf_dir), {"CRITICAL": 5, "HIGH": 5, "MEDIUM": 5, "LOW": 3, "INFO": 3}), "r")


@query("SELECT signal_type, signals, documents, sample FROM (SELECT signal_type, count(*) AS signals, count(DISTINCT uri) AS documents FROM interp GROUP BY signal_type) JOIN (SELECT signal_type, string_agg(uri, ' ' ORDER BY uri) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY signal_type ORDER BY uri) AS r FROM (SELECT DISTINCT signal_type, uri FROM interp)) WHERE r <= 5 GROUP BY signal_type) USING (signal_type)")
def signal_type_summary(spark, sf_dir):
    return R.type_summary(interpreted(spark, sf_dir))


@query("SELECT uri, count(signal_id) AS signals, coalesce(string_agg(DISTINCT signal_type, ',' ORDER BY signal_type), '') AS kinds FROM art LEFT JOIN interp USING (uri) GROUP BY uri")
def documents_with_signals(spark, sf_dir):
    return R.documents_with_signals(kb_docs(spark, sf_dir), interpreted(spark, sf_dir))


@query("""SELECT collector_id, unnest(['findings', 'documents', 'share', 'critical', 'high', 'medium', 'low', 'info']) AS metric, unnest([n::DOUBLE, d::DOUBLE, round(d / (SELECT count(*) FROM art), 6)::DOUBLE, c::DOUBLE, h::DOUBLE, m::DOUBLE, l::DOUBLE, 0::DOUBLE]) AS value FROM (
  SELECT collector_id, count(signal_id) AS n, count(DISTINCT uri) AS d, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l FROM chk LEFT JOIN interp USING (collector_id) GROUP BY collector_id)""")
def collector_metrics(spark, sf_dir):
    return R.collector_metrics(kb_docs(spark, sf_dir), interpreted(spark, sf_dir))


@query("SELECT outcome_id, issue_type, strategy FROM outc ORDER BY created_at DESC, outcome_id LIMIT 20")
def recent_outcomes(spark, sf_dir):
    """The report's twenty newest outcomes, from a log written in two parts."""
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = outcomes(spark, sf_dir)
    for part in (0, 1):
        store.append_log(rows.where(F.crc32("outcome_id") % 2 == part), folder)
    return store.latest(spark.read.parquet(folder), "created_at", 20, "outcome_id").select("outcome_id", "issue_type", "strategy")


_view_parts = {"assessments": "assess", "outcomes": "outc", "traces": "trace", "signals": "vsig", "problems": "vprob"}
oracle.PARTS |= {
    "vsig": "SELECT signal_id, uri AS artifact_uri, collector_id, signal_type, severity, penalty::INT AS score, recommendation, 'hides ' || signal_type AS ai_impact, CASE WHEN doc_id % 7 = 0 THEN 'resolved' ELSE 'persistent' END AS status, doc_id % 30 AS last_seen, doc_id % 5 AS access_count, doc_id % 40 AS created_at FROM interp JOIN (SELECT uri, doc_id FROM kb) USING (uri)",
    "vprob": "SELECT collector_id || ':' || signal_type || ':' || uri AS problem_id, collector_id AS category, uri AS artifact_uris, CASE WHEN penalty > 10 THEN penalty / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS salience, penalty / 100.0::DOUBLE AS encoding_score, 0.5::DOUBLE AS outcome_score, 1 - penalty / 200.0::DOUBLE AS retrieval_score, 1.0::DOUBLE AS staleness_factor, 'open' AS status, signal_type || ' in ' || uri AS description, (penalty % 7)::INT AS created_at, (penalty % 11)::INT AS updated_at FROM (SELECT DISTINCT collector_id, signal_type, uri, penalty FROM interp)",
}


def _view_tables(spark, sf_dir, name):
    """The tables that a view's text names."""
    found = lambda: interpreted(spark, sf_dir)  # noqa: E731  views of runs and outcomes need no findings
    d, p = F.col("doc_id"), F.col("penalty")

    def signals():
        return found().select("signal_id", F.col("uri").alias("artifact_uri"), "collector_id", "signal_type", "severity", p.cast("int").alias("score"), "recommendation", F.concat(F.lit("hides "), "signal_type").alias("ai_impact"), F.when(d % 7 == 0, "resolved").otherwise("persistent").alias("status"), (d % 30).alias("last_seen"), (d % 5).alias("access_count"), (d % 40).alias("created_at"))

    def problems():
        rows = found().select("collector_id", "signal_type", "uri", "penalty").distinct()
        parts = [F.when(p > 10, p / 100).otherwise(0.0).alias("salience"), (p / 100).alias("encoding_score"), F.lit(0.5).alias("outcome_score"), (1 - p / 200).alias("retrieval_score"), F.lit(1.0).alias("staleness_factor")]
        return rows.select(F.concat_ws(":", "collector_id", "signal_type", "uri").alias("problem_id"), F.col("collector_id").alias("category"), F.col("uri").alias("artifact_uris"), *parts, F.lit("open").alias("status"), F.concat("signal_type", F.lit(" in "), "uri").alias("description"), (p % 7).cast("int").alias("created_at"), (p % 11).cast("int").alias("updated_at"))

    make = {"assessments": lambda: assessments(spark, sf_dir), "outcomes": lambda: outcomes(spark, sf_dir), "traces": lambda: _events(spark, sf_dir, TRACES_SQL), "signals": signals, "problems": problems}
    return {k: f() for k, f in make.items() if "{" + k + "}" in R.VIEWS[name]}


#: The documented columns of each view, and what they are taken from.
_VIEW_COLUMNS = {
    "knowledge_health": ("assessment_id, score, dimensions, signals_count, created_at", "(SELECT *, row_number() OVER (ORDER BY created_at DESC, assessment_id DESC) AS r FROM assess) WHERE r = 1"),
    "signals": ("signal_id, artifact_uri, collector_id, signal_type, severity, score, recommendation, ai_impact, status, last_seen, access_count, created_at", "vsig"),
    "problem_queue": ("problem_id, category, artifact_uris, salience, encoding_score, outcome_score, retrieval_score, staleness_factor, status, description, created_at, updated_at", "vprob WHERE salience > 0"),
    "remediation_history": ("outcome_id, issue_type, strategy, strategy_description, verification_outcome, score_before, score_after, proposal_reasoning, tokens_used, latency_ms, forked, created_at", "outc"),
    "health_trend": ("day, avg(score) AS avg_score, count(*) AS assessment_count, avg(signals_count) AS avg_signals", "(SELECT *, date_trunc('day', created_at) AS day FROM assess WHERE created_at > TIMESTAMP '2024-01-01 00:00:00') GROUP BY day"),
    "decision_traces": ("trace_id, t.outcome_id, stage, reasoning, llm_metadata, t.created_at, issue_type, strategy", "trace t LEFT JOIN outc h ON h.outcome_id = t.outcome_id"),
    "remediation_metrics": ("count(*) AS total_workflows, sum((verification_outcome = 'resolved')::INT)::BIGINT AS problems_resolved, sum((verification_outcome = 'partially_resolved')::INT)::BIGINT AS problems_partially_resolved, round(avg(score_after - score_before), 6) AS avg_score_improvement, round(avg(tokens_used), 6) AS avg_tokens_per_workflow", "outc"),
    "assessment_history": ("assessment_id, score, dimensions, signals_count, source, git_commit, created_at", "assess"),
    "remediation_context": ("outcome_id, issue_type, strategy, strategy_description, verification_outcome, score_before, score_after, proposal_reasoning, modification_steps, tokens_used, created_at", "outc"),
}


def _register_view(name):
    columns, source = _VIEW_COLUMNS[name]
    QUERIES[f"view_{name}"] = lambda spark, sf_dir: _plain_times(R.view(prepare(spark), name, **_view_tables(spark, sf_dir, name)))
    ORACLES[f"view_{name}"] = sql(f"SELECT {columns} FROM {source}")


for _name in R.VIEWS:
    _register_view(_name)
