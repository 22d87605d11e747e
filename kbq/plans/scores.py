"""Queries over scores, history and remembered outcomes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import history as H
from kbq.operators import parse
from kbq.operators import scoring as S
from kbq.plans import oracle
from kbq.plans.checks import _big, kb
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import sql
from kbq.session import once_per_input, prepare, table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_DIM = {name: dimension for name, (dimension, _, _) in C.REGISTRY.items()}
_alpha = "(CASE WHEN connectivity < 30 THEN connectivity / 30.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN trust < 20 THEN trust / 20.0::DOUBLE ELSE 1.0::DOUBLE END)"
_overall = lambda by: f"""SELECT {by}, trust, context, consistency, retrieval, connectivity, workflow, base, least(trunc(base * {_alpha} * CASE WHEN trust < 40 THEN 0.5::DOUBLE + trust / 80.0::DOUBLE ELSE 1.0::DOUBLE END),
  CASE WHEN connectivity < 30 THEN 50 ELSE 100 END, CASE WHEN trust < 20 THEN 40 ELSE 100 END, CASE WHEN retrieval < 30 THEN 45 ELSE 100 END, CASE WHEN least(trust, context, consistency, retrieval, connectivity, workflow) = 0 THEN 30 ELSE 100 END)::INT AS adjusted,
  concat_ws(',', CASE WHEN connectivity < 30 THEN 'connectivity_critical' END, CASE WHEN trust < 20 THEN 'trust_critical' END, CASE WHEN retrieval < 30 THEN 'retrieval_critical' END, CASE WHEN least(trust, context, consistency, retrieval, connectivity, workflow) = 0 THEN 'zero_dimension' END) AS caps
  FROM (SELECT *, trunc(trust * 0.2::DOUBLE + context * 0.15::DOUBLE + consistency * 0.2::DOUBLE + retrieval * 0.25::DOUBLE + connectivity * 0.1::DOUBLE + workflow * 0.1::DOUBLE)::INT AS base
  FROM (SELECT {by}, {", ".join(f"max(score) FILTER (dimension = '{d}') AS {d}" for d in S.WEIGHTS)} FROM {{dims}} GROUP BY {by}))"""  # noqa: E731
oracle.PARTS |= {
    "pol": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}, '{oracle._q(e)}')" for a, b, c, d, e in S.POLICY) + ") AS v(collector_id, signal_type, severity, penalty, recommendation)",
    "chk": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in _DIM.items()) + ") AS v(collector_id, dimension)",
    "interp": "SELECT s.*, coalesce(p.severity, 'LOW') AS severity, coalesce(p.penalty, 100) AS penalty, p.recommendation, a.lang FROM signal s JOIN art a ON s.uri = a.uri LEFT JOIN pol p ON s.collector_id = p.collector_id AND s.signal_type = p.signal_type",
    "ucol": "SELECT a.uri, dimension, c.collector_id, greatest(0, 100 - coalesce(sum(penalty), 0))::INT AS score, count(penalty) AS signals FROM art a CROSS JOIN chk c LEFT JOIN interp i ON i.uri = a.uri AND i.collector_id = c.collector_id GROUP BY ALL",
    "udim": "SELECT uri, dimension, floor(avg(score))::INT AS score, sum(signals)::BIGINT AS signals FROM ucol GROUP BY uri, dimension",
    "lcol": "SELECT a.lang, dimension, c.collector_id, greatest(0, 100 - coalesce(sum(penalty), 0))::INT AS score, count(penalty) AS signals FROM (SELECT DISTINCT lang FROM art) a CROSS JOIN chk c LEFT JOIN interp i ON i.lang = a.lang AND i.collector_id = c.collector_id GROUP BY ALL",
    "ldim": "SELECT lang, dimension, floor(avg(score))::INT AS score, sum(signals)::BIGINT AS signals FROM lcol GROUP BY lang, dimension",
    "ucard": _overall("uri").format(dims="udim"),
    "day": "SELECT *, dense_rank() OVER (ORDER BY d) AS run FROM (SELECT *, ts::DATE AS d FROM events)",
    "seen": "SELECT DISTINCT run, user_id::VARCHAR || ':' || event_type AS signal_id FROM day",
    "runs": "SELECT run, d, count(*) AS events, (100 * avg((value < 50)::INT))::INT AS score FROM day GROUP BY run, d",
    "tries": "SELECT lpad((user_id % 20)::VARCHAR, 2, '0') AS issue_type, event_type AS strategy, event_id AS seq, CASE WHEN value >= 75 THEN 1.0::DOUBLE WHEN value >= 50 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS value FROM events",
}


def query(oracle_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle_sql is not None:
            ORACLES[f.__name__] = sql(oracle_sql)
        return f

    return add


@once_per_input
def interpreted(spark, sf_dir):
    """Findings under the policy, with their document's language and number: what queries tell apart by document needs no join."""
    docs = kb_docs(spark, sf_dir).select("uri", "lang", "doc_id")
    return written(S.interpret(C.signals(kb(spark, sf_dir)), S.policy(spark)).join(docs, "uri"), "signals")


def by_document(spark, sf_dir):
    return S.collector_scores(interpreted(spark, sf_dir), kb_docs(spark, sf_dir).select("uri"))


@query("SELECT signal_id, uri, collector_id, signal_type, severity, penalty::BIGINT AS penalty, recommendation, occurrence::BIGINT AS occurrence FROM interp")
def interpreted_signals(spark, sf_dir):
    return _big(interpreted(spark, sf_dir).select("signal_id", "uri", "collector_id", "signal_type", "severity", "penalty", "recommendation", "occurrence"), "penalty", "occurrence")


@query("SELECT lang, dimension, collector_id, score, signals FROM lcol")
def collector_scores(spark, sf_dir):
    return S.collector_scores(interpreted(spark, sf_dir), kb_docs(spark, sf_dir).select("lang").distinct())


@query("SELECT uri, dimension, score, signals FROM udim")
def dimension_scores(spark, sf_dir):
    return S.dimension_scores(by_document(spark, sf_dir), ["uri"])


@query("SELECT * FROM ucard")
def document_scorecard(spark, sf_dir):
    """Every document's scores: the flagship."""
    return S.scorecards(interpreted(spark, sf_dir), kb_docs(spark, sf_dir).select("uri"))


@query(_overall("lang").format(dims="ldim"))
def overall_score(spark, sf_dir):
    return S.overall(S.dimension_scores(collector_scores(spark, sf_dir), ["lang"]), ["lang"])


@query("SELECT uri, first(dimension ORDER BY score, signals DESC, dimension) AS worst, count(*) FILTER (score < 50) AS critical FROM udim GROUP BY uri")
def worst_dimension(spark, sf_dir):
    dims = dimension_scores(spark, sf_dir)
    worst = F.min_by("dimension", F.struct("score", -F.col("signals"), "dimension"))
    return dims.groupBy("uri").agg(worst.alias("worst"), F.count_if(F.col("score") < 50).alias("critical"))


_weight = "CASE dimension " + " ".join(f"WHEN '{d}' THEN {w}::DOUBLE" for d, w in S.WEIGHTS.items()) + " END"


@query(f"SELECT uri, dimension, score, signals, round((100 - score) * {_weight}, 6) AS lost FROM udim")
def dominant_dimensions(spark, sf_dir):
    return S.dominant(dimension_scores(spark, sf_dir))


@query(f"""SELECT dimension, collector_id, signal_type, signals, documents, penalty, severity, (greatest(0, 100 - greatest(0, total - penalty)) - greatest(0, 100 - total))::BIGINT AS collector_gain,
  round((greatest(0, 100 - greatest(0, total - penalty)) - greatest(0, 100 - total)) / checks * ({_weight}), 6) AS score_gain
  FROM (SELECT *, sum(penalty) OVER (PARTITION BY collector_id) AS total, (SELECT count(*) FROM chk x WHERE x.dimension = g.dimension) AS checks FROM (
  SELECT c.dimension, i.collector_id, signal_type, count(*) AS signals, count(DISTINCT uri) AS documents, sum(penalty)::BIGINT AS penalty, any_value(severity) AS severity FROM interp i JOIN chk c ON i.collector_id = c.collector_id GROUP BY ALL) g)""")
def score_contributors(spark, sf_dir):
    return S.contributors(interpreted(spark, sf_dir))


@query("SELECT severity, count(*) AS signals, count(DISTINCT uri) AS documents FROM interp GROUP BY severity")
def severity_counts(spark, sf_dir):
    return interpreted(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("signals"), F.countDistinct("uri").alias("documents"))


@query("""SELECT lang, CASE WHEN docs < 10 OR signals < 5 THEN 'INSUFFICIENT_DATA' WHEN adjusted < 30 OR critical >= 3 THEN 'CRITICAL' WHEN adjusted >= 70 AND critical = 0 THEN 'HEALTHY' ELSE 'MODERATE' END AS verdict
  FROM (""" + _overall("lang").format(dims="ldim") + """) JOIN (SELECT lang, count(*) AS docs FROM art GROUP BY lang) USING (lang) JOIN (SELECT lang, count(*) AS signals, count(*) FILTER (severity = 'CRITICAL') AS critical FROM interp GROUP BY lang) USING (lang)""")
def verdict(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"))
    counts = interpreted(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("signals"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))
    scored = overall_score(spark, sf_dir).join(docs, "lang").join(counts, "lang")
    return scored.select("lang", S.verdict(F.col("adjusted"), F.col("docs"), F.col("signals"), F.col("critical"), F.lit(0), F.lit(None).cast("int")).alias("verdict"))


_corpus = _overall("corpus").format(dims="(SELECT 'all' AS corpus, dimension, floor(avg(score))::INT AS score FROM (SELECT dimension, c.collector_id, greatest(0, 100 - coalesce(sum(penalty), 0))::INT AS score FROM chk c LEFT JOIN interp i USING (collector_id) GROUP BY ALL) GROUP BY dimension)")


@query(f"SELECT CASE WHEN (SELECT bool_or(severity = 'CRITICAL') FROM interp) THEN 2 WHEN adjusted < 60 THEN 1 ELSE 0 END::INT AS exit_code FROM ({_corpus})")
def exit_gate(spark, sf_dir):
    return S.gate(interpreted(spark, sf_dir), S.corpus(interpreted(spark, sf_dir)), ["CRITICAL"], 60)


_doc_gate = "SELECT uri, CASE WHEN coalesce(hit, false) THEN 2 WHEN adjusted < 60 THEN 1 ELSE 0 END::INT AS exit_code FROM ucard LEFT JOIN (SELECT uri, bool_or(severity = 'CRITICAL') AS hit FROM interp GROUP BY uri) USING (uri)"


@query(_doc_gate)
def document_gates(spark, sf_dir):
    """The gate for every document by itself: all three codes occur."""
    return S.gates(interpreted(spark, sf_dir), document_scorecard(spark, sf_dir), ["uri"], ["CRITICAL"], 60)


@query("""SELECT run::BIGINT AS run, score, CASE WHEN users < 10 OR events < 5 THEN 'INSUFFICIENT_DATA' WHEN date_diff('day', d, DATE '2024-04-15') > 90 THEN 'STALE' WHEN score < 30 OR critical >= 8 THEN 'CRITICAL' WHEN prior - score > 4 THEN 'DEGRADING' WHEN score >= 51 AND critical <= 2 THEN 'HEALTHY' ELSE 'MODERATE' END AS verdict
  FROM (SELECT *, lag(score) OVER (ORDER BY run) AS prior FROM (SELECT run, d, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (value >= 99) AS critical, round(100 * avg((value < 50)::INT))::INT AS score FROM day GROUP BY run, d))""")
def run_verdicts(spark, sf_dir):
    """A verdict for every day as a run, with the run before it and its age on a stated day; thresholds that let every verdict occur."""
    rows = day_runs(spark, sf_dir).groupBy("run", "d").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") >= 99).alias("critical"), F.round(100 * F.avg((F.col("value") < 50).cast("int"))).cast("int").alias("score"))
    one = rows.withColumn("prior", F.lag("score").over(Window.orderBy("run")))  # one row a run
    age = F.date_diff(F.lit("2024-04-15").cast("date"), "d")
    found = S.verdict(F.col("score"), F.col("users"), F.col("events"), F.col("critical"), age, F.col("prior"), drop=4, critical_from=8, healthy_from=51, healthy_critical=2)
    return _big(one.select("run", "score", found.alias("verdict")), "run")


@query("""SELECT collector_id || '/' || signal_type AS rule_id, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS level, coalesce(recommendation, '') AS message, uri AS location, coalesce(line, 1) AS start_line, signal_id AS fingerprint FROM interp""")
def sarif_rows(spark, sf_dir):
    return S.sarif(interpreted(spark, sf_dir))


def day_runs(spark, sf_dir):
    """Events as runs: a day is a run. The ranking window sees one row a day."""
    events = table(prepare(spark), sf_dir, "events").withColumn("d", F.to_date("ts"))
    numbered = events.select("d").distinct().withColumn("run", F.row_number().over(Window.orderBy("d")))
    return events.join(F.broadcast(numbered), "d")


def seen(spark, sf_dir):
    return day_runs(spark, sf_dir).select("run", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id")).distinct()


@query("""SELECT signal_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'resolved' WHEN b > a THEN 'worse' WHEN b < a THEN 'better' ELSE 'persistent' END AS change FROM
  (SELECT user_id::VARCHAR || ':' || event_type AS signal_id, max((value >= 90)::INT * 2 + 1) AS a FROM day WHERE run <= 15 GROUP BY 1) x FULL JOIN (SELECT user_id::VARCHAR || ':' || event_type AS signal_id, max((value >= 90)::INT * 2 + 1) AS b FROM day WHERE run > 15 GROUP BY 1) y USING (signal_id)""")
def signal_diff(spark, sf_dir):
    """Two half-months compared; a user's event is severe if its value reaches 90."""
    rows = day_runs(spark, sf_dir).withColumn("signal_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    half = lambda cond: rows.where(cond).groupBy("signal_id").agg(F.when(F.max("value") >= 90, "HIGH").otherwise("LOW").alias("severity"))
    return H.signal_diff(half("run <= 15"), half("run > 15")).select("signal_id", "change")


@query("""SELECT signal_id, first_seen::BIGINT AS first_seen, last_seen::BIGINT AS last_seen, runs, CASE WHEN last_seen < (SELECT max(run) FROM seen) THEN 'resolved' WHEN gap THEN 'recurring' WHEN first_seen = (SELECT max(run) FROM seen) THEN 'new' ELSE 'persistent' END AS status
  FROM (SELECT signal_id, min(run) AS first_seen, max(run) AS last_seen, count(*) AS runs, coalesce(bool_or(run - p > 1), false) AS gap FROM (SELECT *, lag(run) OVER (PARTITION BY signal_id ORDER BY run) AS p FROM seen) GROUP BY signal_id)""")
def signal_lifecycle(spark, sf_dir):
    return _big(H.lifecycle(seen(spark, sf_dir)), "first_seen", "last_seen")


@query("""SELECT CASE WHEN last_seen < (SELECT max(run) FROM seen) THEN 'resolved' WHEN gap THEN 'recurring' WHEN first_seen = (SELECT max(run) FROM seen) THEN 'new' ELSE 'persistent' END AS status, count(*) AS signals, round(avg(last_seen - first_seen), 1) AS mean_age
  FROM (SELECT signal_id, min(run) AS first_seen, max(run) AS last_seen, coalesce(bool_or(run - p > 1), false) AS gap FROM (SELECT *, lag(run) OVER (PARTITION BY signal_id ORDER BY run) AS p FROM seen) GROUP BY signal_id) GROUP BY 1""")
def lifecycle_stats(spark, sf_dir):
    return signal_lifecycle(spark, sf_dir).groupBy("status").agg(F.count("*").alias("signals"), F.round(F.avg(F.col("last_seen") - F.col("first_seen")), 1).alias("mean_age"))


def run_scores(spark, sf_dir):
    return day_runs(spark, sf_dir).groupBy("run", "d").agg(F.count("*").alias("events"), F.round(100 * F.avg((F.col("value") < 50).cast("int"))).cast("int").alias("score"))


@query("SELECT run::BIGINT AS run, d, events, score, (lead(score) OVER (ORDER BY run) - score)::INT AS delta_to_newer FROM runs")
def daily_health(spark, sf_dir):
    """One row a day, with the step to the newer run beside it."""
    w = Window.orderBy("run")
    return _big(run_scores(spark, sf_dir).withColumn("delta_to_newer", F.lead("score").over(w) - F.col("score")), "run")


@query("""SELECT count(*) AS runs, max_by(score, r)::INT AS first_score, min_by(score, r)::INT AS last_score, CASE WHEN count(*) < 2 THEN 'unknown' WHEN min_by(score, r) - max_by(score, r) > 3 THEN 'improving' WHEN min_by(score, r) - max_by(score, r) < -3 THEN 'worsening' ELSE 'stable' END AS trend FROM (SELECT *, row_number() OVER (ORDER BY run DESC) AS r FROM runs) WHERE r <= 3""")
def trend(spark, sf_dir):
    return H.trajectory(run_scores(spark, sf_dir))


_EMA = "sum(power(0.7::DOUBLE, n - i) * 0.3::DOUBLE * value)"
_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY issue_type, strategy ORDER BY seq) AS i, count(*) OVER (PARTITION BY issue_type, strategy) AS n FROM tries)"


def outcomes(spark, sf_dir):
    value = F.when(F.col("value") >= 75, 1.0).when(F.col("value") >= 50, 0.5).otherwise(0.0)
    return table(prepare(spark), sf_dir, "events").select(F.lpad((F.col("user_id") % 20).cast("string"), 2, "0").alias("issue_type"), F.col("event_type").alias("strategy"), F.col("event_id").alias("at"), value.alias("value"))


@query(f"SELECT issue_type, strategy, n, round(ema, 6) AS ema, round(greatest(ema, 0.1::DOUBLE * max(ema) OVER (PARTITION BY issue_type)), 6) AS floored FROM (SELECT issue_type, strategy, max(n) AS n, {_EMA} + 0.5::DOUBLE * power(0.7::DOUBLE, max(n)) AS ema FROM {_NUMBERED} GROUP BY ALL)")
def strategy_ema(spark, sf_dir):
    found = H.ema(outcomes(spark, sf_dir))
    best = F.max("ema").over(Window.partitionBy("issue_type"))
    return found.select("issue_type", "strategy", "n", F.round("ema", 6).alias("ema"), F.round(F.greatest("ema", F.lit(0.1) * best), 6).alias("floored"))


@query(f"SELECT issue_type, strategy, max(n) AS n, round(sum(CASE WHEN i = 1 THEN power(0.7::DOUBLE, n - 1) ELSE power(0.7::DOUBLE, n - i) * 0.3::DOUBLE END * value), 6) AS ema FROM {_NUMBERED} GROUP BY ALL")
def strategy_ema_first_obs(spark, sf_dir):
    return H.ema(outcomes(spark, sf_dir), start=None).withColumn("ema", F.round("ema", 6))


@query("SELECT issue_type, strategy, count(*) AS n, count(*) FILTER (value = 1) AS successes, round(avg((value = 1)::INT), 6) AS rate FROM tries GROUP BY ALL")
def strategy_stats(spark, sf_dir):
    won = F.col("value") == 1
    return outcomes(spark, sf_dir).groupBy("issue_type", "strategy").agg(F.count("*").alias("n"), F.count_if(won).alias("successes"), F.round(F.avg(won.cast("int")), 6).alias("rate"))


@query("SELECT count(*) AS outcomes, count(*) FILTER (value = 1) AS resolved, count(*) FILTER (value = 0.5) AS partial, round(avg((value = 1)::INT), 6) AS success_rate, round((SELECT avg((n > 1)::INT) FROM (SELECT count(*) AS n FROM tries GROUP BY issue_type, strategy)), 6) AS reuse_rate FROM tries")
def remediation_metrics(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    reuse = rows.groupBy("issue_type", "strategy").count().agg(F.round(F.avg((F.col("count") > 1).cast("int")), 6).alias("reuse_rate"))
    one = rows.agg(F.count("*").alias("outcomes"), F.count_if(F.col("value") == 1).alias("resolved"), F.count_if(F.col("value") == 0.5).alias("partial"), F.round(F.avg((F.col("value") == 1).cast("int")), 6).alias("success_rate"))
    return one.crossJoin(reuse)  # one row each


@query("""SELECT n, round(r, 6) AS r, round(tanh(0.5 * ln((1 + c) / (1 - c)) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(0.5 * ln((1 + c) / (1 - c)) + 1.96 / sqrt(n - 3)), 6) AS high, CASE WHEN n < 20 THEN 'insufficient_data' WHEN r > 0.3 THEN 'healthy' WHEN r < -0.3 THEN 'inverted' WHEN abs(r) < 0.1 THEN 'noise' ELSE 'weak' END AS status
  FROM (SELECT *, least(greatest(r, -0.999), 0.999) AS c FROM (SELECT count(*) AS n, coalesce(corr(quality::DOUBLE, toxic::DOUBLE), 0) AS r FROM (SELECT * FROM labels ORDER BY doc_id DESC LIMIT 100)))""")
def diagnosis_quality(spark, sf_dir):
    return H.diagnosis_quality(table(prepare(spark), sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("confidence"), F.col("toxic").cast("double").alias("outcome")))


@query("""SELECT uri, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'deleted' ELSE 'modified' END AS event, doc_id % 10 IN (0, 1) AS links_changed FROM art WHERE doc_id % 10 IN (0, 1, 2)""")
def change_events(spark, sf_dir):
    """Snapshots of which one lacks a tenth of the documents, the other another tenth, and a tenth was edited."""
    parsed = kb(spark, sf_dir).artifacts
    ids = kb_docs(spark, sf_dir).select("uri", "doc_id")
    snap = parsed.join(ids, "uri").join(parse.link_fingerprints(parsed), "uri").select("uri", "doc_id", F.sha2("body", 256).alias("content_hash"), F.sha2(F.array_join("targets", " "), 256).alias("links_hash"))
    edited = snap.withColumn("content_hash", F.when(F.col("doc_id") % 10 == 2, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return H.changes(snap.where("doc_id % 10 <> 0").drop("doc_id"), edited.where("doc_id % 10 <> 1").drop("doc_id"))


@query("SELECT signal_id, max(run)::BIGINT AS run, arg_max(n, run) AS n FROM (SELECT run, user_id::VARCHAR || ':' || event_type AS signal_id, count(*) AS n FROM day GROUP BY ALL) GROUP BY signal_id")
def upserted_signals(spark, sf_dir):
    """The last day's rows put over the newest row of each signal of all days before."""
    rows = written(day_runs(spark, sf_dir).groupBy("run", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id")).agg(F.count("*").alias("n")), "run-signals")
    last = rows.agg(F.max("run").alias("last"))
    marked = rows.crossJoin(F.broadcast(last))  # one row
    newest = marked.where("run < last").groupBy("signal_id").agg(F.max("run").alias("run"), F.max_by("n", "run").alias("n"))
    return _big(H.upsert(newest, marked.where("run = last").select("signal_id", "run", "n"), ["signal_id"]), "run").select("signal_id", "run", "n")
