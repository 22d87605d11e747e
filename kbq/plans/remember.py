"""Queries over what past remediations tell, over validation by other means, and over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import memory as M
from kbq.operators import parse
from kbq.operators import problems as P
from kbq.operators import store
from kbq.operators import validation as V
from kbq.plans import oracle
from kbq.plans.checks import _big, kb
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import _list, sql
from kbq.plans.runs import _plain_times, outcomes, run_pair
from kbq.plans.scores import interpreted, seen
from kbq.session import prepare, shared_folder, table, written
from kbq.streaming import runs as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle_sql is not None:
            ORACLES[f.__name__] = sql(oracle_sql)
        return f

    return add


_WON = "(SELECT issue_type, strategy, count(*) FILTER (verification_outcome = 'resolved') AS succeeded, count(*) FILTER (verification_outcome IN ('unchanged', 'regressed', 'misdiagnosed')) AS failed, round(avg(score_after - score_before), 6) AS mean_gain FROM outc GROUP BY issue_type, strategy)"


@query(f"SELECT * FROM {_WON}")
def strategy_outcomes(spark, sf_dir):
    return M.strategy_outcomes(outcomes(spark, sf_dir))


@query(f"""SELECT issue_type, strategy, succeeded, false AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY succeeded DESC, strategy) AS r FROM {_WON} WHERE succeeded > 0) WHERE r <= 3 AND issue_type < '10'
  UNION ALL SELECT issue_type, strategy, succeeded, true FROM (SELECT DISTINCT lang AS issue_type FROM documents), (SELECT strategy, sum(succeeded)::BIGINT AS succeeded FROM {_WON} WHERE succeeded > 0 GROUP BY strategy ORDER BY 2 DESC, 1 LIMIT 3)""")
def suggested_strategies(spark, sf_dir):
    """Of known issue types and of some without history."""
    past = outcomes(spark, sf_dir)
    asked = past.where("issue_type < '10'").select("issue_type").union(table(spark, sf_dir, "documents").select("lang"))
    return M.strategies_for(asked, past)


oracle.PARTS |= {
    "asks": "SELECT 'p' || doc_id AS problem_id, lpad((doc_id % 20)::VARCHAR, 2, '0') AS issue_type, ['kb/s' || (doc_id % 700), 'kb/s' || (doc_id % 33)] AS uris FROM documents",
    "met": "SELECT a.problem_id, o.outcome_id, max(o.created_at) AS created_at FROM (SELECT problem_id, issue_type, unnest(uris) AS uri FROM asks) a JOIN outc o ON a.issue_type = o.issue_type AND a.uri = o.uri GROUP BY ALL",
}


@query("""SELECT problem_id, outcome_id, true AS overlaps FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY created_at DESC, outcome_id) AS r FROM met) WHERE r <= 5
  UNION ALL SELECT problem_id, outcome_id, false FROM asks JOIN (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY created_at DESC, outcome_id) AS r FROM outc) o USING (issue_type) WHERE o.r <= 5 AND problem_id NOT IN (SELECT problem_id FROM met)""")
def similar_problems(spark, sf_dir):
    """Past outcomes of the same type and documents, or else the newest of the type (the report's five)."""
    d = F.col("doc_id")
    place = lambda n: F.concat(F.lit("kb/s"), (d % n).cast("string"))
    asked = table(prepare(spark), sf_dir, "documents").select(F.concat(F.lit("p"), d.cast("string")).alias("problem_id"), F.lpad((d % 20).cast("string"), 2, "0").alias("issue_type"), F.array(place(700), place(33)).alias("uris"))
    return M.similar(asked, outcomes(spark, sf_dir).withColumn("uris", F.array("uri")))


@query("SELECT DISTINCT signal_type, uri FROM interp WHERE uri NOT LIKE '%3.md' OR severity <> 'MEDIUM'")
def untried_steps(spark, sf_dir):
    """Steps for findings, less those that failed on the same document."""
    found = interpreted(spark, sf_dir).select("signal_type", "uri", "severity")
    return M.drop_failed(found.select("signal_type", "uri").distinct(), found.where("severity = 'MEDIUM' AND uri LIKE '%3.md'").join(found.where("severity <> 'MEDIUM'"), ["signal_type", "uri"], "left_anti"))


_STEPS = "SELECT doc_id % 3 AS proposal, doc_id AS step, CASE doc_id % 6 WHEN 0 THEN 'add_metadata' WHEN 1 THEN 'update_document' WHEN 2 THEN 'merge_artifacts' WHEN 3 THEN 'archive_artifact' WHEN 4 THEN 'dance' ELSE 'create_document' END AS step_type, CASE WHEN doc_id % 4 = 0 THEN 'no_date_signal' WHEN doc_id % 4 = 1 THEN 'orphan_artifact' ELSE 'mixed_topics' END AS signal_type, 'kb/s' || (doc_id % 40) AS uri, CASE WHEN doc_id % 2 = 0 THEN 'Give it a  date' ELSE ' give IT a date' END AS description, doc_id % 7 > 0 AS applied, doc_id % 11 > 0 AS success FROM {documents}"
oracle.PARTS["steps"] = _STEPS.format(documents="documents")


def steps(spark, sf_dir):
    return prepare(spark).sql(_STEPS, documents=table(spark, sf_dir, "documents"))


@query("SELECT proposal, step, step_type, uri FROM (SELECT *, row_number() OVER (PARTITION BY step_type, uri, lower(trim(description)).regexp_replace('\\s+', ' ', 'g') ORDER BY proposal, step) AS r FROM steps) WHERE r = 1")
def distinct_steps(spark, sf_dir):
    return M.first_of_duplicates(steps(spark, sf_dir)).select("proposal", "step", "step_type", "uri")


@query(f"SELECT step, CASE WHEN step_type IN ({_list(M.IMPLEMENTED_STEPS)}) THEN 'kept' WHEN step_type NOT IN ({_list(M.DISABLED_STEPS)}) THEN 'skipped_unknown' WHEN signal_type IN ('no_date_signal', 'orphan_artifact') THEN 'replaced' ELSE 'skipped_disabled' END AS action, "
       f"CASE WHEN step_type IN ({_list(M.IMPLEMENTED_STEPS)}) THEN step_type WHEN step_type IN ({_list(M.DISABLED_STEPS)}) THEN CASE signal_type WHEN 'no_date_signal' THEN 'add_metadata' WHEN 'orphan_artifact' THEN 'create_relationship' END END AS to_type FROM steps")
def constrained_steps(spark, sf_dir):
    replaced = spark.createDataFrame([("no_date_signal", "add_metadata"), ("orphan_artifact", "create_relationship")], "signal_type string, to_type string")
    return M.constrain(steps(spark, sf_dir), replaced).select("step", "action", "to_type")


@query("SELECT uri, count(*) AS steps, count(*) FILTER (applied AND success) AS applied, count(*) FILTER (NOT applied) AS skipped, count(*) FILTER (applied AND NOT success) AS failed, count(*) FILTER (applied AND success) > 0 AND count(*) FILTER (applied AND NOT success) = 0 AS verify FROM steps GROUP BY uri")
def step_results(spark, sf_dir):
    return M.step_results(steps(spark, sf_dir), ["uri"])


@query("SELECT DISTINCT uri FROM steps WHERE applied AND success")
def modified_by_steps(spark, sf_dir):
    return M.modified_uris(steps(spark, sf_dir))


@query("SELECT step FROM (SELECT step, CASE WHEN step % 5 = 0 THEN 'Fix' WHEN step % 5 = 1 THEN 'split_up' WHEN step % 5 = 2 THEN 'Add_Dates' ELSE 'add_links' END AS strategy, CASE WHEN step % 3 = 0 THEN 'short' ELSE 'a description of enough length' END AS d, step % 4 AS n FROM steps) WHERE lower(strategy) NOT IN ('fix', 'add_dates') AND length(d) >= 20 AND n > 0")
def acceptable_proposals(spark, sf_dir):
    step = F.col("step")
    named = F.when(step % 5 == 0, "Fix").when(step % 5 == 1, "split_up").when(step % 5 == 2, "Add_Dates").otherwise("add_links")
    made = steps(spark, sf_dir).select("step", named.alias("strategy"), F.when(step % 3 == 0, "short").otherwise("a description of enough length").alias("description"), (step % 4).alias("n_steps"))
    return M.acceptable(made, spark.createDataFrame([("add_dates",)], "strategy string")).select("step")


_kinds = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}')" for c, kinds in M.CATEGORY_KINDS.items() for k in kinds) + ") AS v(category, signal_type)"


@query(f"SELECT category, i.signal_type, count(*) AS signals FROM ({_kinds}) v JOIN interp i ON i.signal_type = v.signal_type GROUP BY ALL")
def category_signals(spark, sf_dir):
    """How many findings each problem category stands for."""
    kinds = M.kinds_of(spark.createDataFrame([(c,) for c in M.CATEGORY_KINDS], "category string"))
    return interpreted(spark, sf_dir).join(F.broadcast(kinds), "signal_type").groupBy("category", "signal_type").agg(F.count("*").alias("signals"))


@query(f"SELECT issue_type, sum(failed)::BIGINT AS avoided, count(*) FILTER (succeeded + failed > 1) AS reused, first(strategy ORDER BY mean_gain DESC, strategy DESC) FILTER (succeeded + failed > 1) AS best FROM {_WON} GROUP BY issue_type")
def memory_summaries(spark, sf_dir):
    return M.memory_summary(outcomes(spark, sf_dir))


_QUEUE = "SELECT 'p' || doc_id AS problem_id, source AS category, CASE WHEN doc_id % 3 = 0 THEN 'open' WHEN doc_id % 3 = 1 THEN 'closed' ELSE 'wont_fix' END AS status, (doc_id % 100)::DOUBLE / 100 AS salience FROM documents"


def _queue(spark, sf_dir):
    d = F.col("doc_id")
    status = F.when(d % 3 == 0, "open").when(d % 3 == 1, "closed").otherwise("wont_fix")
    return table(prepare(spark), sf_dir, "documents").select(F.concat(F.lit("p"), d.cast("string")).alias("problem_id"), F.col("source").alias("category"), F.array(F.concat(F.lit("u"), d.cast("string"))).alias("uris"), ((d % 100).cast("double") / 100).alias("salience"), status.alias("status"))


@query(f"SELECT status, category, count(*) AS problems, round(sum(salience), 4) AS salience FROM ({_QUEUE}) GROUP BY GROUPING SETS ((status), (category))")
def queue_summary(spark, sf_dir):
    return M.queue_summary(_queue(spark, sf_dir))


@query(f"""SELECT coalesce(q.problem_id, n.problem_id) AS problem_id, coalesce(q.category, n.category) AS category, CASE WHEN n.salience IS NOT NULL AND coalesce(q.status = 'open', true) THEN n.salience ELSE q.salience END AS salience, coalesce(q.status, 'open') AS status
  FROM (SELECT * FROM ({_QUEUE}) WHERE problem_id NOT LIKE '%8') q FULL JOIN (SELECT problem_id, category, salience / 2 AS salience FROM ({_QUEUE}) WHERE problem_id NOT LIKE '%9' AND NOT (problem_id LIKE '%18')) n ON q.problem_id = n.problem_id""")
def upserted_queue(spark, sf_dir):
    """Open problems take a new salience, closed ones stay closed, and some new ones are not to be fixed."""
    every = _queue(spark, sf_dir)
    wont = every.where("problem_id LIKE '%18'").select(P.signature(F.col("category"), F.col("uris")).alias("signature"))
    found = every.where("problem_id NOT LIKE '%9'").select("problem_id", "category", "uris", (F.col("salience") / 2).alias("salience"))
    return P.upsert_queue(every.where("problem_id NOT LIKE '%8'"), found, wont).drop("uris")


oracle.PARTS |= {
    "tagged": "SELECT signal_id, signal_type, uri, max(w) AS w, max(t) AS t FROM (SELECT signal_id, signal_type, uri, 1 AS w, 0 AS t FROM ra UNION ALL SELECT signal_id, signal_type, uri, 0, 1 FROM rb) GROUP BY ALL",
    "vp": "SELECT 'p' || doc_id AS problem_id, uri, CASE WHEN doc_id % 10 = 1 THEN 'terminology_inconsistency' WHEN doc_id % 10 = 2 THEN 'poor_structure' ELSE 'missing_metadata' END AS category, doc_id FROM kb",
    "vid": "SELECT p.problem_id, sum(w) AS was, sum(w * t) AS remaining, sum((1 - w) * t) AS new_ FROM vp p JOIN tagged g ON p.uri = g.uri WHERE doc_id % 4 <> 0 AND (doc_id % 10 > 1 OR signal_type IN ('terminology_variant', 'generic', 'placeholder')) GROUP BY 1",
    "vkind": f"SELECT p.problem_id, sum(w) AS was, sum(w * t) AS remaining, sum((1 - w) * t) AS new_ FROM vp p JOIN ({_kinds}) c USING (category) JOIN tagged g ON g.uri = p.uri AND g.signal_type = c.signal_type WHERE p.problem_id NOT IN (SELECT problem_id FROM vid WHERE was > 0) GROUP BY 1",
    "vout": """SELECT problem_id, was, remaining, new_ AS "new", CASE WHEN was = 0 THEN 'misdiagnosed' WHEN remaining = 0 AND new_ = 0 THEN 'resolved' WHEN remaining < was THEN 'partially_resolved' WHEN new_ > 0 THEN 'regressed' ELSE 'unchanged' END AS outcome
  FROM (SELECT p.problem_id, CASE WHEN coalesce(i.was, 0) = 0 AND coalesce(k.was, 0) > 0 THEN k.was ELSE coalesce(i.was, 0) END::BIGINT AS was, CASE WHEN coalesce(i.was, 0) = 0 AND coalesce(k.was, 0) > 0 THEN k.remaining ELSE coalesce(i.remaining, 0) END::BIGINT AS remaining,
  CASE WHEN coalesce(i.was, 0) = 0 AND coalesce(k.was, 0) > 0 THEN k.new_ ELSE coalesce(i.new_, 0) END::BIGINT AS new_ FROM vp p LEFT JOIN vid i USING (problem_id) LEFT JOIN vkind k USING (problem_id))""",
}


@query("SELECT * FROM vout")
def verified_problems(spark, sf_dir):
    """One problem a document: known by its findings' ids, or, where those are lost, by the kinds of its category."""
    before, after = run_pair(spark, sf_dir)
    d = F.col("doc_id")
    category = F.when(d % 10 == 1, "terminology_inconsistency").when(d % 10 == 2, "poor_structure").otherwise("missing_metadata")
    problem = F.concat(F.lit("p"), d.cast("string")).alias("problem_id")
    given = kb_docs(spark, sf_dir).select("uri", "doc_id", problem, category.alias("category"))
    of = lambda run: run.where("doc_id % 4 <> 0 and (doc_id % 10 > 1 or signal_type in ('terminology_variant', 'generic', 'placeholder'))").select(problem, "signal_id")
    ids = of(before).unionByName(of(after))
    kinds = M.kinds_of(spark.createDataFrame([(c,) for c in M.CATEGORY_KINDS], "category string"))
    return P.verify_problems(given.select("problem_id", "category"), ids, given.select("problem_id", "uri"), kinds, before, after)


@query("SELECT folder, CASE WHEN bool_and(outcome = 'resolved') THEN 'resolved' WHEN bool_or(outcome = 'regressed') THEN 'regressed' WHEN bool_or(outcome = 'misdiagnosed') AND NOT bool_or(outcome IN ('resolved', 'partially_resolved')) AND max(step) <= 0 THEN 'misdiagnosed' "
       "WHEN bool_or(outcome IN ('resolved', 'partially_resolved')) OR max(step) > 0 THEN 'partially_resolved' ELSE 'unchanged' END AS outcome FROM (SELECT outcome, substring(problem_id, 2)::BIGINT % 100 AS folder, CASE WHEN substring(problem_id, 2)::BIGINT % 3 = 0 THEN -1 ELSE 0 END AS step FROM vout) GROUP BY folder")
def overall_outcomes(spark, sf_dir):
    """The outcome of each hundredth of the problems."""
    number = F.expr("cast(substring(problem_id, 2) as bigint)")
    return P.overall_outcome(verified_problems(spark, sf_dir).withColumn("folder", number % 100), ["folder"], F.when(number % 3 == 0, -1).otherwise(0))


@query(f"SELECT problem_id, category, salience FROM ({_QUEUE}) WHERE status = 'open' AND salience >= 0.5 ORDER BY salience DESC, problem_id LIMIT 25")
def top_problems(spark, sf_dir):
    """The report's 25 most salient open problems."""
    return P.pick(_queue(spark, sf_dir), 25, "open", least=0.5).select("problem_id", "category", "salience")


@query(r"""SELECT uri, i::BIGINT - 1 AS pos, ts[i] AS text, gs[i] AS target FROM (SELECT uri, regexp_extract_all(t, '\[([^\]]+)\]\(([^)]+)\)', 1) AS ts, regexp_extract_all(t, '\[([^\]]+)\]\(([^)]+)\)', 2) AS gs FROM (SELECT uri, regexp_replace(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g') AS t FROM kb)), unnest(range(1, len(ts) + 1)) AS r(i)""")
def plain_links(spark, sf_dir):
    return _big(V.plain_links(kb_docs(spark, sf_dir)), "pos")


_PLAIN_HEADS = r"SELECT uri, i::BIGINT - 1 AS pos, length(regexp_extract(h[i], '^(#+)', 1)) AS level, regexp_replace(regexp_replace(h[i], '^#+', ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM (SELECT uri, regexp_extract_all(text, '(?m)^(#{1,6})[ \t]+([^\n]+)$', 0) AS h FROM kb), unnest(range(1, len(h) + 1)) AS r(i)"


@query(_PLAIN_HEADS)
def plain_headings(spark, sf_dir):
    return _big(V.plain_headings(kb_docs(spark, sf_dir)), "pos", "level")


@query(f"SELECT uri, pos, unnest(CASE WHEN level > p + 1 AND n > 1 THEN ['jump', 'duplicate'] WHEN level > p + 1 THEN ['jump'] WHEN n > 1 THEN ['duplicate'] ELSE [] END) AS issue FROM (SELECT *, lag(level) OVER (PARTITION BY uri ORDER BY pos) AS p, row_number() OVER (PARTITION BY uri, text ORDER BY pos) AS n FROM ({_PLAIN_HEADS}))")
def heading_hierarchy(spark, sf_dir):
    """Level jumps and repeated headings; documents with one more heading below their last show both."""
    more = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("\n#### Deep\n#### Deep\n")).otherwise(""))
    return _big(V.hierarchy(V.plain_headings(kb_docs(spark, sf_dir).withColumn("text", more))), "pos")


ORACLES["heading_hierarchy"] = sql(
    f"SELECT uri, pos, unnest(CASE WHEN level > p + 1 AND n > 1 THEN ['jump', 'duplicate'] WHEN level > p + 1 THEN ['jump'] WHEN n > 1 THEN ['duplicate'] ELSE [] END) AS issue FROM (SELECT *, lag(level) OVER (PARTITION BY uri ORDER BY pos) AS p, row_number() OVER (PARTITION BY uri, text ORDER BY pos) AS n FROM ({_PLAIN_HEADS}))",
    {"kb": f"SELECT doc_id, lang, source, uri, text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '#### Deep' || chr(10) || '#### Deep' || chr(10) ELSE '' END AS text FROM ({oracle.PARTS['kb']})"},
)


@query("SELECT uri, m AS key FROM (SELECT DISTINCT uri, regexp_extract(l, '^(\\w+):', 1) AS m FROM (SELECT uri, unnest(string_split(fm, chr(10))) AS l FROM art)) WHERE m <> ''")
def plain_metadata(spark, sf_dir):
    return V.plain_metadata(kb_docs(spark, sf_dir))


@query("SELECT uri, sha256(CASE WHEN doc_id % 10 = 3 THEN text ELSE text || 'x' END) AS kept FROM kb")
def rolled_back(spark, sf_dir):
    """Edited documents, of which those whose score fell get their text back."""
    docs = kb_docs(spark, sf_dir)
    scored = docs.select("uri", F.lit(50).alias("score_before"), F.when(F.col("doc_id") % 10 == 3, 40).otherwise(50).alias("score_after"))
    return V.roll_back(docs, docs.withColumn("text", F.concat("text", F.lit("x"))), scored).select("uri", F.sha2("text", 256).alias("kept"))


@query("SELECT measure, a AS before, b AS after, CASE WHEN a > b THEN 'improved' WHEN a < b THEN 'degraded' ELSE 'neutral' END AS effect FROM (SELECT 'broken_links' AS measure, (SELECT count(*) FROM res WHERE resolved IS NULL) AS a, (SELECT count(*) FROM res WHERE resolved IS NULL AND clean NOT LIKE 'missing%') AS b UNION ALL SELECT 'heading_issues', 0, 0)")
def link_validation(spark, sf_dir):
    """The corpus before and after links to missing documents became text: the two measures that this touches."""
    docs = kb_docs(spark, sf_dir).select("uri", "text")
    mended = docs.withColumn("text", F.regexp_replace("text", r"\[gone\]\(missing_\d+\.md\)", "gone"))
    return V.validate(docs, mended).where("measure in ('broken_links', 'heading_issues')")


@query("SELECT kb.uri, sha256(CASE WHEN kb.uri = (SELECT min(uri) FROM art) THEN rtrim(text, ' ' || chr(10)) ELSE text END) AS fixed FROM kb WHERE kb.uri <> (SELECT min(uri) FROM art)")
def hub_links(spark, sf_dir):
    """Documents after the first one became a hub for those that nothing links to (its own text is checked in the tests)."""
    docs = kb_docs(spark, sf_dir).select("uri", "text")
    k = kb(spark, sf_dir)
    hub = k.artifacts.agg(F.min("uri")).first()[0]
    found = V.link_from_hub(docs, C.orphan_documents(k), hub, k.artifacts.select("uri", "title"), C.STOPWORDS)
    return found.where(F.col("uri") != hub).select("uri", F.sha2("text", 256).alias("fixed"))


@query(r"SELECT uri FROM kb UNION SELECT regexp_replace(regexp_extract(uri, '^(.+/)', 1) || clean, '[^/]+/\.\./', '') FROM res WHERE resolved IS NULL")
def created_documents(spark, sf_dir):
    """A document for every link that leads nowhere, where there is none yet."""
    k = kb(spark, sf_dir)
    wanted = k.resolved.where("resolved is null").select(parse.T.normal_path(F.concat(parse.T.directory(F.col("uri")), "clean")).alias("uri"), F.lit("# To be written").alias("text"))
    return V.create_missing(kb_docs(spark, sf_dir), wanted).select("uri")


def _stream(spark, sf_dir):
    return R.stream_table(spark, sf_dir, table(prepare(spark), sf_dir, "events"), "events.parquet")


@query("SELECT event_type, count(*) FILTER (value >= 10) AS good, count(*) FILTER (value < 10) AS parked FROM events GROUP BY event_type")
def stream_parked_events(spark, sf_dir):
    """What a stream keeps and what it parks, both read back."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def handle(batch, number):
        good, bad = R.split_bad(batch, F.col("value") >= 10)
        good.write.mode("overwrite").parquet(f"{folder}/good/batch={number}")
        bad.write.mode("overwrite").parquet(f"{folder}/parked/batch={number}")

    R.run_once(_stream(spark, sf_dir), handle, f"{folder}/checkpoint")
    n = lambda name: spark.read.parquet(f"{folder}/{name}").groupBy("event_type").agg(F.count("*").alias("good" if name == "good" else "parked"))
    return n("good").join(n("parked"), "event_type", "full_outer").fillna(0)


@query("SELECT ts::DATE::TIMESTAMP AS day, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1 HAVING ts::DATE::TIMESTAMP + INTERVAL '1' DAY <= (SELECT max(ts) FROM events) - INTERVAL '1' DAY".replace("HAVING ts::DATE::TIMESTAMP + INTERVAL '1' DAY", "HAVING day + INTERVAL '1' DAY"))
def stream_daily_health(spark, sf_dir):
    """Daily means of a stream under a watermark of a day: a day is out once the watermark has passed it."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    R.append_once(R.daily_health(_stream(spark, sf_dir)), f"{folder}/days", f"{folder}/checkpoint")
    return _plain_times(spark.read.parquet(f"{folder}/days"))


@query("""SELECT signal_id, first_seen::BIGINT AS first_seen, last_seen::BIGINT AS last_seen, runs, CASE WHEN last_seen < (SELECT max(run) FROM seen) THEN 'resolved' WHEN gap THEN 'recurring' WHEN first_seen = (SELECT max(run) FROM seen) THEN 'new' ELSE 'persistent' END AS status
  FROM (SELECT signal_id, min(run) AS first_seen, max(run) AS last_seen, count(*) AS runs, coalesce(bool_or(run - p > 1), false) AS gap FROM (SELECT *, lag(run) OVER (PARTITION BY signal_id ORDER BY run) AS p FROM seen) GROUP BY signal_id)""")
def stream_lifecycle(spark, sf_dir):
    """The lifecycle kept as state over runs that arrive in parts, out of order and partly twice, in small files."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    every = written(seen(spark, sf_dir), "seen")
    late = F.pmod(F.xxhash64("run", "signal_id"), F.lit(4))
    placed = every.withColumn("file", F.floor((F.col("run") + late) / 12)).unionByName(every.where(late == 1).withColumn("file", F.floor((F.col("run") + 2) / 12)))
    last = every.agg(F.max("run")).first()[0]
    for n in range((last + 3) // 12 + 1):
        placed.where(F.col("file") == n).drop("file").repartition(1).write.mode("append").parquet(f"{folder}/arrivals")
    spark.createDataFrame([(last + 6, None)], every.schema).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")  # closes the last runs
    arriving = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    R.keep_lifecycle(arriving, f"{folder}/state", f"{folder}/checkpoint", lateness=5)
    return _big(R.lifecycle_state(spark, f"{folder}/state"), "first_seen", "last_seen", "runs")


#: Bytes of files that one batch takes.
BATCH = 512 << 20
_SINGLE = [name for name, (_, scope, _) in C.REGISTRY.items() if scope == "per_artifact"]


@query(f"SELECT uri, collector_id, signal_type, count(*) AS signals FROM interp WHERE collector_id IN ({', '.join(f"'{c}'" for c in _SINGLE)}) GROUP BY ALL")
def stream_assessed(spark, sf_dir):
    """Documents that arrive as files, some of them twice, read under two checkpoints: the checks of single documents, each document once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = kb_docs(spark, sf_dir).select("uri", "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    docs.write.parquet(f"{folder}/arrivals")
    docs.where(F.col("uri").like("%7.md")).withColumn("at", F.col("at") + F.expr("INTERVAL 1 HOUR")).write.mode("append").parquet(f"{folder}/arrivals")
    handler = R.assess_once(f"{folder}/store", "uri", lambda rows: C.signals(C.KnowledgeBase(parse.artifacts(rows), None, None), _SINGLE))  # these need no links, and parse what they need of a batch
    for checkpoint in ("one", "two"):
        R.run_once(R.once_by_key(R.stream_table(spark, f"{folder}/arrivals", docs, most=BATCH), "uri", "at", "1 day"), handler, f"{folder}/{checkpoint}")
    return store.load(spark, f"{folder}/store", "assessed").groupBy("uri", "collector_id", "signal_type").agg(F.count("*").alias("signals"))
