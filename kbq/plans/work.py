"""Queries over problems, fixes, embeddings and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import problems as P
from kbq.operators import scoring as S
from kbq.operators import vector as V
from kbq.plans import oracle, scores  # noqa: F401  the SQL parts of scores are used below
from kbq.plans.checks import kb
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import _list, sql
from kbq.plans.scores import by_document, day_runs, interpreted
from kbq.session import prepare, shared_folder, table
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


@query("SELECT collector_id, signal_type, uri, count(*) AS n, round(least(0.3 + 0.1 * count(*), 0.8)::DOUBLE, 6) AS confidence FROM interp GROUP BY ALL")
def problem_clusters(spark, sf_dir):
    return P.clusters(interpreted(spark, sf_dir))


@query("SELECT signal_type, count(*) AS signals, count(DISTINCT uri) AS documents FROM interp GROUP BY signal_type HAVING count(DISTINCT uri) >= 2")
def systemic_problems(spark, sf_dir):
    return P.systemic(interpreted(spark, sf_dir))


@query("SELECT uri, count(*) AS n FROM interp WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY uri HAVING count(*) >= 2")
def urgent_problems(spark, sf_dir):
    return P.urgent(interpreted(spark, sf_dir))


_SALIENCE = """SELECT collector_id, signal_type, uri, n, round((0.40::DOUBLE * encoding + 0.25::DOUBLE * 0.5::DOUBLE + 0.35::DOUBLE * coalesce(1 - score / 100.0::DOUBLE, 0.5)) * (1 / (1 + log2(n)))
  * coalesce(greatest(power(0.5::DOUBLE, age / 21.0::DOUBLE) + 0.1::DOUBLE * power(0.5::DOUBLE, age / 180.0::DOUBLE), 0.01::DOUBLE), 1.0::DOUBLE), 6) AS salience FROM
  (SELECT collector_id, signal_type, uri, count(*) AS n, avg(CASE severity WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.7::DOUBLE WHEN 'MEDIUM' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) AS encoding FROM interp GROUP BY ALL) p
  LEFT JOIN (SELECT uri, collector_id, score FROM ucol) d USING (uri, collector_id) LEFT JOIN (SELECT uri, doc_id % 50 AS age FROM kb WHERE doc_id % 3 <> 0) USING (uri)"""


def last_seen(spark, sf_dir):
    """Days since the findings of a document were last seen; a third of the documents is not followed."""
    return kb_docs(spark, sf_dir).where("doc_id % 3 <> 0").select("uri", (F.col("doc_id") % 50).alias("age_days"))


@query(_SALIENCE)
def salience(spark, sf_dir):
    found = interpreted(spark, sf_dir)
    return P.salience(P.clusters(found), found, by_document(spark, sf_dir), ages=last_seen(spark, sf_dir))


@query(f"SELECT * FROM ({_SALIENCE}) WHERE salience >= 0.3 AND NOT (collector_id = 'freshness' AND uri LIKE '%7.md')")
def problem_queue(spark, sf_dir):
    """Problems above the threshold, less those that were marked as not to be fixed."""
    wont = kb_docs(spark, sf_dir).where("uri LIKE '%7.md'").select(F.lit("freshness").alias("collector_id"), "uri")
    return P.queue(salience(spark, sf_dir), 0.3, wont)


_PROBLEMS = """SELECT collector_id || ':' || signal_type || ':' || uri AS problem_id, CASE WHEN doc_id % 4 = 0 THEN 'doc_' || doc_id || '.md' ELSE uri END AS uri, CASE WHEN doc_id % 8 = 0 THEN signal_type || doc_id ELSE signal_type END AS signal_type,
  CASE WHEN doc_id % 24 = 0 THEN collector_id || doc_id ELSE collector_id END AS category, CASE WHEN doc_id % 16 = 0 THEN ['heading ' || (doc_id % 7), 'doc ' || doc_id] ELSE [] END AS evidence FROM (SELECT DISTINCT collector_id, signal_type, uri FROM interp) JOIN kb USING (uri)"""
oracle.PARTS |= {
    "prob": _PROBLEMS,
    "prob1": r"SELECT *, CASE WHEN folder <> '' AND count(*) OVER (PARTITION BY folder) >= 2 THEN 'directory' END AS p1 FROM (SELECT *, regexp_extract(uri, '^(.+/)', 1) AS folder FROM prob)",
    "prob2": "SELECT x.*, CASE WHEN p1 IS NULL AND d >= 2 THEN 'systemic_type' END AS p2 FROM prob1 x LEFT JOIN (SELECT signal_type, count(DISTINCT uri) AS d FROM prob1 WHERE p1 IS NULL GROUP BY signal_type) USING (signal_type)",
    "prob3": "SELECT x.*, ref FROM prob2 x LEFT JOIN (SELECT problem_id, min(ref) AS ref FROM (SELECT *, count(*) OVER (PARTITION BY ref) AS n FROM (SELECT problem_id, unnest(evidence) AS ref FROM prob2 WHERE p1 IS NULL AND p2 IS NULL)) WHERE n >= 2 GROUP BY problem_id) USING (problem_id)",
    "prob4": """SELECT x.problem_id, x.uri, coalesce(p1, p2, CASE WHEN ref IS NOT NULL THEN 'shared_evidence' WHEN c >= 2 THEN 'category' ELSE 'singleton' END) AS pattern, CASE WHEN p1 IS NOT NULL THEN folder WHEN p2 IS NOT NULL THEN signal_type WHEN ref IS NOT NULL THEN ref WHEN c >= 2 THEN x.category ELSE x.problem_id END AS cluster
  FROM prob3 x LEFT JOIN (SELECT category, count(*) AS c FROM prob3 WHERE p1 IS NULL AND p2 IS NULL AND ref IS NULL GROUP BY category) USING (category)""",
}


def problem_rows(spark, sf_dir):
    """Problems of which some lie outside of folders, are of kinds or categories of their own, or name evidence."""
    found = interpreted(spark, sf_dir).select("collector_id", "signal_type", "uri", "doc_id").distinct()
    d = F.col("doc_id")
    evidence = F.when(d % 16 == 0, F.array(F.concat(F.lit("heading "), (d % 7).cast("string")), F.concat(F.lit("doc "), d.cast("string")))).otherwise(F.array().cast("array<string>"))
    return found.select(
        F.concat_ws(":", "collector_id", "signal_type", "uri").alias("problem_id"), F.when(d % 4 == 0, F.concat(F.lit("doc_"), d.cast("string"), F.lit(".md"))).otherwise(F.col("uri")).alias("uri"),
        F.when(d % 8 == 0, F.concat("signal_type", d.cast("string"))).otherwise(F.col("signal_type")).alias("signal_type"), F.when(d % 24 == 0, F.concat("collector_id", d.cast("string"))).otherwise(F.col("collector_id")).alias("category"), evidence.alias("evidence"),
    )


@query("SELECT * FROM prob4")
def root_cause_clusters(spark, sf_dir):
    return P.root_causes(problem_rows(spark, sf_dir))


@query(f"""SELECT pattern, cluster, count(*) AS problems, count(DISTINCT q.uri) AS documents, max(salience) AS salience, CASE pattern WHEN 'singleton' THEN 'fix_document' WHEN 'directory' THEN 'fix_folder' ELSE 'fix_systemic' END AS strategy
  FROM prob4 q JOIN ({_SALIENCE}) s ON q.problem_id = s.collector_id || ':' || s.signal_type || ':' || s.uri GROUP BY ALL""")
def root_cause_proposals(spark, sf_dir):
    ranked = salience(spark, sf_dir).select(F.concat_ws(":", "collector_id", "signal_type", "uri").alias("problem_id"), "salience")
    return P.synthesis(P.root_causes(problem_rows(spark, sf_dir)), ranked)


@query(f"""SELECT * FROM (WITH j AS (SELECT pattern, cluster, q.uri, salience FROM prob4 q JOIN ({_SALIENCE}) s ON q.problem_id = s.collector_id || ':' || s.signal_type || ':' || s.uri),
  per AS (SELECT pattern, cluster, max(salience) AS salience FROM j GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY salience DESC, pattern, cluster) = 1 AS proposed FROM per)
  SELECT DISTINCT cluster, pattern, 'systemic_' || pattern || CASE pattern WHEN 'category' THEN '_v2' ELSE '' END AS strategy, r.salience, proposed, uri, 'update_document' AS step_type, 'Address ' || pattern || ' pattern: ' || cluster[1:100] AS description FROM j JOIN r USING (pattern, cluster))""")
def root_cause_steps(spark, sf_dir):
    ranked = salience(spark, sf_dir).select(F.concat_ws(":", "collector_id", "signal_type", "uri").alias("problem_id"), "salience")
    return P.systemic_steps(P.root_causes(problem_rows(spark, sf_dir)), ranked, ["systemic_category"])


_HYPOTHESES = """SELECT uri AS run_id, row_number() OVER (PARTITION BY uri ORDER BY collector_id, signal_type) - 1 AS idx, CASE WHEN collector_id = 'freshness' THEN NULL ELSE collector_id END AS category, signal_type || ' in ' || uri AS hypothesis, [signal_type, n || ' findings'] AS evidence, [uri, uri || '#' || signal_type] AS uris
  FROM (SELECT uri, collector_id, signal_type, count(*) AS n FROM interp GROUP BY ALL)"""


def hypotheses(spark, sf_dir):
    """A hypothesis for each kind of finding of a document, by document; those on freshness have no category."""
    kinds = interpreted(spark, sf_dir).groupBy("uri", "collector_id", "signal_type").agg(F.count("*").alias("n"))
    idx = F.row_number().over(Window.partitionBy("uri").orderBy("collector_id", "signal_type")).cast("long") - 1  # at most one row a kind
    return kinds.select(
        F.col("uri").alias("run_id"), idx.alias("idx"), F.when(F.col("collector_id") != "freshness", F.col("collector_id")).alias("category"), F.concat("signal_type", F.lit(" in "), "uri").alias("hypothesis"),
        F.array("signal_type", F.concat(F.col("n").cast("string"), F.lit(" findings"))).alias("evidence"), F.array("uri", F.concat("uri", F.lit("#"), "signal_type")).alias("uris"),
    )


@query(f"SELECT run_id, CASE WHEN category IS NULL OR (category = 'canonical_source' AND run_id LIKE '%1.md') THEN 'manual_review' ELSE 'address_' || category END AS strategy, causes FROM (SELECT run_id, category, idx, count(*) OVER (PARTITION BY run_id) AS causes FROM ({_HYPOTHESES})) WHERE idx = 0")
def basic_proposals(spark, sf_dir):
    """Proposals without more knowledge: documents whose name ends in 1 have tried to address their canonical source."""
    tried = kb_docs(spark, sf_dir).where("uri LIKE '%1.md'").select(F.col("uri").alias("run_id"), F.lit("canonical_source").alias("strategy"))
    return P.basic_proposals(hypotheses(spark, sf_dir), tried)


@query(f"SELECT run_id, 'kp_' || coalesce(category, 'unknown') || '_' || idx AS problem_id, coalesce(category, 'unknown') AS category, hypothesis AS description, array_to_string(evidence, '; ') AS evidence_summary, unnest(uris) AS uri FROM ({_HYPOTHESES})")
def hypothesis_problems(spark, sf_dir):
    return P.hypothesis_problems(hypotheses(spark, sf_dir))


_has = lambda a, b: f"EXISTS (SELECT uri FROM interp WHERE {a} INTERSECT SELECT uri FROM interp WHERE {b})"
_n = lambda c: f"(SELECT count(*) FROM interp WHERE {c})"


@query(f"""SELECT 'navigation_collapse' AS rule, {_n("signal_type = 'broken_link'")} >= 2 AND {_n("signal_type = 'orphan'")} >= 1 AND (SELECT connectivity FROM ({scores._corpus})) < 50 AS fires UNION ALL SELECT 'stale_kb_collapse', {_n("signal_type = 'stale_content'")} >= 2 AND {_n("signal_type = 'orphan'")} >= 2
  UNION ALL SELECT 'retrieval_breakdown', {_has("collector_id = 'heading_quality'", "signal_type = 'mixed_topics'")} UNION ALL SELECT 'context_fragmentation', {_has("signal_type = 'dangling_reference'", "signal_type = 'orphan_artifact'")}
  UNION ALL SELECT 'terminology_contradiction', {_n("signal_type = 'terminology_variant'")} >= 2 AND {_n("collector_id = 'contradiction_detection'")} >= 1""")
def cross_checks(spark, sf_dir):
    return P.cross_checks(interpreted(spark, sf_dir), S.corpus(interpreted(spark, sf_dir)))


@query("SELECT uri, signal_type, mark AS discriminator, p::INT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY p, mark) AS r FROM (SELECT *, CASE signal_type WHEN 'no_date_signal' THEN 0 WHEN 'orphan_artifact' THEN 1 WHEN 'missing_canonical_source' THEN 2 END AS p FROM interp) WHERE p IS NOT NULL) WHERE r = 1")
def remediation_steps(spark, sf_dir):
    return P.steps(interpreted(spark, sf_dir))


_step = {"broken_link": "fix_broken_links", "orphan_artifact": "link_orphaned_document", "no_date_signal": "add_metadata", "stale_content": "add_metadata", "dangling_reference": "fix_dangling_references", "placeholder": "rewrite_section", "mixed_topics": "split_document"}
_step_weight = "CASE signal_type " + " ".join(f"WHEN '{k}' THEN {P.STEP_WEIGHTS.get(t, P.DEFAULT_STEP_WEIGHT)}::DOUBLE" for k, t in _step.items()) + " ELSE 0.05::DOUBLE END"


@query(f"SELECT uri, round(least(1.0, sum({_step_weight}))::DOUBLE, 6) AS delta, round(least(1.0, sum({_step_weight}))::DOUBLE, 6) <= 0.2 AS accepted FROM interp GROUP BY uri")
def edit_budget(spark, sf_dir):
    """One step a finding."""
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in _step.items() for x in pair]), F.col("signal_type")), F.lit("rename"))
    return P.within_budget(interpreted(spark, sf_dir).select("uri", named.alias("step_type")))


@query("SELECT uri, round(levenshtein(title, upper(title)) / greatest(length(title), 1)::DOUBLE, 6) AS delta FROM title")
def title_changes(spark, sf_dir):
    """How much of a title changes if it is set in capitals."""
    return P.changed_share(kb(spark, sf_dir).artifacts.select("uri", F.col("title").alias("before"), F.upper("title").alias("after")))


@query(r"""SELECT uri, sha256(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, 'date: [^\n]*', 'date: 2024-06-01') ELSE '---' || chr(10) || 'title: ' || uri || chr(10) || 'date: 2024-06-01' || chr(10) || '---' || chr(10) || text END) AS fixed FROM kb""")
def fixed_metadata(spark, sf_dir):
    docs = kb_docs(spark, sf_dir).select("uri", "text")
    return P.set_metadata(docs, "date", F.lit("2024-06-01"), F.col("uri")).select("uri", F.sha2("text", 256).alias("fixed"))


_phrases = "text"
for _a, _b in P.DANGLING_FIXES:  # RE2 has no lookahead: the character after the phrase is matched and put back
    _a, _b = (_a.removesuffix("(?!\\[)") + "([^\\[]|$)", _b + "\\1") if _a.endswith("(?!\\[)") else (_a, _b)
    _phrases = f"regexp_replace({_phrases}, '(?i){oracle._q(_a)}', '{oracle._q(_b)}', 'g')"


@query(f"SELECT uri, sha256({_phrases}) AS fixed FROM kb")
def fixed_references(spark, sf_dir):
    return P.fix_references(kb_docs(spark, sf_dir)).select("uri", F.sha2("text", 256).alias("fixed"))


@query(r"""SELECT uri, sha256(CASE WHEN links IS NULL THEN text ELSE regexp_replace(text, '\A((?s:.*?))(?m:^(# [^\n]*)$)', '\1\2' || chr(10) || chr(10) || links) END) AS fixed FROM kb LEFT JOIN (SELECT uri, string_agg('[' || domain || '](https://' || domain || ')', ' ' ORDER BY domain) AS links FROM (SELECT DISTINCT uri, domain FROM c_canon) GROUP BY uri) USING (uri)""")
def fixed_canonical(spark, sf_dir):
    wanted = C.missing_canonical(kb(spark, sf_dir)).select("uri", "domain")
    return P.add_canonical(kb_docs(spark, sf_dir).select("uri", "text"), wanted).select("uri", F.sha2("text", 256).alias("fixed"))


@query("SELECT kb.uri, sha256(CASE WHEN g.uri IS NULL THEN text ELSE g.fixed END) AS fixed FROM kb LEFT JOIN (SELECT uri, replace(replace(replace(max(t), max(a), max(x)), max(b), max(y)), max(c), max(z)) AS fixed FROM (SELECT k.uri, k.text AS t, CASE i WHEN 1 THEN src ELSE '' END AS a, CASE i WHEN 1 THEN dst ELSE '' END AS x, CASE i WHEN 2 THEN src ELSE '' END AS b, CASE i WHEN 2 THEN dst ELSE '' END AS y, CASE i WHEN 3 THEN src ELSE '' END AS c, CASE i WHEN 3 THEN dst ELSE '' END AS z FROM kb k JOIN (SELECT uri, '[' || text || '](' || target || ')' AS src, text AS dst, row_number() OVER (PARTITION BY uri ORDER BY pos) AS i FROM res WHERE resolved IS NULL) q ON k.uri = q.uri) GROUP BY uri) g ON kb.uri = g.uri")
def fixed_links(spark, sf_dir):
    k = kb(spark, sf_dir)
    broken = k.resolved.where("resolved is null").select("uri", "text", "target")
    return P.unlink(kb_docs(spark, sf_dir).select("uri", "text"), broken).select("uri", F.sha2("text", 256).alias("fixed"))


@query("""SELECT problem_id, sum(was)::BIGINT AS was, sum(still)::BIGINT AS still, CASE WHEN sum(still) = 0 THEN 'resolved' WHEN sum(still) < sum(was) THEN 'partially_resolved' WHEN sum(still) = sum(was) THEN 'unchanged' ELSE 'regressed' END AS outcome FROM
  (SELECT user_id::VARCHAR AS problem_id, user_id::VARCHAR || ':' || event_type AS signal_id, max((run <= 15)::INT) AS was, max((run > 15)::INT) AS still FROM day GROUP BY ALL) GROUP BY problem_id""")
def problem_verification(spark, sf_dir):
    rows = day_runs(spark, sf_dir).select("run", F.col("user_id").cast("string").alias("problem_id"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("signal_id"))
    return P.verify(rows.select("problem_id", "signal_id").distinct(), rows.where("run <= 15"), rows.where("run > 15"))


_stop = _list(V.STOPWORDS)
_FEATURES = rf"""(SELECT uri, term, count(*) AS tf FROM (SELECT uri, unnest(ws) AS term FROM (SELECT doc_id AS uri, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_stop})) AS ws FROM documents)
  UNION ALL SELECT uri, unnest(list_transform(range(1, length(w) - 1), lambda i: 'c3:' || substring(w, i::BIGINT, 3))) FROM (SELECT uri, unnest(ws) AS w FROM (SELECT doc_id AS uri, list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({_stop})) AS ws FROM documents)) WHERE length(w) >= 3) GROUP BY ALL)"""


@query(f"SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM {_FEATURES} GROUP BY term")
def idf(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").alias("uri"), "text")
    return V.idf(V.document_frequencies(docs), docs).withColumn("idf", F.round("idf", 6))


@query(f"""SELECT uri, dim, round(value / sqrt(sum(value * value) OVER (PARTITION BY uri)), 6) AS value FROM (SELECT uri, dim, sum(CASE WHEN dim % 2 = 0 THEN w ELSE -w END) AS value FROM (SELECT uri, (1 + ln(tf)) * idf AS w, (('0x' || substring(md5(k || ':' || term), 1, 8))::BIGINT % 384)::INT AS dim
  FROM {_FEATURES} JOIN (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM {_FEATURES} GROUP BY term) USING (term), range(0, 3) AS r(k)) GROUP BY uri, dim)""")
def tfidf_hashed_long(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents").select(F.col("doc_id").alias("uri"), "text")
    return V.embedded(docs).withColumn("value", F.round("value", 6))


@query("""SELECT query_id, vec_id, similarity, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: q.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(r.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND r.embedding IS NOT NULL)) WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    """The five nearest rows of every vector whose id is divisible by 20."""
    rows = table(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding")
    return V.nearest(rows.where("vec_id % 20 = 0"), rows).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT ts::DATE::TIMESTAMP AS day, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def daily_means(spark, sf_dir):
    """The batch twin of the streamed daily means."""
    return table(prepare(spark), sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE value >= 10 GROUP BY event_type")
def stream_good_events(spark, sf_dir):
    """Events streamed in batches; bad rows (value under 10) are parked, good ones kept, each batch once."""
    source = table(prepare(spark), sf_dir, "events")
    folder = _folder(spark)

    def handle(batch, number):
        good, bad = R.split_bad(batch, F.col("value") >= 10)
        good.write.mode("overwrite").parquet(f"{folder}/good/batch={number}")
        bad.write.mode("overwrite").parquet(f"{folder}/parked/batch={number}")

    R.run_once(R.stream_table(spark, sf_dir, source, "events.parquet"), handle, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/good").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
