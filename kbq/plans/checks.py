"""Queries over structure, graph and the ten checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.operators import collectors as C
from kbq.operators import graph, parse
from kbq.plans.fixture import kb_docs
from kbq.plans.oracle import sql
from kbq.session import once_per_input, prepare, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def parsed(spark, sf_dir):
    return kb(spark, sf_dir).artifacts


@once_per_input
def kb(spark, sf_dir):
    """The knowledge base of one input folder; queries of a session share it."""
    return C.KnowledgeBase.of(kb_docs(spark, sf_dir))


def _big(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


@query("SELECT uri, key, value FROM meta")
def frontmatter_map(spark, sf_dir):
    return parse.metadata(parsed(spark, sf_dir))


@query("SELECT uri, pos::BIGINT AS pos, level::BIGINT AS level, text, line::BIGINT AS line FROM head")
def headings(spark, sf_dir):
    return _big(parse.headings(parsed(spark, sf_dir)), "pos", "level", "line")


@query("SELECT uri, pos::BIGINT AS pos, heading, level::BIGINT AS level, sha256(text) AS text_sha256, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM sec")
def sections(spark, sf_dir):
    found = parse.sections(parsed(spark, sf_dir)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    return _big(found, "pos", "level", "line_start", "line_end")


@query("SELECT uri, pos::BIGINT AS pos, sha256(text) AS text_sha256, section_heading, line::BIGINT AS line FROM para")
def paragraphs(spark, sf_dir):
    return _big(parse.paragraphs(parsed(spark, sf_dir)).withColumn("text_sha256", F.sha2("text", 256)).drop("text"), "pos", "line")


@query("SELECT uri, pos::BIGINT AS pos, text, target, line::BIGINT AS line, is_internal FROM link")
def links(spark, sf_dir):
    return _big(parse.links(parsed(spark, sf_dir)), "pos", "line")


@query("SELECT uri, pos::BIGINT AS pos, language, text, line::BIGINT AS line FROM code")
def code_blocks(spark, sf_dir):
    return _big(parse.code_blocks(parsed(spark, sf_dir)), "pos", "line")


@query("SELECT uri, title, substring(sha256(uri), 1, 16) AS artifact_id FROM title")
def titles(spark, sf_dir):
    return parsed(spark, sf_dir).select("uri", "title", "artifact_id")


@query(r"SELECT uri, len(list_filter(string_split_regex(all_text, '\s+'), lambda x: x <> ''))::BIGINT AS word_count, length(all_text)::BIGINT AS n_chars FROM txt")
def word_counts(spark, sf_dir):
    return parsed(spark, sf_dir).select("uri", "word_count", F.length("all_text").cast("long").alias("n_chars"))


@query("SELECT t.uri, sha256(concat_ws(chr(10) || chr(10), '# ' || t.title, h.x, p.x)) AS flat_sha256 FROM title t LEFT JOIN (SELECT uri, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS x FROM head GROUP BY uri) h USING (uri) LEFT JOIN (SELECT uri, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS x FROM para GROUP BY uri) p USING (uri)")
def flat_texts(spark, sf_dir):
    return parse.flat_text(parsed(spark, sf_dir)).select("uri", F.sha2("flat", 256).alias("flat_sha256"))


@query("SELECT uri, string_agg(DISTINCT target, ' ' ORDER BY target) AS targets FROM link WHERE is_internal GROUP BY uri")
def link_fingerprints(spark, sf_dir):
    return parse.link_fingerprints(parsed(spark, sf_dir)).select("uri", F.array_join("targets", " ").alias("targets"))


@query(r"SELECT page_id, i::BIGINT - 1 AS pos, regexp_extract(h[i], '(?i)^<h([1-6])', 1)::BIGINT AS level, trim(regexp_replace(h[i], '(?s)<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>') AS h FROM pages), unnest(range(1, len(h) + 1)) AS t(i)")
def page_headings(spark, sf_dir):
    return _big(parse.page_headings(table(prepare(spark), sf_dir, "pages")), "pos", "level")


@query("""SELECT page_id, i::BIGINT - 1 AS pos, h[i] AS target FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS t(i)""")
def page_links(spark, sf_dir):
    return _big(parse.page_links(table(prepare(spark), sf_dir, "pages")), "pos")


@query("SELECT regexp_extract(url, '^(?:https?://)?([^/:]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1")
def page_domains(spark, sf_dir):
    return table(prepare(spark), sf_dir, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT uri, pos::BIGINT AS pos, target, line::BIGINT AS line, resolved FROM res")
def resolved_links(spark, sf_dir):
    return _big(kb(spark, sf_dir).resolved.select("uri", "pos", "target", "line", "resolved"), "pos", "line")


@query("SELECT source_uri, target_uri, relation_type FROM edge")
def cross_reference_edges(spark, sf_dir):
    return kb(spark, sf_dir).edges


@query("SELECT source_uri, target_uri FROM edge WHERE source_uri IN (SELECT uri FROM art WHERE doc_id % 10 <> 3) AND target_uri IN (SELECT uri FROM art WHERE doc_id % 10 <> 3)")
def pruned_edges(spark, sf_dir):
    """Edges left when some documents are excluded from the base."""
    kept = kb_docs(spark, sf_dir).where("NOT (doc_id % 10 <=> 3)")
    return graph.prune(kb(spark, sf_dir).edges, kept).select("source_uri", "target_uri")


@query("SELECT uri, inbound::BIGINT AS inbound FROM deg")
def in_degree(spark, sf_dir):
    k = kb(spark, sf_dir)
    return graph.in_degree(k.artifacts, k.edges, parse.links(k.artifacts))


@query("SELECT uri, cluster_count::BIGINT AS cluster_count, largest_cluster_ratio, topic_entropy FROM c_purity")
def mixed_topics(spark, sf_dir):
    return C.mixed_topics(kb(spark, sf_dir)).select("uri", "cluster_count", "largest_cluster_ratio", "topic_entropy")


@query("SELECT uri, dangling_reference_count FROM c_dangling")
def dangling_references(spark, sf_dir):
    return C.dangling_references(kb(spark, sf_dir)).select("uri", "dangling_reference_count")


@query("SELECT uri, line::BIGINT AS line, level::BIGINT AS level, heading, signal_type FROM c_heading")
def heading_quality(spark, sf_dir):
    return _big(C.heading_quality(kb(spark, sf_dir)).select("uri", "line", "level", "heading", "signal_type"), "line", "level")


@query("SELECT uri, term_group, minority_variant, majority_variant, minority_count::BIGINT AS minority_count, majority_count::BIGINT AS majority_count FROM c_term")
def terminology_variants(spark, sf_dir):
    return C.terminology_variants(kb(spark, sf_dir)).select("uri", "term_group", "minority_variant", "majority_variant", "minority_count", "majority_count")


@query("SELECT uri, subject, version, lowest FROM c_version")
def version_conflicts(spark, sf_dir):
    return C.version_conflicts(kb(spark, sf_dir)).select("uri", "subject", "version", "lowest")


@query("SELECT uri FROM c_depr")
def deprecation_vs_recommendation(spark, sf_dir):
    return C.deprecation_conflicts(kb(spark, sf_dir)).select("uri")


@query("SELECT uri, feature FROM c_bool")
def boolean_conflicts(spark, sf_dir):
    return C.default_conflicts(kb(spark, sf_dir)).select("uri", "feature")


@query("SELECT uri, keyword, domain FROM c_canon")
def missing_canonical(spark, sf_dir):
    return C.missing_canonical(kb(spark, sf_dir)).select("uri", "keyword", "domain")


@query("SELECT uri, copies::BIGINT AS copies FROM c_dup")
def duplicate_content(spark, sf_dir):
    return C.duplicate_content(kb(spark, sf_dir)).select("uri", "copies")


@query("SELECT uri, signal_type, age_days FROM c_fresh")
def freshness(spark, sf_dir):
    return C.freshness(kb(spark, sf_dir)).select("uri", "signal_type", "age_days")


@query("SELECT uri FROM deg WHERE inbound = 0")
def orphan_artifacts(spark, sf_dir):
    return C.orphan_artifacts(kb(spark, sf_dir)).select("uri")


@query("SELECT uri, targets, broken_link_count::BIGINT AS broken_link_count FROM c_broken")
def broken_links(spark, sf_dir):
    return C.broken_links(kb(spark, sf_dir)).select("uri", "targets", "broken_link_count")


@query("SELECT uri FROM c_orphan")
def orphans(spark, sf_dir):
    return C.orphan_documents(kb(spark, sf_dir)).select("uri")


@query("SELECT uri, missing FROM c_flow")
def incomplete_workflows(spark, sf_dir):
    return C.incomplete_workflows(kb(spark, sf_dir)).select("uri", "missing")


@query("SELECT uri, collector_id, signal_type, line, mark AS discriminator, signal_id, occurrence::BIGINT AS occurrence FROM signal")
def signals(spark, sf_dir):
    return _big(C.signals(kb(spark, sf_dir)), "occurrence")
