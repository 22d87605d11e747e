"""Assessment of what changed, and whether two assessments can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import graph, parse
from kbq.operators import scoring as S
from kbq.session import written


def snapshot(kb: C.KnowledgeBase) -> DataFrame:
    """(uri, content_hash, links_hash) of a knowledge base, as `history.changes` compares them."""
    targets = parse.link_fingerprints(kb.artifacts)
    return kb.artifacts.select("uri", F.sha2("body", 256).alias("content_hash"), F.sha2(F.to_json("metadata"), 256).alias("meta_hash")).join(targets, "uri").select("uri", F.concat_ws(":", "content_hash", "meta_hash").alias("content_hash"), F.sha2(F.array_join("targets", " "), 256).alias("links_hash"))


def reassess(previous: C.KnowledgeBase, signals: DataFrame, docs: DataFrame, changed: DataFrame, most: float = 0.5, **options) -> tuple[C.KnowledgeBase, DataFrame]:
    """(knowledge base, findings) of docs(uri, text), equal to those of a whole assessment.

    changed: uri, event (added, modified, deleted), links_changed. Only added and modified documents are parsed. Checks
    of single documents run on those, and their other findings are kept; checks across documents run on the kept
    parses (`maintained` keeps indexes for those as well). Navigation edges are taken over from the previous knowledge
    base. If more than `most` of the documents changed, everything is assessed anew.
    """
    counts = changed.agg(F.count("*").alias("n"), F.count_if(F.col("links_changed") | (F.col("event") != "modified")).alias("moved")).first()
    if counts["n"] > most * docs.count():
        kb = C.KnowledgeBase.of(docs, previous.navigation)
        return kb, C.signals(kb, **options)
    ids = changed.select("uri")
    fresh = written(parse.artifacts(docs.join(ids, "uri", "left_semi")), "fresh")
    parsed = written(previous.artifacts.join(ids, "uri", "left_anti").unionByName(fresh), "artifacts")
    links_of = parse.links(parsed if counts["moved"] else fresh)
    resolved = graph.resolve(links_of, parsed)
    if not counts["moved"]:
        resolved = previous.resolved.join(ids, "uri", "left_anti").unionByName(resolved)
    resolved = written(resolved, "resolved")
    edges = previous.edges
    if counts["moved"]:
        found = graph.cross_references(resolved)
        edges = written(graph.prune(found if previous.navigation is None else found.unionByName(previous.navigation), parsed), "edges")
    kb = C.KnowledgeBase(parsed, resolved, edges, previous.navigation)
    single = [name for name, (_, scope, _) in C.REGISTRY.items() if scope == "per_artifact"]
    across = [name for name in C.REGISTRY if name not in single]
    kept = signals.where(F.col("collector_id").isin(single)).join(ids, "uri", "left_anti")
    of_fresh = C.signals(C.KnowledgeBase(fresh, resolved, edges), single, **options)
    return kb, kept.unionByName(of_fresh).unionByName(C.signals(kb, across, **options))


#: Raise these when policy entries or the tables' structure change their meaning.
POLICY_VERSION, SCHEMA_VERSION = "1.0", "1.0"


def configuration(spark, enabled: list[str] | None = None, weights: dict[str, float] | None = None, versions: dict[str, str] | None = None, policy: DataFrame | None = None) -> DataFrame:
    """(part): what findings and scores of an assessment are measured by: versions of policy and structure, the checks that ran and theirs, the dimensions' weights, and every policy entry."""
    names = sorted(enabled if enabled is not None else C.REGISTRY)
    rows = [f"policy_version={POLICY_VERSION}", f"schema_version={SCHEMA_VERSION}"] + [f"check={n}@{(versions or {}).get(n, '1.0')}" for n in names] + [f"weight={d}:{w}" for d, w in (weights or S.WEIGHTS).items()]
    entries = (S.policy(spark) if policy is None else policy).select(F.concat(F.lit("policy="), F.concat_ws("|", "collector_id", "signal_type", "severity", F.col("penalty").cast("string"))).alias("part"))
    return spark.createDataFrame([(r,) for r in rows], "part string").unionByName(entries)


def fingerprint(parts: DataFrame, by: list[str]) -> DataFrame:
    """(key..., digest) of what makes assessments comparable: parts (key..., part), strings such as policy entries, checks and weights."""
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("part")), "\n"), 256).alias("digest"))


def mismatch(one: DataFrame, other: DataFrame) -> DataFrame:
    """(part, change): parts that only the other has (added) or only the one (removed); none if the two can be compared."""
    return other.join(one, "part", "left_anti").select("part", F.lit("added").alias("change")).unionByName(one.join(other, "part", "left_anti").select("part", F.lit("removed").alias("change")))
