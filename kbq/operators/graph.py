"""The link graph: resolved links, edges, degrees and orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbq.functions import text as T

#: Extensions tried, in this order, for targets that have none of them.
_TRIED = ["md", "mdx", "txt", "rst"]


def _inner(links: DataFrame) -> DataFrame:
    clean = F.regexp_replace(F.replace(F.col("target"), F.lit("\\"), F.lit("/")), "[#?].*$", "")
    return links.where("is_internal").withColumn("clean", clean).where("clean <> ''")


def candidates(links: DataFrame) -> DataFrame:
    """(uri, pos, rank, candidate): the documents that an internal link may lead to, the first that exists does."""
    here = lambda c: T.normal_path(F.concat(T.directory(F.col("uri")), c))
    tries = [here(F.col("clean")), F.col("clean"), F.when(F.col("clean").startswith("./"), F.expr("substring(clean, 3)"))]
    bare = ~F.col("clean").rlike(r"\.(md|mdx|txt|rst)$")
    for ext in _TRIED:
        tries += [F.when(bare, F.concat("clean", F.lit(f".{ext}"))), F.when(bare, here(F.concat("clean", F.lit(f".{ext}"))))]
    ranked = F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(F.lit(i).alias("rank"), t.alias("candidate"))) for i, t in enumerate(tries)]))
    return _inner(links).select("uri", "pos", T.once(ranked).alias("cs")).select("uri", "pos", F.explode("cs").alias("c")).select("uri", "pos", "c.*")


def resolve(links: DataFrame, known: DataFrame) -> DataFrame:
    """Internal links with `resolved`, the document they lead to (null if none); pure anchors are left out.

    links: uri, pos, text, target, line, is_internal; known: uri. Candidates by rank: relative to the document's
    folder, as it stands, without a leading ./, and with each extension. One equi-join finds the first that exists.
    """
    inner, asked = _inner(links), candidates(links)
    hits = asked.join(known.select(F.col("uri").alias("candidate")), "candidate").groupBy("uri", "pos").agg(F.min_by("candidate", "rank").alias("resolved"))
    return inner.join(hits, ["uri", "pos"], "left").select("uri", "pos", "text", "target", "clean", "line", "resolved")


def cross_references(resolved: DataFrame) -> DataFrame:
    """Distinct edges (source_uri, target_uri, relation_type) of resolved links."""
    found = resolved.where("resolved is not null").select(F.col("uri").alias("source_uri"), F.col("resolved").alias("target_uri")).distinct()
    return found.withColumn("relation_type", F.lit("cross_reference"))


def prune(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of which both ends are known."""
    for end in ("source_uri", "target_uri"):
        edges = edges.join(known.select(F.col("uri").alias(end)), end, "left_semi")
    return edges.select("source_uri", "target_uri", "relation_type")


def in_degree(known: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """(uri, inbound): edges and exactly matching internal links that lead to each document."""
    targets = edges.select(F.col("target_uri").alias("uri")).unionAll(links.where("is_internal").select(F.col("target").alias("uri")))
    counted = targets.groupBy("uri").agg(F.count("*").alias("inbound"))
    return known.select("uri").join(counted, "uri", "left").select("uri", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def orphans(known: DataFrame, resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents that no link or edge leads to and that are no parents in the hierarchy; none in a corpus of one."""
    reached = resolved.where("resolved is not null").select(F.col("resolved").alias("uri")).union(edges.select("target_uri"))
    parents = edges.where("relation_type in ('parent_child', 'navigation')").select(F.col("source_uri").alias("uri"))
    left = known.select("uri").join(reached.union(parents).distinct(), "uri", "left_anti")
    several = known.agg(F.count("*").alias("n")).where("n > 1").select(F.lit(True).alias("several"))
    return left.join(F.broadcast(several)).select("uri")


def neighbours(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(uri, children, parents, references, referenced_by, linked): for every document its edges by kind, and whether it has one with another document."""
    ends = lambda a, b: edges.select(F.col(a).alias("uri"), F.col(b).alias("other"), "relation_type")
    of = lambda kind, name: F.count_if(F.col("relation_type") == kind).alias(name)
    out = ends("source_uri", "target_uri").groupBy("uri").agg(of("parent_child", "children"), of("cross_reference", "references"), F.count_if(F.col("other") != F.col("uri")).alias("away"))
    into = ends("target_uri", "source_uri").groupBy("uri").agg(of("parent_child", "parents"), of("cross_reference", "referenced_by"), F.count_if(F.col("other") != F.col("uri")).alias("near"))
    joined = known.select("uri").join(out, "uri", "left").join(into, "uri", "left").fillna(0)
    return joined.select("uri", "children", "parents", "references", "referenced_by", (F.col("away") + F.col("near") > 0).alias("linked"))
