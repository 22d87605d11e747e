"""An assessment that is kept up to date: indexes for the checks across documents, changed by what an edit adds and takes away.

Every document gives entries (key, sub, uri): the spellings it uses, the versions and defaults it states, its opening
words, the word pairs of its claims and advice, the documents it asks for and those it leads to. Per key and sub a counter
holds how many documents have it (and, where a check needs them, the first and last), and from a key's counters follows
its verdict: the majority spelling, the lowest version, whether values conflict, whether a document is reached. A finding
depends on a document's own entries and their keys' verdicts alone.

So an edit takes the old entries of the changed documents away and adds the new ones; only keys for which that makes a
difference are read; only where a verdict changes do other documents have to be looked at again, by their entries, which
are also kept by document. Links are resolved anew for changed documents and for those that asked for a document which
came or went. All tables are keyed (see `store`), so an edit opens and rewrites only the buckets of its keys, and it is
published whole, or not at all. Texts are kept once, in `artifacts`: an edit reads none of them and lays its own over them.

Findings equal those of `collectors.signals` over the whole corpus, navigation edges included. Checks across documents
that users registered themselves are run whole. A given edit applied twice changes nothing the second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.operators import collectors as C
from kbq.operators import graph, parse, store
from kbq.session import passing, written

#: Checks across documents whose findings follow from entries and verdicts.
INDEXED = {"terminology_consistency", "contradiction_detection", "canonical_source", "knowledge_connectivity", "link_integrity"}
_ENTRY = ["key", "sub", "uri"]
#: Kinds of keys whose counters also hold the first and last document.
_BOUNDS = ("term", "advice")
_PARENTS = ["parent_child", "navigation"]
_FINDING = ["uri", "collector_id", "signal_type", "line", "discriminator"]
#: Files that a bucket of texts is cut into.
_FILES = 8


def _key(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}|"), name).alias("key")


def _kind(key: str = "key") -> Column:
    return F.substring_index(key, "|", 1)


def _name(key: str = "key") -> Column:
    return F.expr(f"substring({key}, length(substring_index({key}, '|', 1)) + 2)")


def entries(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, sub, uri), distinct: what documents add to the indexes by their own texts, of which `texts` are the traits."""
    none = F.lit("").alias("sub")
    links = parse.links(parsed).where("is_internal")
    parts = [
        C.term_uses(texts).select(_key("term", F.col("term_group")), F.lpad(F.col("place").cast("string"), 4, "0").alias("sub"), "uri"),
        C.version_claims(texts).select(_key("version", F.col("subject")), F.col("version").alias("sub"), "uri"),
        C.default_claims(texts).select(_key("default", F.col("feature")), F.col("value").cast("string").alias("sub"), "uri"),
        C.signatures(texts).select(_key("copy", F.col("signature")), none, "uri"),
        C.advice_pairs(texts).select(_key("advice", F.col("pair")), none, "uri"),
        C.claim_pairs(texts).select(_key("advice", F.col("pair")), F.lit("claim").alias("sub"), "uri"),
        parsed.select(_key("known", F.col("uri")), none, "uri"),
        graph.candidates(links).select(_key("known", F.col("candidate")), F.lit("asked").alias("sub"), "uri"),
        links.select(_key("to", F.col("target")), F.lit("link").alias("sub"), "uri"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def edge_entries(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved is not null").select(_key("to", F.col("resolved")), F.lit("edge").alias("sub"), "uri").distinct()


def navigation_entries(edges: DataFrame) -> DataFrame:
    """Entries of edges (source_uri, target_uri, relation_type) between known documents, distinct."""
    reach = edges.select(_key("to", F.col("target_uri")), F.concat(F.lit("nav:"), "relation_type").alias("sub"), F.col("source_uri").alias("uri"))
    parents = edges.where(F.col("relation_type").isin(_PARENTS)).select(_key("to", F.col("source_uri")), F.concat(F.lit("parent:"), "relation_type").alias("sub"), F.col("target_uri").alias("uri"))
    return reach.unionByName(parents).distinct()


def counted(found: DataFrame) -> DataFrame:
    """(key, sub, n, first, last) of entries."""
    bound = lambda f: F.when(F.max(_kind()).isin(*_BOUNDS), f("uri"))
    return found.groupBy("key", "sub").agg(F.count("*").alias("n"), bound(F.min).alias("first"), bound(F.max).alias("last"))


def verdicts(counters: DataFrame) -> DataFrame:
    """(key, verdict), one string a key; keys whose verdict is empty have no row."""
    n_of = lambda *subs: F.coalesce(F.sum(F.when(F.substring_index("sub", ":", 1).isin(*subs), F.col("n"))), F.lit(0)) > 0
    own = F.coalesce(F.sum(F.when(F.col("sub") == "", F.col("n"))), F.lit(0))
    per = counters.where("n > 0").groupBy("key").agg(
        F.count("*").alias("subs"), F.min(F.struct((-F.col("n")).alias("n"), "first", "sub"))["sub"].alias("major"), F.min(F.when(_kind() == "version", F.struct(C.version_order(F.col("sub")).alias("o"), "sub")))["sub"].alias("lowest"), own.alias("own"),
        F.max(F.when(F.col("sub") == "", F.col("first"))).alias("first"), n_of("edge", "nav", "link").alias("inbound"), n_of("edge", "nav", "parent").alias("reached"),
    )
    kind = _kind()
    found = (
        F.when(kind == "term", F.when(F.col("subs") > 1, F.col("major"))).when(kind == "version", F.col("lowest")).when(kind == "default", F.when(F.col("subs") > 1, "conflict"))
        .when(kind == "copy", F.when(F.col("own") > 1, "many")).when(kind == "advice", F.when(F.col("own") > 1, "*").when(F.col("own") == 1, F.col("first")))
        .when(kind == "known", F.when(F.col("own") > 0, "known")).when(kind == "to", F.concat(F.col("inbound").cast("int").cast("string"), F.col("reached").cast("int").cast("string")))
    )
    return per.select("key", found.alias("verdict")).where("verdict is not null and verdict <> ''")


def _across(uris: DataFrame, own: DataFrame, resolved: DataFrame, judged: DataFrame, several: bool) -> DataFrame:
    """Findings across documents of some, which follow from those: own are their entries, resolved their links, judged the verdicts of their keys (and of to|uri)."""
    with_verdict = own.where(_kind().isin("term", "version", "default", "copy", "advice")).join(judged, "key")
    kind, verdict = _kind(), F.col("verdict")
    hit = with_verdict.where(
        (kind.isin("term", "version") & (F.col("sub") != verdict)) | kind.isin("default", "copy") | ((kind == "advice") & (F.col("sub") == "claim") & (verdict != F.col("uri")))
    )
    collector = F.when(kind == "term", "terminology_consistency").when(kind == "copy", "canonical_source").otherwise("contradiction_detection")
    signal = F.when(kind == "term", "terminology_variant").when(kind == "version", "version_conflict").when(kind == "default", "boolean_default_conflict").when(kind == "copy", "duplicate_content").otherwise("deprecation_vs_recommendation")
    one = F.when(kind == "advice", F.lit("")).otherwise(F.col("key"))
    plain = lambda df, collector_id, signal_type: df.select("uri", F.lit(collector_id).alias("collector_id"), F.lit(signal_type).alias("signal_type"))
    keyed = hit.select("uri", collector.alias("collector_id"), signal.alias("signal_type"), one.alias("one")).distinct().drop("one")
    state = uris.select("uri", _key("to", F.col("uri"))).join(judged, "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit("00")))
    lost = plain(state.where("verdict like '0%'"), "knowledge_connectivity", "orphan_artifact")
    orphans = plain(state.where(F.col("verdict").like("%0") & F.lit(several)), "link_integrity", "orphan")
    broken = plain(resolved.where("resolved is null").select("uri").distinct(), "link_integrity", "broken_link")
    found = keyed.unionByName(lost).unionByName(orphans).unionByName(broken).withColumn("line", F.lit(None).cast("int")).withColumn("discriminator", F.lit(""))
    return found.select(_FINDING)


def _single() -> list[str]:
    return [name for name, (_, scope, _) in C.REGISTRY.items() if scope == "per_artifact"]


def build(spark: SparkSession, folder: str, docs: DataFrame, navigation: DataFrame | None = None, buckets: int = 16, **options) -> int:
    """Assess docs(uri, text) whole and publish the findings with the indexes; navigation: edges (source_uri, target_uri, relation_type). The version's number."""
    none = "source_uri string, target_uri string, relation_type string"
    with passing(spark):
        navigation = written((spark.createDataFrame([], none) if navigation is None else navigation.select("source_uri", "target_uri", "relation_type")).distinct(), "navigation")
        return store.publish(spark, folder, _tables(spark, folder, docs.select("uri", "text"), parse.compact, navigation, buckets, options))


def _tables(spark: SparkSession, folder: str, docs: DataFrame, parsing: Callable[[DataFrame], DataFrame] | None, navigation: DataFrame, buckets: int, options: dict) -> dict:
    """All tables of docs, which `parsing` parses where they lie by their buckets (None: they are)."""
    artifacts, kept = store.put(spark, folder, "artifacts", store.Keyed(docs, ["uri"], buckets, files=_FILES, then=parsing))
    parsed = parse.completed(kept)
    resolved = written(graph.resolve(parse.links(parsed), parsed), "resolved")
    given = graph.prune(navigation, parsed)
    kb = C.KnowledgeBase(parsed, resolved, written(graph.prune(graph.cross_references(resolved), parsed).unionByName(given), "edges"), navigation)
    own = written(entries(parsed, kb.traits), "own")
    found = written(own.unionByName(edge_entries(resolved)).unionByName(navigation_entries(given)), "entries")
    ends = navigation.select(F.col("source_uri").alias("end"), "*").union(navigation.select(F.col("target_uri").alias("end"), "*")).distinct()
    keyed = lambda rows, *key, files=1: store.Keyed(rows, list(key), buckets, files=files)
    return {
        "artifacts": artifacts, "own": keyed(own, "uri"), "resolved": keyed(kb.resolved, "uri", "pos"), "entries": keyed(found, *_ENTRY, files=4), "counters": keyed(counted(found), "key", "sub"),
        "navigation": keyed(ends, "end"), "signals": keyed(C.signals(kb, **options), "uri"), "size": kb.artifacts.agg(F.count("*").alias("documents")),
    }


def load(spark: SparkSession, folder: str) -> tuple[C.KnowledgeBase, DataFrame]:
    """(knowledge base, findings) of the newest version."""
    now = store.Snapshot.newest(spark, folder)
    return _knowledge_base(now, parse.completed(now.load("artifacts")), now.load("resolved")), now.load("signals")


def _known(now: store.Snapshot, uris: DataFrame, came: DataFrame) -> DataFrame:
    """(uri, before, after): which of the documents were known, and which are after (uri, sign) came or went."""
    held = now.matching("counters", uris.select(_key("known", F.col("uri")))).where("sub = '' and n > 0").select(_name().alias("uri")).withColumn("held", F.lit(1))
    joined = uris.select("uri").distinct().join(held, "uri", "left").join(came, "uri", "left")
    return joined.select("uri", F.col("held").isNotNull().alias("before"), (F.coalesce("held", F.lit(0)) + F.coalesce("sign", F.lit(0)) > 0).alias("after"))


def edit(spark: SparkSession, folder: str, docs: DataFrame, deleted: DataFrame | None = None, most: float = 0.5, **options) -> int:
    """Publish the assessment after docs(uri, text) were added or replaced and deleted(uri) taken away. If more than `most` of the documents change, all are assessed anew. The version's number."""
    with passing(spark):
        fresh = written(parse.compact(docs.select("uri", "text").dropDuplicates(["uri"])), "fresh")
        gone = written(deleted.select("uri").distinct().join(fresh.select("uri"), "uri", "left_anti") if deleted is not None else fresh.select("uri").where("false"), "deleted")
        return store.transact(spark, folder, lambda now: _change(now, fresh, gone, most, options))


def _signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that only one side has, with sign 1 (new) or -1 (old)."""
    both = old.withColumn("s", F.lit(-1)).unionByName(new.withColumn("s", F.lit(1)))
    return both.groupBy(*_ENTRY).agg(F.sum("s").alias("sign")).where("sign <> 0")


def _change(now: store.Snapshot, fresh: DataFrame, gone: DataFrame, most: float, options: dict) -> dict:
    spark = now.spark
    size = now.load("size").first()[0]
    docs = fresh.select("uri")
    ids = docs.union(gone)
    if ids.count() > most * size:
        navigation = now.load("navigation").select("source_uri", "target_uri", "relation_type").distinct()
        return _tables(spark, now.folder, now.load("artifacts").join(ids, "uri", "left_anti").unionByName(fresh), None, navigation, now.tables["artifacts"]["n"], options)
    new = C.KnowledgeBase(parse.completed(fresh), None, None)
    added = written(entries(new.artifacts, new.traits), "own")
    delta = written(_signed(now.matching("own", ids).select(_ENTRY), added), "delta")
    came = written(delta.where((_kind() == "known") & (F.col("sub") == "")).select("uri", "sign"), "came")
    several = size + (came.agg(F.sum("sign")).first()[0] or 0) > 1

    # links of changed documents and of those that asked for documents that came or went
    asking = now.matching("entries", came.select(_key("known", F.col("uri")))).where("sub = 'asked'").select("uri")
    relinked = written(docs.union(asking.join(gone, "uri", "left_anti")).distinct(), "relinked")
    unchanged = now.matching("resolved", relinked.join(ids, "uri", "left_anti")).withColumn("is_internal", F.lit(True))
    links = written(parse.links(fresh).unionByName(unchanged.select("uri", "pos", "text", "target", "line", "is_internal")), "links")
    known = _known(now, graph.candidates(links).select(F.col("candidate").alias("uri")), came).where("after").select("uri")
    resolved = written(graph.resolve(links, known), "resolved")
    before = written(now.matching("resolved", relinked.union(gone)), "resolved-before")

    # navigation edges of which an end came or went
    edges = now.matching("navigation", came.select(F.col("uri").alias("end"))).select("source_uri", "target_uri", "relation_type").distinct()
    edges = written(edges, "navigation")
    ends = written(_known(now, edges.select(F.col("source_uri").alias("uri")).union(edges.select("target_uri")), came), "ends")
    among = lambda when: graph.prune(edges, ends.where(when).select("uri"))
    delta = written(delta.unionByName(_signed(edge_entries(before), edge_entries(resolved))).unionByName(_signed(navigation_entries(among("before")), navigation_entries(among("after")))), "delta")

    # counters: sums of signs; a first or last document that goes is looked for among the key's entries
    held = written(now.matching("counters", delta.select("key")), "counters-before")
    add = lambda f: F.when(F.max(_kind()).isin(*_BOUNDS), f(F.when(F.col("sign") > 0, F.col("uri"))))
    sums = delta.groupBy("key", "sub").agg(F.sum("sign").alias("by"), add(F.min).alias("low"), add(F.max).alias("high"))
    lost = delta.where("sign < 0").join(held.where("first is not null").select("key", "sub", "first", "last"), ["key", "sub"]).where("uri = first or uri = last").select("key", "sub").distinct()
    lost = written(lost, "lost-bounds")
    again = now.matching("entries", lost.select("key")).join(lost, ["key", "sub"], "left_semi").select(_ENTRY).join(delta.where("sign < 0"), _ENTRY, "left_anti").unionByName(delta.where("sign > 0").join(lost, ["key", "sub"], "left_semi").select(_ENTRY))
    summed = held.join(sums, ["key", "sub"], "full_outer").join(lost, ["key", "sub"], "left_anti")
    summed = summed.select("key", "sub", (F.coalesce("n", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("n"), F.least("first", "low").alias("first"), F.greatest("last", "high").alias("last"))
    counters = written(summed.unionByName(counted(again)), "counters")

    # documents whose findings may differ
    was, judged = verdicts(held).withColumnRenamed("verdict", "was"), verdicts(counters)
    turned = written(was.join(judged, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("verdict"))).select("key"), "turned")
    of_key = now.matching("entries", turned.where(_kind().isin("term", "version", "default", "copy", "advice"))).where("key not like 'advice|%' or sub = 'claim'").select("uri")
    targets = _known(now, turned.where(_kind() == "to").select(_name().alias("uri")), came).where("after").select("uri")
    affected = relinked.union(of_key).union(targets).distinct().join(gone, "uri", "left_anti")
    if several != (size > 1):
        affected = affected.union(now.load("artifacts").select("uri").join(ids, "uri", "left_anti")).distinct()
    affected = written(affected, "affected")
    own = written(added.unionByName(now.matching("own", affected.join(docs, "uri", "left_anti")).select(_ENTRY)), "affected-entries")
    every_resolved = resolved.unionByName(now.matching("resolved", affected.join(relinked, "uri", "left_anti")))
    asked = own.select("key").union(affected.select(_key("to", F.col("uri")))).distinct()
    current = now.matching("counters", asked).join(counters.select("key").distinct(), "key", "left_anti").unionByName(counters.join(asked, "key", "left_semi"))
    single = _single()
    new.resolved = resolved
    found = C.named(_across(affected, own, every_resolved, verdicts(current), several).unionByName(C.missing_canonical(new).select(_FINDING)))
    by_text = F.col("collector_id").isin(single) | (F.col("signal_type") == "missing_canonical_source")  # follows from a document's text alone
    kept = now.matching("signals", affected).where(by_text).join(docs, "uri", "left_anti")
    signals = kept.unionByName(found).unionByName(C.signals(new, single, **options))
    signals = written(signals, "signals")

    put = lambda name, rows, *key, gone=None, files=1: store.upserted(now, name, rows, list(key), gone=gone, files=files)
    replaced = affected.union(gone)
    out = {
        "artifacts": store.layered(now, "artifacts", fresh, ["uri"], gone, files=_FILES), "own": put("own", added, "uri", gone=gone), "resolved": put("resolved", resolved, "uri", gone=relinked.union(gone)),
        "entries": put("entries", delta.where("sign > 0").select(_ENTRY), *_ENTRY, gone=delta.where("sign < 0").select(_ENTRY), files=4),
        "counters": put("counters", counters.where("n > 0"), "key", "sub", gone=delta.select("key", "sub").distinct()), "signals": put("signals", signals, "uri", gone=replaced),
        "size": spark.createDataFrame([(size + (came.agg(F.sum("sign")).first()[0] or 0),)], "documents long"),
    }
    others = [name for name, (_, scope, _) in C.REGISTRY.items() if scope != "per_artifact" and name not in INDEXED]
    if others:
        whole_parsed = parse.completed(now.load("artifacts").join(ids, "uri", "left_anti").unionByName(fresh))
        whole_resolved = now.load("resolved").join(relinked.union(gone), "uri", "left_anti").unionByName(resolved)
        rest = now.load("signals").where(~F.col("collector_id").isin(others)).join(replaced, "uri", "left_anti")
        out["signals"] = store.Keyed(rest.unionByName(signals).unionByName(C.signals(_knowledge_base(now, whole_parsed, whole_resolved), others, **options)), ["uri"], now.tables["signals"]["n"])
    return out


def _knowledge_base(now: store.Snapshot, parsed: DataFrame, resolved: DataFrame) -> C.KnowledgeBase:
    navigation = now.load("navigation").select("source_uri", "target_uri", "relation_type").distinct()
    return C.KnowledgeBase(parsed, resolved, graph.prune(graph.cross_references(resolved).unionByName(navigation), parsed))


def changes(folder: str, order: str = "at", **options):
    """A foreachBatch handler that keeps an assessment up to date: rows uri, text, event (deleted, or anything else) and a column that orders a document's changes. A batch given twice changes nothing."""

    def handle(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("uri").agg(F.max_by(F.struct("text", "event"), order).alias("x")).select("uri", "x.*")
        with passing(batch.sparkSession):
            newest = written(newest, "changes")
            edit(batch.sparkSession, folder, newest.where("event <> 'deleted'"), newest.where("event = 'deleted'"), **options)

    return handle
