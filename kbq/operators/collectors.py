"""The ten checks. Each takes a KnowledgeBase and returns one row a finding, with typed evidence beside the common columns.

Common columns: uri, collector_id, signal_type, line (null where a finding has none) and discriminator (what tells
findings of one type in one document apart in their id; empty for most). `signals` unions them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.operators import graph, parse
from kbq.session import written

# The word lists, patterns and pairs that findings are defined by.
STOPWORDS = "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare to of in for on with at by from as into through during before after above below up down out off over under again further then once here there when where why how all each few more most other some such no nor not only own same so than too very just also and or but if while about this that these those it its they them their we us our you your he she his her".split()
DANGLING = [r"\bas mentioned above\b", r"\bas mentioned below\b", r"\bas discussed above\b", r"\bas discussed earlier\b", r"\bsee above\b", r"\bsee below\b", r"\bprevious example\b", r"\bprevious section\b", r"\bfollowing section\b", r"\bthe above\b", r"\bthe below\b", r"\bthe previous\b", r"\bthe following\b", r"\bin the previous step\b", r"\bin the next step\b", r"\bthe aforementioned\b", r"\bthe latter\b", r"\bthe former\b"]
UNDEFINED = [r"(?m)^\s*(this|that|these|those)\s+(?:feature|function|method|option|setting|field|parameter|value|property)\b", r"(?m)^\s*it\s+(?:is|was|will|should|can|must|does|has)\b"]
GENERIC = ["overview", "introduction", "background", "summary", "conclusion", "details", "miscellaneous", "other", "notes", "additional", "appendix", "reference", "references", "resources", "help", "getting started", "setup", "configuration", "settings", "general", "info", "information", "about", "more"]
PLACEHOLDER = ["todo", "tbd", "placeholder", "coming soon", "wip", "n/a", "none"]
GOOD_WORDS = ["api", "sdk", "cli", "faq", "changelog", "graphql", "rest", "grpc", "css", "html", "sql"]
TERMS = ["OAuth2", "OAuth 2.0", "oauth2", "oauth 2.0", "OpenAPI", "openapi", "Open API", "open-api", "RESTful", "REST API", "rest api", "restful", "JavaScript", "Javascript", "javascript", "Java Script", "TypeScript", "Typescript", "typescript", "Type Script", "PostgreSQL", "postgresql", "Postgres", "postgres", "MongoDB", "mongodb", "Mongo DB", "FastAPI", "Fast API", "fastapi", "fast-api", "WebSocket", "Websocket", "websocket", "Web Socket", "gRPC", "grpc", "GRPC", "CI/CD", "CI-CD", "cicd", "CICD", "Microservice", "Microservices", "microservice", "microservices", "API", "api", "Api"]
VERSION = r"(?i)(?:requires?|supports?|needs?|compatible with|minimum)\s+(Python|Node\.js|Node|Java|Go|Rust|Ruby|PHP)\s+(\d+\.\d+(?:\.\d+)?)"
DEPRECATION = r"(?i)\b(deprecat\w+|removed|no longer supported|obsolete)\b"
RECOMMENDATION = r"(?i)\b(recommend\w+|should use|best practice|preferred)\b"
FEATURE = r"(?i)([\w\s]{3,40}?)\s+(?:is|are)\s+(enabled|disabled|on|off|true|false)\s+by default"
SMALL_WORDS = ["the", "a", "an", "is", "are", "to", "and", "or", "in", "for", "of"]
CANONICAL = {"python": "docs.python.org", "fastapi": "fastapi.tiangolo.com", "mdn": "developer.mozilla.org", "node": "nodejs.org", "nodejs": "nodejs.org", "react": "react.dev", "typescript": "typescriptlang.org", "postgresql": "postgresql.org", "postgres": "postgresql.org", "mongodb": "mongodb.com", "redis": "redis.io", "docker": "docker.com", "kubernetes": "kubernetes.io", "gcp": "cloud.google.com", "aws": "aws.amazon.com", "azure": "azure.microsoft.com"}
DATE_KEYS = ["last_modified", "date", "updated", "created", "last_updated"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ISO_DATE = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
WRITTEN_DATE = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2}),?\s+(20\d{2})\b"
WORKFLOW = ["tutorial", "how to", "getting started", "setup guide", "quickstart", "quick start", "step by step", "walkthrough", "installation guide", "configuration guide"]
PREREQUISITES = "prerequis|requirement|before you start|what you need"  # plain parts, as those of VERIFICATION
STEPS = r"(?im)(?:^|\n)\s*(?:#{1,6}\s+)?(?:\d+\.|step\s+\d+|step\s*\d)"
VERIFICATION = "verif|test|check|confirm|validate|troubleshoot|error|debug|common issue|faq"


#: One of these is in every match of the pattern that they are named after, in small letters.
DANGLING_WORDS = ["above", "below", "earlier", "previous", "following", "next step", "aforementioned", "latter", "former"]
#: Both of UNDEFINED behind one test for a line's beginning.
UNDEFINED_ANY = "(?m)^" + r"\s*(?:" + "|".join(p.removeprefix(r"(?m)^\s*") for p in UNDEFINED) + ")"
TERM_STEMS = ["oauth", "restful", "script", "postgres", "mongo", "api", "socket", "grpc", "cd", "microservice"]
VERSION_WORDS = ["require", "support", "need", "compatible with", "minimum"]
DEPRECATION_WORDS = ["deprecat", "removed", "no longer supported", "obsolete"]
RECOMMENDATION_WORDS = ["recommend", "should use", "best practice", "preferred"]
#: name -> what a text is looked through for, one pass each however many parts there are: does it contain one of them?
GATES = {
    "dangling": DANGLING_WORDS, "versions": VERSION_WORDS, "deprecation": DEPRECATION_WORDS, "recommendation": RECOMMENDATION_WORDS, "defaults": ["by default"],
    "guide": WORKFLOW, "prerequisites": PREREQUISITES.split("|"), "verification": VERIFICATION.split("|"),
}
#: The same of parts of which each matters: which of them does a text contain?
EACH = {"stems": TERM_STEMS, "technologies": list(CANONICAL)}
#: UNDEFINED_ANY in Arrow's pattern language and in small letters, with the ends of lines and the white space that Java knows.
UNDEFINED_GATE = r"(?:\A|[\n\r\x{85}\x{2028}\x{2029}])[\s\x0b]*(?:" + "|".join(p.removeprefix(r"(?m)^\s*").removesuffix(r"\b").replace(r"\s", r"[\s\x0b]") for p in UNDEFINED) + ")"


@dataclass
class KnowledgeBase:
    """Parsed artifacts, their links with what they lead to, the edges among them, and the navigation edges that were given."""

    artifacts: DataFrame
    resolved: DataFrame
    edges: DataFrame
    navigation: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, navigation: DataFrame | None = None) -> "KnowledgeBase":
        """docs(uri, text); navigation: further edges (source_uri, target_uri, relation_type).

        Documents are parsed and links resolved once; both are written, and every check starts from a scan of the columns it needs.
        """
        spark = docs.sparkSession
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parsed = parse.completed(written(parse.stored(docs.repartition(parts, "uri")), "artifacts"))  # files may have few row groups, which would be all tasks of this step and of those after it
        resolved = written(graph.resolve(parse.links(parsed), parsed), "resolved")
        edges = graph.cross_references(resolved)
        if navigation is not None:
            edges = edges.unionByName(navigation)
        return cls(parsed, resolved, written(graph.prune(edges, parsed), "edges"), navigation)

    @cached_property
    def traits(self) -> DataFrame:
        """What the checks look for in the artifacts' texts, found by one pass over them when it is first asked for."""
        return traits(self.artifacts)


#: name -> column of what a check looks for in a text, made of an artifact's columns, of `low`, its text in small letters, and of `has`, what that contains.
TRAITS: dict[str, Callable[[], Column]] = {}


def trait(f: Callable[[], Column]) -> Callable[[], Column]:
    TRAITS[f.__name__] = f
    return f


def _any_part(texts: pa.Array, parts: list[str]) -> pa.Array:
    return pc.match_substring_regex(texts, "|".join(map(_quoted, parts)))


def _each_part(texts: pa.Array, parts: list[str]) -> pa.Array:
    """A list a text: those of the parts that it contains. They are told apart only in texts with one."""
    some = np.flatnonzero(_any_part(texts, parts).to_numpy(zero_copy_only=False))
    hit = np.zeros((len(texts), len(parts)), dtype=bool)
    few = texts.take(pa.array(some))
    for i, p in enumerate(parts):
        hit[some, i] = pc.match_substring(few, p).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(hit.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parts).take(pa.array(np.nonzero(hit)[1])))


def _looked_through(low: pa.Array) -> pa.Array:
    texts = pc.fill_null(low, "")
    found = {name: _any_part(texts, parts) for name, parts in GATES.items()} | {"undefined": pc.match_substring_regex(texts, UNDEFINED_GATE)} | {name: _each_part(texts, parts) for name, parts in EACH.items()}
    return pa.StructArray.from_arrays(list(found.values()), names=list(found))


_HAS = "struct<" + ", ".join([f"{n}: boolean" for n in [*GATES, "undefined"]] + [f"{n}: array<string>" for n in EACH]) + ">"


def _lowered(parsed: DataFrame) -> DataFrame:
    """parsed with `low`, the text in small letters, and `has`: what of GATES and EACH it contains. A text without any part of a check is looked through for it once, by automata, instead of once for each part."""
    return parsed.select("*", T.once(F.lower("all_text")).alias("low")).withColumn("has", F.arrow_udf(_looked_through, _HAS)("low"))


def traits(parsed: DataFrame) -> DataFrame:
    """(uri, and every trait), written: texts are read and put in small letters once for all checks."""
    return written(_lowered(parsed).select("uri", *[make().alias(name) for name, make in TRAITS.items()]), "traits")


def _trait(parsed: DataFrame, name: str) -> DataFrame:
    """(uri, x): one trait of artifacts, or of traits that are written."""
    if name in parsed.columns:
        return parsed.select("uri", F.col(name).alias("x"))
    return _lowered(parsed).select("uri", T.once(TRAITS[name]()).alias("x"))


def _each(parsed: DataFrame, name: str) -> DataFrame:
    """(uri, x): a row for each entry of a trait that is an array."""
    return _trait(parsed, name).select("uri", F.explode("x").alias("x"))


#: id -> (dimension, scope, function); scope cross_artifact means findings depend on other documents.
REGISTRY: dict[str, tuple[str, str, Callable[..., DataFrame]]] = {}


def collector(name: str, dimension: str, scope: str = "per_artifact"):
    """Register a check; user-defined ones are added the same way."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = (dimension, scope, f)
        return f

    return add


def _found(df: DataFrame, collector_id: str, signal_type: str | Column, line: Column | None = None, discriminator: Column | None = None, **evidence: Column) -> DataFrame:
    kind = F.lit(signal_type) if isinstance(signal_type, str) else signal_type
    line = F.lit(None) if line is None else line
    mark = F.lit("") if discriminator is None else discriminator
    return df.select("uri", F.lit(collector_id).alias("collector_id"), kind.alias("signal_type"), line.cast("int").alias("line"), mark.alias("discriminator"), *[c.alias(k) for k, c in evidence.items()])


def keywords(heading: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(heading), F.lit("[a-z]{2,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS)))


def topic_measures(parsed: DataFrame) -> DataFrame:
    """(uri, clusters, largest, entropy) of documents with two headings or more: how their top-level headings share out keywords."""
    top = F.array_min(F.transform("headings", lambda h: h["level"]))
    heads = parsed.where(F.size("headings") >= 2).select("uri", top.alias("top"), F.posexplode("headings").alias("pos", "h"))
    starts = (F.col("h.level") == F.col("top")).cast("int")
    marked = heads.withColumn("cluster", F.sum(starts).over(Window.partitionBy("uri").orderBy("pos"))).where("cluster > 0")
    sizes = marked.select("uri", "cluster", F.explode_outer(keywords(F.col("h.text"))).alias("k")).groupBy("uri", "cluster").agg((F.countDistinct("k") + 1).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("uri"))
    return sizes.withColumn("p", share).groupBy("uri").agg(F.count("*").alias("clusters"), F.max("p").alias("largest"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


@collector("topic_purity", "retrieval")
def mixed_topics(kb: KnowledgeBase) -> DataFrame:
    """Documents whose top-level headings share out their keywords too evenly."""
    per = topic_measures(kb.artifacts)
    return _found(per.where("clusters > 1 and largest < 0.7"), "topic_purity", "mixed_topics", cluster_count=F.col("clusters"), largest_cluster_ratio=F.round("largest", 3), topic_entropy=F.round("entropy", 3))


@trait
def references() -> Column:
    """struct<n, phrases>: how often paragraphs refer to what is outside of them, and by which phrases, in their order; null in most documents."""
    count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    said = lambda c, p: F.when(F.contains(c, F.lit(p.replace(r"\b", ""))), count(c, p)).otherwise(0)  # noqa: E731  each of DANGLING is a phrase between two edges of words
    lowered = F.transform("paragraphs", lambda p: F.struct(F.lower(p["text"]).alias("low"), p["text"].alias("text")))
    hit = F.filter(lowered, lambda p: T.any_of(p["low"], DANGLING_WORDS) | p["text"].rlike(UNDEFINED_ANY))
    of = lambda p: reduce(lambda a, b: a + b, [said(p["low"], d) for d in DANGLING] + [count(p["text"], u) for u in UNDEFINED])
    n = lambda ps: F.aggregate(F.transform(ps, of), F.lit(0).cast("long"), lambda a, n: a + n)
    phrases = lambda ps: F.regexp_extract_all(F.array_join(F.transform(ps, lambda p: p["low"]), "\n"), F.lit("|".join(DANGLING)), F.lit(0))
    found = F.element_at(F.transform(F.array(hit), lambda ps: F.struct(n(ps).alias("n"), phrases(ps).alias("phrases"))), 1)
    return F.when(F.col("has.dangling") | (F.col("has.undefined") & F.col("all_text").rlike(UNDEFINED_ANY)), found)  # paragraphs are parts of the text


def dangling_phrases(parsed: DataFrame) -> DataFrame:
    """(uri, pos, ref): the phrases by which documents refer to what is outside of them."""
    return _trait(parsed, "references").select("uri", F.posexplode("x.phrases").alias("pos", "ref"))


@collector("context_independence", "context")
def dangling_references(kb: KnowledgeBase) -> DataFrame:
    """Documents with paragraphs that refer to what is outside of them."""
    return _found(kb.traits.where("references.n > 0"), "context_independence", "dangling_reference", dangling_reference_count=F.col("references.n"))


@collector("heading_quality", "retrieval")
def heading_quality(kb: KnowledgeBase) -> DataFrame:
    """Headings that are placeholders, bare numbers, generic or too short."""
    low = F.lower("text")
    single = (F.size(F.split("text", r"\s+")) == 1) & ~low.isin(GOOD_WORDS) & (F.length("text") < 4)
    issue = F.when(low.isin(PLACEHOLDER), "placeholder").when(low.rlike(r"^(step\s+)?\d+$"), "numbered_only").when(low.isin(GENERIC), "generic").when(single, "too_short")
    found = parse.headings(kb.artifacts).withColumn("issue", issue).where("issue is not null")
    return _found(found, "heading_quality", F.col("issue"), line=F.col("line"), heading=F.col("text"), level=F.col("level"))


def _quoted(term: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term)


def _any_term() -> str:
    """One pattern for all terms in any case, longer ones first."""
    return r"(?i)\b(?:" + "|".join(_quoted(t) for t in sorted({t.lower() for t in TERMS}, key=lambda t: (-len(t), t))) + r")\b"


@trait
def terms() -> Column:
    """array<struct<term_group, variant, place>>: the spellings that a text uses. They are looked for only in those of its lines that contain a term's stem, and by pattern only if the lines contain them."""
    group = lambda t: "".join(c for c in t.lower() if c not in " -_/")
    none = F.array().cast("array<struct<term_group:string,variant:string,place:int>>")

    def used(lines: Column) -> Column:
        """lines: struct<text, low>."""
        uses = lambda t: F.contains(lines["low" if t.islower() else "text"], F.lit(t)) & lines["text"].rlike(("(?i)" if t.islower() else "") + rf"\b{_quoted(t)}\b")
        row = lambda i, t: F.when(uses(t), F.struct(F.lit(group(t)).alias("term_group"), F.lit(t).alias("variant"), F.lit(i).alias("place")))
        by_stem: dict[str, list[Column]] = {}
        for i, t in enumerate(TERMS):
            by_stem.setdefault(next(s for s in TERM_STEMS if s in t.lower()), []).append(row(i, t))
        return F.concat(*[F.when(F.contains(lines["low"], F.lit(s)), F.array_compact(F.array(*rows))).otherwise(none) for s, rows in by_stem.items()])

    stem = lambda x: F.exists(F.array(F.lower(x)), lambda low: F.exists("has.stems", lambda s: F.contains(low, s)))
    lines = F.array_join(F.filter(F.split("all_text", "\n", -1), stem), "\n")  # no term has a line's end in it
    both = F.transform(F.array(lines), lambda x: F.struct(x.alias("text"), F.lower(x).alias("low")))
    return F.when(F.size("has.stems") > 0, F.element_at(F.transform(both, used), 1)).otherwise(none)


def term_uses(parsed: DataFrame) -> DataFrame:
    """(uri, term_group, variant, place): the spellings that documents use; place is that in the list of terms."""
    return _each(parsed, "terms").select("uri", "x.*")


@collector("terminology_consistency", "consistency", "cross_artifact")
def terminology_variants(kb: KnowledgeBase) -> DataFrame:
    """Documents that use another spelling of a term than most documents do."""
    used = term_uses(kb.traits)
    counts = used.groupBy("term_group", "variant", "place").agg(F.count("*").alias("n"), F.min("uri").alias("first_uri"))
    order = Window.partitionBy("term_group").orderBy(F.desc("n"), "first_uri", "place")
    ranked = counts.withColumn("r", F.row_number().over(order)).withColumn("variants", F.count("*").over(Window.partitionBy("term_group")))
    major = ranked.where("r = 1 and variants > 1").select("term_group", F.col("variant").alias("majority_variant"), F.col("n").alias("majority_count"))
    minor = used.join(F.broadcast(ranked.where("r > 1").select("term_group", "variant", "n", "first_uri")), ["term_group", "variant"])
    best = F.min_by(F.struct("variant", "n"), F.struct("first_uri", "place"))
    per = minor.groupBy("uri", "term_group").agg(best.alias("m")).join(F.broadcast(major), "term_group")
    return _found(per, "terminology_consistency", "terminology_variant", term_group=F.col("term_group"), minority_variant=F.col("m.variant"), majority_variant=F.col("majority_variant"), minority_count=F.col("m.n"), majority_count=F.col("majority_count"))


def version_order(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


@collector("contradiction_detection", "consistency", "cross_artifact")
def contradictions(kb: KnowledgeBase) -> DataFrame:
    """All three kinds of conflicting claims."""
    common = ["uri", "collector_id", "signal_type", "line", "discriminator"]
    return version_conflicts(kb).select(common).union(deprecation_conflicts(kb).select(common)).union(default_conflicts(kb).select(common))


@trait
def versions() -> Column:
    """array<struct<subject, version>>: the versions that a text asks for."""
    part = lambda m, g: F.regexp_extract(m, VERSION, g)
    may = F.col("has.versions") & F.col("all_text").rlike(r"\s\d+\.\d")  # the pattern is slow on other texts
    found = F.transform(F.regexp_extract_all("all_text", F.lit(VERSION), F.lit(0)), lambda m: F.struct(F.lower(part(m, 1)).alias("subject"), part(m, 2).alias("version")))
    return F.when(may, found)


def version_claims(parsed: DataFrame) -> DataFrame:
    """(uri, subject, version): the versions that documents ask for."""
    return _each(parsed, "versions").select("uri", "x.*")


def version_conflicts(kb: KnowledgeBase) -> DataFrame:
    """Claims of a version above the lowest that any document claims for the subject."""
    claims = version_claims(kb.traits)
    low = claims.groupBy("subject").agg(F.min(F.struct(version_order(F.col("version")).alias("o"), "version"))["version"].alias("lowest"))
    high = claims.join(low, "subject").where("version <> lowest").groupBy("uri", "subject").agg(F.max("version").alias("version"), F.max("lowest").alias("lowest"))
    return _found(high, "contradiction_detection", "version_conflict", subject=F.col("subject"), version=F.col("version"), lowest=F.col("lowest"))


def _contexts(text: Column, pattern: str, reach: int) -> Column:
    """array<array<string>>: the distinct words around each match."""
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(done: Column, r: Column) -> Column:
        start = done["at"] + F.length(r["gap"])
        stop = start + F.coalesce(F.length(r["match"]), F.lit(0))
        first = F.greatest(start - reach, F.lit(0))
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.substring(text, first + 1, stop + reach - first)), F.lit(r"\w+"), F.lit(0)))
        found = F.when(r["match"].isNotNull(), F.concat(done["found"], F.array(words))).otherwise(done["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("found"))
    return F.aggregate(rows, start, step, lambda done: done["found"])


def _word_pairs(pattern: str, gate: str, reach: int) -> Column:
    useful = lambda words: F.array_sort(F.filter(words, lambda w: ~w.isin(SMALL_WORDS)))
    pairs = lambda w: F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda b: F.concat_ws(" ", a, b))))
    ordered = F.transform(_contexts(F.col("all_text"), pattern, reach), useful)
    return F.when(F.col(f"has.{gate}") & F.col("all_text").rlike(pattern), F.array_distinct(F.flatten(F.transform(ordered, pairs))))


@trait
def advice() -> Column:
    """array<string>: pairs of words around what a text recommends."""
    return _word_pairs(RECOMMENDATION, "recommendation", 30)


@trait
def claims() -> Column:
    """array<string>: pairs of words around what a text calls deprecated."""
    return _word_pairs(DEPRECATION, "deprecation", 50)


def advice_pairs(parsed: DataFrame) -> DataFrame:
    """(uri, pair): pairs of words around what documents recommend."""
    return _each(parsed, "advice").select("uri", F.col("x").alias("pair"))


def claim_pairs(parsed: DataFrame) -> DataFrame:
    """(uri, pair): pairs of words around what documents call deprecated."""
    return _each(parsed, "claims").select("uri", F.col("x").alias("pair"))


def deprecation_conflicts(kb: KnowledgeBase) -> DataFrame:
    """Documents that call something deprecated in words of which another document's recommendation shares two.

    A context stands under each pair of its words. Of a pair's recommendations only the first and last document matter:
    one is enough, two tell whether it is another than the claim's own. So the work is that of one join on pairs with
    one row a pair on the right, however frequent a word is.
    """
    advice = advice_pairs(kb.traits).groupBy("pair").agg(F.min("uri").alias("first"), F.max("uri").alias("last"))
    hit = claim_pairs(kb.traits).join(advice, "pair").where("first <> uri or last <> uri")
    return _found(hit.select("uri").distinct(), "contradiction_detection", "deprecation_vs_recommendation")


@trait
def defaults() -> Column:
    """array<struct<feature, value>>: the defaults that a text states. The pattern is made of word characters and white space, so it is looked for only in those stretches of them that it can be in."""
    part = lambda m, g: F.regexp_extract(m, FEATURE, g)
    stretches = F.filter(F.split("all_text", r"[^\w\s]+", -1), lambda x: F.contains(F.lower(x), F.lit("by default")))
    found = F.flatten(F.transform(stretches, lambda x: F.regexp_extract_all(x, F.lit(FEATURE), F.lit(0))))
    rows = F.transform(found, lambda m: F.struct(F.lower(T.strip(part(m, 1))).alias("feature"), F.lower(part(m, 2)).isin("enabled", "on", "true").alias("value")))
    return F.when(F.col("has.defaults"), rows)


def default_claims(parsed: DataFrame) -> DataFrame:
    """(uri, feature, value): the defaults that documents state."""
    return _each(parsed, "defaults").select("uri", "x.*")


def default_conflicts(kb: KnowledgeBase) -> DataFrame:
    """Documents that state a default for a feature of which another value is stated too."""
    claims = default_claims(kb.traits)
    split = claims.groupBy("feature").agg(F.countDistinct("value").alias("n")).where("n > 1").select("feature")
    return _found(claims.join(split, "feature", "left_semi").select("uri", "feature").distinct(), "contradiction_detection", "boolean_default_conflict", feature=F.col("feature"))


@collector("canonical_source", "trust", "cross_artifact")
def canonical_source(kb: KnowledgeBase) -> DataFrame:
    common = ["uri", "collector_id", "signal_type", "line", "discriminator"]
    return missing_canonical(kb).select(common).union(duplicate_content(kb).select(common))


@trait
def lacking() -> Column:
    """array<struct<keyword, domain>>: the technologies that a text speaks of without a link to their own site."""
    linked = lambda d: F.exists("links", lambda x: ~x["is_internal"] & F.contains(x["target"], F.lit(d)))
    return F.array_compact(F.array(*[F.when(F.array_contains("has.technologies", k) & ~linked(d), F.struct(F.lit(k).alias("keyword"), F.lit(d).alias("domain"))) for k, d in CANONICAL.items()]))


def missing_canonical(kb: KnowledgeBase) -> DataFrame:
    """Documents that speak of a technology without a link to its own site."""
    found = _each(kb.traits, "lacking").select("uri", "x.keyword", "x.domain")
    mark = F.concat(F.lit("canonical_domain="), F.col("domain"), F.lit("|topic_keyword="), F.col("keyword"))
    return _found(found, "canonical_source", "missing_canonical_source", discriminator=mark, keyword=F.col("keyword"), domain=F.col("domain"))


@trait
def signature() -> Column:
    """The opening words of a text, if there are enough."""
    opening = F.lower(T.strip(F.regexp_replace(F.substring("all_text", 1, 200), r"\s+", " ")))
    return F.try_element_at(F.filter(F.array(opening), lambda x: F.length(x) > 50), F.lit(1))


def signatures(parsed: DataFrame) -> DataFrame:
    """(uri, signature): the opening words of documents, if there are enough."""
    return _trait(parsed, "signature").where("x is not null").select("uri", F.col("x").alias("signature"))


def duplicate_content(kb: KnowledgeBase) -> DataFrame:
    """Documents whose first 200 characters are another's too."""
    signed = signatures(kb.traits)
    shared = signed.groupBy("signature").agg(F.count("*").alias("copies")).where("copies > 1")
    return _found(signed.join(shared, "signature"), "canonical_source", "duplicate_content", copies=F.col("copies"))


def document_date() -> Column:
    """The first date that front matter or the first 2000 characters give."""
    formats = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
    of_key = lambda k: F.coalesce(*[F.try_to_timestamp(F.try_element_at("metadata", F.lit(k)), F.lit(f)) for f in formats]).cast("date")
    head = F.substring("all_text", 1, 2000)
    first = lambda pattern, use: F.element_at(F.transform(F.array(F.regexp_extract(head, pattern, 0)), use), 1)  # noqa: E731  the head is searched once, its match taken apart
    iso = first(ISO_DATE, lambda m: F.try_to_timestamp(F.concat_ws("-", *[F.regexp_extract(m, ISO_DATE, g) for g in (1, 2, 3)]), F.lit("yyyy-M-d")).cast("date"))
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(m, WRITTEN_DATE, 1), 1, 3)))
    named = first(WRITTEN_DATE, lambda m: F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(m, WRITTEN_DATE, 3), month(m), F.regexp_extract(m, WRITTEN_DATE, 2)), F.lit("yyyy-M-d")).cast("date"))
    return F.coalesce(*map(of_key, DATE_KEYS), F.when(head.rlike(r"20\d{2}"), F.coalesce(iso, named)))  # few texts name a year


@trait
def dated() -> Column:
    return document_date()


@collector("freshness", "trust")
def freshness(kb: KnowledgeBase, as_of: str = "2024-06-30", days: int = 365) -> DataFrame:
    """Documents without a date, or older than `days` on the day `as_of`."""
    aged = kb.traits.select("uri", "dated").withColumn("age_days", F.date_diff(F.lit(as_of).cast("date"), "dated"))
    kind = F.when(F.col("dated").isNull(), "no_date_signal").when(F.col("age_days") > days, "stale_content")
    return _found(aged.withColumn("kind", kind).where("kind is not null"), "freshness", F.col("kind"), age_days=F.col("age_days"))


@collector("knowledge_connectivity", "connectivity", "cross_artifact")
def orphan_artifacts(kb: KnowledgeBase) -> DataFrame:
    """Documents without inbound edges or links."""
    return _found(graph.in_degree(kb.artifacts, kb.edges, parse.links(kb.artifacts)).where("inbound = 0"), "knowledge_connectivity", "orphan_artifact")


@collector("link_integrity", "connectivity", "cross_artifact")
def link_integrity(kb: KnowledgeBase) -> DataFrame:
    common = ["uri", "collector_id", "signal_type", "line", "discriminator"]
    return broken_links(kb).select(common).union(orphan_documents(kb).select(common))


def broken_links(kb: KnowledgeBase) -> DataFrame:
    """One row a document with links that lead nowhere."""
    broken = kb.resolved.where("resolved is null")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]), " ")
    return _found(broken.groupBy("uri").agg(listed.alias("targets"), F.count("*").alias("n")), "link_integrity", "broken_link", targets=F.col("targets"), broken_link_count=F.col("n"))


def orphan_documents(kb: KnowledgeBase) -> DataFrame:
    found = graph.orphans(kb.artifacts, kb.resolved, kb.edges)
    return _found(found, "link_integrity", "orphan")


@trait
def missing() -> Column:
    """What a how-to guide lacks of prerequisites, numbered steps, a check and code; null if the document is none."""
    guide = F.col("has.guide") | T.any_of(F.lower("title"), WORKFLOW)
    steps = F.size(F.regexp_extract_all("all_text", F.lit(STEPS), F.lit(0)))
    parts = F.array_compact(F.array(
        F.when(~F.col("has.prerequisites"), "prerequisites"),
        F.when(steps < 2, "numbered_steps"),
        F.when(~F.col("has.verification"), "verification_step"),
        F.when(F.size("code_blocks") == 0, "code_examples"),
    ))
    return F.when(guide, F.array_join(parts, ","))


def guides(parsed: DataFrame) -> DataFrame:
    """(uri, missing) of the documents that are how-to guides."""
    return _trait(parsed, "missing").where("x is not null").select("uri", F.col("x").alias("missing"))


@collector("workflow_completeness", "workflow")
def incomplete_workflows(kb: KnowledgeBase) -> DataFrame:
    """How-to guides without prerequisites, numbered steps, a check or code."""
    return _found(guides(kb.traits).where("missing <> ''"), "workflow_completeness", "incomplete_workflow", missing=F.col("missing"))


def named(every: DataFrame) -> DataFrame:
    """Findings with signal_id and occurrence: see `signals`."""
    key = F.concat(F.concat_ws(":", "collector_id", "uri", "signal_type"), F.when(F.col("discriminator") != "", F.concat(F.lit(":"), F.col("discriminator"))).otherwise(""))
    marked = every.withColumn("signal_id", F.substring(F.sha2(key, 256), 1, 16))
    return marked.withColumn("occurrence", F.row_number().over(Window.partitionBy("signal_id").orderBy(F.col("line").asc_nulls_first())))


def signals(kb: KnowledgeBase, enabled: list[str] | None = None, as_of: str = "2024-06-30") -> DataFrame:
    """Findings of the enabled checks (all if none are named) with signal_id and occurrence.

    signal_id is the same for findings that share collector, document, type and discriminator; occurrence numbers them.
    """
    common = ["uri", "collector_id", "signal_type", "line", "discriminator"]
    parts = [f(kb, as_of=as_of) if name == "freshness" else f(kb) for name, (_, _, f) in sorted(REGISTRY.items()) if not enabled or name in enabled]
    every = reduce(DataFrame.union, [p.select(common) for p in parts])
    return named(every)
