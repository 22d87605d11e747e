"""Problems made of findings, their salience, the queue, and fixes applied to whole document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.session import small, written

# Weights of severities and salience parts, half-lives in days, budget and step weights.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.7, "MEDIUM": 0.4, "LOW": 0.1}
PARTS = {"encoding": 0.40, "outcome": 0.25, "retrieval": 0.35}
HALF_LIVES = (21.0, 180.0)
BUDGET = 0.20
STEP_WEIGHTS = {
    "replace_document": 1.0,
    "rewrite_section": 0.3,
    "update_document": 0.15,
    "add_metadata": 0.05,
    "add_section": 0.1,
    "delete_section": 0.2,
    "rename": 0.05,
    "create_relationship": 0.05,
    "remove_relationship": 0.05,
    "add_cross_reference": 0.05,
    "add_cross_references": 0.05,
    "fix_broken_link": 0.15,
    "fix_broken_links": 0.15,
    "fix_dangling_reference": 0.15,
    "fix_dangling_references": 0.15,
    "rewrite_content": 0.15,
    "link_orphaned_document": 0.05,
    "link_orphaned_documents": 0.05,
    "implement_automated_link_checking": 0.05,
}
DEFAULT_STEP_WEIGHT = 0.1
DEFAULT_WEIGHT = 0.1
DANGLING_FIXES = [
    (r"see above", "see the referenced documentation"),
    (r"see below", "see the following documentation"),
    (r"see (?:the )?previous section", "see the referenced documentation"),
    (r"see (?:the )?next section", "see the following documentation"),
    (r"as (?:you will|you'll) see below", "as shown in the following example"),
    (r"as (?:you will|you'll) see above", "as shown in the previous example"),
    (r"as (?:mentioned|described|explained) above", "as described in the documentation"),
    (r"as (?:mentioned|described|explained) below", "as described in the documentation"),
    (r"as (?:you )?(?:read|saw) above", "as described earlier"),
    (r"as (?:you )?(?:read|saw) below", "as described in the following"),
    (r"as explained above", "as described in the documentation"),
    (r"as you saw in (?!\[)", "as described in "),
    (r"the (?:above|previous) (?:sections?|examples?|code)", "the referenced section"),
    (r"the (?:below|following|next) (?:sections?|examples?|code)", "the relevant section"),
    (r"as described in (?!\[)", "as described in the documentation. "),
]


def clusters(signals: DataFrame) -> DataFrame:
    """One problem for each check, kind and document: (collector_id, signal_type, uri, n, confidence)."""
    return signals.groupBy("collector_id", "signal_type", "uri").agg(F.count("*").alias("n")).withColumn("confidence", F.round(F.least(F.lit(0.3) + F.lit(0.1) * F.col("n"), F.lit(0.8)), 6))


def systemic(signals: DataFrame, least: int = 2) -> DataFrame:
    """Kinds of findings that at least `least` documents share."""
    return signals.groupBy("signal_type").agg(F.count("*").alias("signals"), F.countDistinct("uri").alias("documents")).where(F.col("documents") >= least)


def urgent(signals: DataFrame, least: int = 2) -> DataFrame:
    """Documents with at least `least` findings of high or critical severity."""
    hit = F.col("severity").isin("HIGH", "CRITICAL")
    return signals.where(hit).groupBy("uri").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def size_penalty(n: Column) -> Column:
    return 1 / (1 + F.log2(n))


def staleness(age_days: Column) -> Column:
    """1 for fresh problems, falling by two half-lives, never below 0.01."""
    short, long = HALF_LIVES
    return F.greatest(F.pow(F.lit(0.5), age_days / F.lit(short)) + F.lit(0.1) * F.pow(F.lit(0.5), age_days / F.lit(long)), F.lit(0.01))


def salience(problems: DataFrame, signals: DataFrame, dimensions: DataFrame, strategies: DataFrame | None = None, ages: DataFrame | None = None) -> DataFrame:
    """(collector_id, signal_type, uri, n, salience) of clusters.

    encoding: mean weight of the findings' severities (DEFAULT_WEIGHT for unlisted ones); outcome: 1 - the best known
    success rate for the kind (0.5 if unknown); retrieval: what the document's dimension lacks to 100. signals: uri,
    collector_id, signal_type, severity; dimensions: uri, collector_id, score; strategies: issue_type, rate; ages: uri,
    age_days since a finding of the document was last seen, of which the newest counts (fresh if there is none).
    """
    weights = F.create_map(*[F.lit(x) for p in SEVERITY_WEIGHTS.items() for x in p])
    weight = F.coalesce(F.element_at(weights, F.col("severity")), F.lit(DEFAULT_WEIGHT))
    keys = ["collector_id", "signal_type", "uri"]
    encoded = signals.groupBy(*keys).agg(F.avg(weight).alias("encoding"))
    joined = problems.join(encoded, keys).join(dimensions.select("uri", "collector_id", (1 - F.col("score") / 100).alias("retrieval")), ["uri", "collector_id"], "left")
    if strategies is None:
        joined = joined.withColumn("outcome", F.lit(0.5))
    else:
        best = strategies.groupBy(F.col("issue_type").alias("signal_type")).agg((1 - F.max("rate")).alias("outcome"))
        joined = joined.join(small(best), "signal_type", "left").withColumn("outcome", F.coalesce("outcome", F.lit(0.5)))
    if ages is None:
        joined = joined.withColumn("fresh", F.lit(1.0))
    else:
        newest = ages.groupBy("uri").agg(F.min("age_days").alias("age_days"))
        joined = joined.join(newest, "uri", "left").withColumn("fresh", F.coalesce(staleness(F.col("age_days")), F.lit(1.0)))
    total = F.lit(PARTS["encoding"]) * F.col("encoding") + F.lit(PARTS["outcome"]) * F.col("outcome") + F.lit(PARTS["retrieval"]) * F.coalesce("retrieval", F.lit(0.5))
    return joined.select(*keys, "n", F.round(total * size_penalty(F.col("n")) * F.col("fresh"), 6).alias("salience"))


def ranked_queue(ranked: DataFrame, threshold: float) -> DataFrame:
    """ranked with `kept` (at or above the threshold) beside the rest: the queue and its skip list."""
    return ranked.withColumn("kept", F.col("salience") >= threshold)


def upsert_queue(current: DataFrame, discovered: DataFrame, wont_fix: DataFrame | None = None) -> DataFrame:
    """The queue (problem_id, category, uris, salience, status) after a discovery (problem_id, category, uris, salience): open entries take the new salience, closed ones never reopen, new ones are open unless their signature is in wont_fix(signature)."""
    fresh = discovered if wont_fix is None else discovered.withColumn("signature", signature(F.col("category"), F.col("uris"))).join(wont_fix, "signature", "left_anti").drop("signature")
    new = fresh.select("problem_id", F.col("category").alias("new_category"), F.col("uris").alias("new_uris"), F.col("salience").alias("new_salience"))
    both = current.join(new, "problem_id", "full_outer")
    taken = F.col("new_salience").isNotNull() & F.coalesce(F.col("status") == "open", F.lit(True))
    return both.select("problem_id", F.coalesce("category", "new_category").alias("category"), F.coalesce("uris", "new_uris").alias("uris"), F.when(taken, F.col("new_salience")).otherwise(F.col("salience")).alias("salience"), F.coalesce("status", F.lit("open")).alias("status"))


def signature(category: Column, uris: Column) -> Column:
    """What a problem that is not to be fixed is known by: its category and sorted documents."""
    return F.concat_ws("|", category, F.array_join(F.array_sort(uris), "|"))


def queue(ranked: DataFrame, threshold: float, suppressed: DataFrame | None = None) -> DataFrame:
    """Problems at or above the threshold, without those marked wont_fix (collector_id, uri)."""
    kept = ranked.where(F.col("salience") >= threshold)
    return kept if suppressed is None else kept.join(suppressed, ["collector_id", "uri"], "left_anti")


def root_causes(problems: DataFrame) -> DataFrame:
    """problems (problem_id, uri, signal_type, category, evidence array<string>) with pattern and cluster.

    Each problem joins the first that applies: its folder (two problems or more), its kind (two documents or more), the
    first of its evidence strings that two problems share, its category (two or more left), else it stands alone.
    """
    flag = lambda df, key, name: df.select(key, F.lit(True).alias(name))
    base = problems.withColumn("folder", T.directory(F.col("uri")))
    folders = base.where("folder <> ''").groupBy("folder").count().where("count >= 2")
    first = base.join(flag(folders, "folder", "by_folder"), "folder", "left").withColumn("pattern", F.when(F.col("by_folder"), "directory"))
    kinds = first.where("pattern is null").groupBy("signal_type").agg(F.countDistinct("uri").alias("d")).where("d >= 2")
    second = first.join(flag(kinds, "signal_type", "by_kind"), "signal_type", "left").withColumn("pattern", F.coalesce("pattern", F.when(F.col("by_kind"), "systemic_type")))
    refs = second.where("pattern is null").select("problem_id", F.explode(F.array_distinct("evidence")).alias("ref"))
    shared = refs.join(refs.groupBy("ref").count().where("count >= 2").select("ref"), "ref").groupBy("problem_id").agg(F.min("ref").alias("ref"))
    third = second.join(shared, "problem_id", "left").withColumn("pattern", F.coalesce("pattern", F.when(F.col("ref").isNotNull(), "shared_evidence")))
    left = third.where("pattern is null").groupBy("category").count().where("count >= 2")
    last = third.join(flag(left, "category", "by_category"), "category", "left").withColumn("pattern", F.coalesce("pattern", F.when(F.col("by_category"), "category"), F.lit("singleton")))
    key = F.when(F.col("pattern") == "directory", F.col("folder")).when(F.col("pattern") == "systemic_type", F.col("signal_type")).when(F.col("pattern") == "shared_evidence", F.col("ref")).when(F.col("pattern") == "category", F.col("category")).otherwise(F.col("problem_id"))
    return last.select("problem_id", "uri", "pattern", key.alias("cluster"))


def evidence_refs(text: Column) -> Column:
    """array<string>: quoted strings of more than two characters in a finding's description."""
    return F.regexp_extract_all(text, F.lit(r"""["']([^"']{3,})["']"""), F.lit(1))


def synthesis(clustered: DataFrame, ranked: DataFrame) -> DataFrame:
    """(cluster, pattern, problems, documents, salience, strategy): one proposal a root-cause cluster, from root_causes' rows and salience (problem_id, salience); a cluster is as salient as its most salient problem."""
    strategy = F.when(F.col("pattern") == "singleton", "fix_document").when(F.col("pattern") == "directory", "fix_folder").otherwise("fix_systemic")
    per = clustered.join(ranked, "problem_id").groupBy("pattern", "cluster").agg(F.count("*").alias("problems"), F.countDistinct("uri").alias("documents"), F.max("salience").alias("salience"))
    return per.withColumn("strategy", strategy)


def systemic_steps(clustered: DataFrame, ranked: DataFrame, tried: list[str] | None = None) -> DataFrame:
    """(cluster, pattern, strategy, salience, proposed, uri, step_type, description): a step for each document of each root-cause cluster.

    clustered: root_causes' rows; ranked: (problem_id, salience); tried: strategies that failed before, of whose patterns a
    second version is proposed. `proposed` marks the most salient cluster (of equals the first by pattern and cluster), the
    one that is to be fixed next. Documents of problems without a salience have no step.
    """
    name = F.concat(F.lit("systemic_"), F.col("pattern"))
    strategy = F.when(name.isin(list(tried or [])), F.concat(name, F.lit("_v2"))).otherwise(name)
    salient = clustered.join(ranked.select("problem_id", "salience"), "problem_id")
    per = salient.groupBy("pattern", "cluster").agg(F.max("salience").alias("salience"))
    best = per.agg(F.min(F.struct((-F.col("salience")).alias("s"), "pattern", "cluster")).alias("best"))
    told = F.concat(F.lit("Address "), F.col("pattern"), F.lit(" pattern: "), F.substring("cluster", 1, 100))
    proposals = per.crossJoin(F.broadcast(best)).withColumn("proposed", (F.col("best.pattern") == F.col("pattern")) & (F.col("best.cluster") == F.col("cluster"))).drop("best")  # one row
    documents = salient.select("pattern", "cluster", "uri").distinct()
    return documents.join(proposals, ["pattern", "cluster"]).select("cluster", "pattern", strategy.alias("strategy"), "salience", "proposed", "uri", F.lit("update_document").alias("step_type"), told.alias("description"))


def basic_proposals(hypotheses: DataFrame, tried: DataFrame) -> DataFrame:
    """(run_id, strategy, causes): what to propose for a run when nothing is known but its hypotheses.

    hypotheses: (run_id, idx, category), in order of idx; tried: (run_id, strategy). The first cause's category is
    addressed, unless it is missing, empty or was tried under that name: then someone has to look (`manual_review`).
    """
    first = hypotheses.groupBy("run_id").agg(F.count("*").alias("causes"), F.min_by("category", "idx").alias("category"))
    known = tried.select("run_id", F.col("strategy").alias("category")).distinct().withColumn("known", F.lit(True))
    manual = F.col("known").isNotNull() | (F.coalesce("category", F.lit("")) == "")
    return first.join(known, ["run_id", "category"], "left").select("run_id", F.when(manual, "manual_review").otherwise(F.concat(F.lit("address_"), F.col("category"))).alias("strategy"), "causes")


def hypothesis_problems(hypotheses: DataFrame) -> DataFrame:
    """(run_id, problem_id, category, description, evidence_summary, uri): each hypothesis (run_id, idx, category, hypothesis, evidence array<string>, uris array<string>) as a problem, a row for each of its documents (one with a null uri if it names none)."""
    category = F.when(F.coalesce("category", F.lit("")) == "", "unknown").otherwise(F.col("category"))
    rows = hypotheses.withColumn("category", category).withColumn("uri", F.explode_outer("uris"))
    return rows.select("run_id", F.concat_ws("_", F.lit("kp"), "category", F.col("idx").cast("string")).alias("problem_id"), "category", F.col("hypothesis").alias("description"), F.array_join("evidence", "; ").alias("evidence_summary"), "uri")


#: Further rules by name: functions of findings and the corpus's score that give (rule, fires).
CUSTOM_RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def cross_check(name: str):
    """Register a rule of one's own, which cross_checks then runs too."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        CUSTOM_RULES[name] = f
        return f

    return add


def cross_checks(signals: DataFrame, score: DataFrame) -> DataFrame:
    """(rule, fires): five rules over the counts of findings and over documents that have two kinds at once. score: one row with the corpus's `connectivity`."""
    n = lambda kind: F.count_if(F.col("signal_type") == kind)
    heads = F.col("collector_id") == "heading_quality"
    per = signals.groupBy("uri").agg(
        (F.max(heads) & F.max(F.col("signal_type") == "mixed_topics")).alias("retrieval"),
        (F.max(F.col("signal_type") == "dangling_reference") & F.max(F.col("signal_type") == "orphan_artifact")).alias("context"),
        *[n(k).alias(k) for k in ("broken_link", "orphan", "stale_content", "terminology_variant")],
        F.count_if(F.col("collector_id") == "contradiction_detection").alias("contradiction"),
    )
    one = per.agg(*[F.sum(c).alias(c) for c in ("broken_link", "orphan", "stale_content", "terminology_variant", "contradiction")], F.coalesce(F.max("retrieval"), F.lit(False)).alias("retrieval"), F.coalesce(F.max("context"), F.lit(False)).alias("context"))
    rules = {
        "navigation_collapse": (F.col("broken_link") >= 2) & (F.col("orphan") >= 1) & (F.col("connectivity") < 50),
        "stale_kb_collapse": (F.col("stale_content") >= 2) & (F.col("orphan") >= 2),
        "retrieval_breakdown": F.col("retrieval"),
        "context_fragmentation": F.col("context"),
        "terminology_contradiction": (F.col("terminology_variant") >= 2) & (F.col("contradiction") >= 1),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("fires")) for k, c in rules.items()])
    found = one.crossJoin(F.broadcast(score.select("connectivity"))).select(F.explode(rows).alias("r")).select("r.*")  # one row each
    for rule in CUSTOM_RULES.values():
        found = found.unionByName(rule(signals, score).select("rule", "fires"))
    return found


def steps(signals: DataFrame) -> DataFrame:
    """One step a document, the cheapest fix it needs: a date, then a link, then a source."""
    order = F.when(F.col("signal_type") == "no_date_signal", 0).when(F.col("signal_type") == "orphan_artifact", 1).when(F.col("signal_type") == "missing_canonical_source", 2)
    ranked = signals.withColumn("priority", order).where("priority is not null")
    w = Window.partitionBy("uri").orderBy("priority", "discriminator")
    return ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select("uri", "signal_type", "discriminator", "priority")


def within_budget(planned: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(uri, delta, accepted) of planned steps (uri, step_type): the share of each document that its steps change by their weights, 1 at most."""
    weights = F.create_map(*[F.lit(x) for pair in STEP_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.element_at(weights, F.col("step_type")), F.lit(DEFAULT_STEP_WEIGHT))
    return planned.groupBy("uri").agg(F.round(F.least(F.lit(1.0), F.sum(weight)), 6).alias("delta")).withColumn("accepted", F.col("delta") <= budget)


def changed_share(texts: DataFrame) -> DataFrame:
    """(uri, delta) of texts (uri, before, after): edit distance over the longer length, where both texts are known."""
    longer = F.greatest(F.length("before"), F.length("after"))
    return texts.where("before is not null and after is not null").select("uri", F.when(longer == 0, 0.0).otherwise(F.round(F.levenshtein("before", "after") / longer, 6)).alias("delta"))


def set_metadata(docs: DataFrame, key: str, value: Column, title: Column) -> DataFrame:
    """docs(uri, text) with the key in the front matter: replaced where it stands, added to a block, or in a new block with a title."""
    block = F.col("text").rlike(T.FRONT_MATTER)
    line = F.concat(F.lit(f"{key}: "), value)
    has = T.front_matter(F.col("text")).getItem(key).isNotNull()
    swapped = F.regexp_replace(F.col("text"), F.lit(rf"(?m)\A((?s:.*?)^){key}:[^\n]*$"), F.concat(F.lit("$1"), line))
    added = F.concat(F.lit("---\n"), line, F.lit("\n"), F.regexp_replace("text", r"\A---\s*\n", ""))
    fresh = F.concat(F.lit("---\ntitle: "), title, F.lit("\n"), line, F.lit("\n---\n"), F.col("text"))
    return docs.withColumn("text", F.when(block & has, swapped).when(block, added).otherwise(fresh))


def fix_references(docs: DataFrame) -> DataFrame:
    """docs with phrases that point outside their paragraph rewritten, in order and in any case of letters."""
    text = F.col("text")
    for phrase, plain in DANGLING_FIXES:
        text = F.regexp_replace(text, f"(?i){phrase}", plain)
    return docs.withColumn("text", text)


def add_canonical(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs with links to the sites in wanted(uri, domain) put after the first top heading, unless there already."""
    per = wanted.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_set("domain")), lambda d: F.concat(F.lit("["), d, F.lit("](https://"), d, F.lit(")"))), " ").alias("links"))
    joined = docs.join(per, "uri", "left")
    after = F.regexp_replace(F.col("text"), F.lit(r"\A((?s:.*?))(?m:^(# [^\n]*)$)"), F.concat(F.lit("$1$2\n\n"), F.col("links")))
    placed = F.when(F.col("text").rlike(r"(?m)^# "), after).otherwise(F.concat("links", F.lit("\n\n"), "text"))
    return joined.withColumn("text", F.when(F.col("links").isNotNull(), placed).otherwise(F.col("text"))).drop("links")


def unlink(docs: DataFrame, broken: DataFrame) -> DataFrame:
    """docs in which links to the targets in broken(uri, text, target) are their text alone."""
    per = broken.groupBy("uri").agg(F.collect_set(F.struct("text", "target")).alias("gone"))
    joined = docs.join(per, "uri", "left")
    mended = F.aggregate(F.coalesce("gone", F.array().cast("array<struct<text:string,target:string>>")), F.col("text"), lambda t, g: F.replace(t, F.concat(F.lit("["), g["text"], F.lit("]("), g["target"], F.lit(")")), g["text"]))
    return joined.withColumn("text", mended).drop("gone")


def verify(problems: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(problem_id, outcome) of problems (problem_id, signal_id): resolved, partially_resolved, unchanged or regressed."""
    marks = lambda df, name: df.select("signal_id").distinct().withColumn(name, F.lit(1))
    joined = problems.join(marks(before, "was"), "signal_id", "left").join(marks(after, "still"), "signal_id", "left")
    per = joined.groupBy("problem_id").agg(F.count("was").alias("was"), F.count("still").alias("still"))
    return per.withColumn("outcome", F.when(F.col("still") == 0, "resolved").when(F.col("still") < F.col("was"), "partially_resolved").when(F.col("still") == F.col("was"), "unchanged").otherwise("regressed"))


def verify_problems(problems: DataFrame, ids: DataFrame, places: DataFrame, kinds: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(problem_id, was, remaining, new, outcome) by the findings of two runs (signal_id, signal_type, uri).

    A problem is judged by its findings' ids(problem_id, signal_id); one none of whose ids was there before is judged by
    the kinds of its category (kinds: category, signal_type) on its places(problem_id, uri), if any were there before.
    """
    both = before.select("signal_id", "signal_type", "uri", F.lit(1).alias("was"), F.lit(0).alias("still")).unionByName(after.select("signal_id", "signal_type", "uri", F.lit(0).alias("was"), F.lit(1).alias("still")))
    flags = written(both.groupBy("signal_id", "signal_type", "uri").agg(F.max("was").alias("was"), F.max("still").alias("still")), "flags")  # read for ids and for kinds
    count = lambda name: [F.sum("was").alias(f"was{name}"), F.sum(F.col("was") * F.col("still")).alias(f"remaining{name}"), F.sum((1 - F.col("was")) * F.col("still")).alias(f"new{name}")]
    known = flags.groupBy("signal_id").agg(F.max("was").alias("was"), F.max("still").alias("still"))
    by_id = written(ids.distinct().join(known, "signal_id").groupBy("problem_id").agg(*count("")), "by-id")
    asked = problems.join(by_id.where("was > 0"), "problem_id", "left_anti").join(F.broadcast(kinds), "category").join(places, "problem_id").select("problem_id", "signal_type", "uri").distinct()
    by_kind = asked.join(flags, ["signal_type", "uri"]).groupBy("problem_id").agg(*count("_k"))
    per = problems.select("problem_id").join(by_id, "problem_id", "left").join(by_kind, "problem_id", "left").fillna(0)
    pick = lambda c: F.when((F.col("was") == 0) & (F.col("was_k") > 0), F.col(f"{c}_k")).otherwise(F.col(c)).alias(c)
    counts = per.select("problem_id", *map(pick, ("was", "remaining", "new")))
    outcome = (
        F.when(F.col("was") == 0, "misdiagnosed").when((F.col("remaining") == 0) & (F.col("new") == 0), "resolved").when(F.col("remaining") < F.col("was"), "partially_resolved")
        .when(F.col("new") > 0, "regressed").otherwise("unchanged")
    )
    return counts.withColumn("outcome", outcome)


def overall_outcome(verified: DataFrame, by: list[str], score_step: Column) -> DataFrame:
    """(key..., outcome) of verify_problems' rows with a key: all resolved; any regressed; misdiagnosed only, without a better score; any progress or a better score; else unchanged."""
    is_ = lambda kind: F.col("outcome") == kind
    per = verified.groupBy(*by).agg(F.bool_and(is_("resolved")).alias("all"), F.bool_or(is_("regressed")).alias("worse"), F.bool_or(is_("misdiagnosed")).alias("wrong"), F.bool_or(is_("resolved") | is_("partially_resolved")).alias("some"), F.max(score_step).alias("step"))
    found = F.when(F.col("all"), "resolved").when(F.col("worse"), "regressed").when(F.col("wrong") & ~F.col("some") & (F.col("step") <= 0), "misdiagnosed").when(F.col("some") | (F.col("step") > 0), "partially_resolved").otherwise("unchanged")
    return per.select(*by, found.alias("outcome"))


def pick(queue: DataFrame, n: int, status: str | None = None, category: str | None = None, least: float = 0.0) -> DataFrame:
    """The n most salient problems (problem_id, category, status, salience) of a status and category, from `least` on: a report."""
    kept = queue.where(F.col("salience") >= least)
    if status is not None:
        kept = kept.where(F.col("status") == status)
    if category is not None:
        kept = kept.where(F.col("category") == category)
    return kept.orderBy(F.desc("salience"), "problem_id").limit(n)
