"""Checks of a result by other means than the scores: links and headings read anew, hierarchy, and whole corpora before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.operators import graph
from kbq.session import written

#: Bytes that the lists of hubs may have and still be sent to every executor.
LIST_BYTES = 64 << 20


def plain_links(docs: DataFrame) -> DataFrame:
    """(uri, pos, text, target) of links outside of code and images, read from docs(uri, text) by patterns alone."""
    text = F.coalesce("text", F.lit(""))
    for gone in (r"```[\s\S]*?```", r"`[^`]+`", r"!\[[^\]]*\]\([^)]+\)"):
        text = F.regexp_replace(text, gone, "")
    pattern = F.lit(r"\[([^\]]+)\]\(([^)]+)\)")
    pairs = docs.select("uri", F.array(text).alias("t")).select("uri", F.posexplode(F.flatten(F.transform("t", lambda t: F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("text"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("target"))))).alias("pos", "x"))
    return pairs.select("uri", "pos", "x.text", "x.target")


def plain_headings(docs: DataFrame) -> DataFrame:
    """(uri, pos, level, text) of ATX headings, found in the whole text at once, front matter included."""
    whole = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^(#{1,6})[ \t]+([^\n]+)$"), F.lit(0))
    rows = docs.select("uri", F.posexplode(whole).alias("pos", "h"))
    return rows.select("uri", "pos", F.length(F.regexp_extract("h", "^(#+)", 1)).alias("level"), T.strip(F.regexp_replace("h", "^#+", "")).alias("text"))


def plain_metadata(docs: DataFrame) -> DataFrame:
    """(uri, key) of front-matter lines that begin with a word and a colon."""
    lines = F.split(F.regexp_extract(F.coalesce("text", F.lit("")), T.FRONT_MATTER, 1), "\n")
    return docs.select("uri", F.explode(F.filter(lines, lambda x: x.rlike(r"^\w+:"))).alias("line")).select("uri", F.regexp_extract("line", r"^(\w+):", 1).alias("key")).distinct()


def hierarchy(headings: DataFrame) -> DataFrame:
    """(uri, pos, issue) of headings (uri, pos, level, text): `jump` where a level skips one below the heading before, `duplicate` where the document has the text already."""
    w = Window.partitionBy("uri").orderBy("pos")
    marked = headings.withColumn("before", F.lag("level").over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("uri", "text").orderBy("pos")))
    issues = F.array_compact(F.array(F.when(F.col("level") > F.col("before") + 1, "jump"), F.when(F.col("nth") > 1, "duplicate")))
    return marked.select("uri", "pos", F.explode(issues).alias("issue"))


def validate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, before, after, effect): what docs(uri, text) of two corpora show by themselves: links to nowhere, heading issues, documents with front matter, documents that nothing links to; and `overall`, which is improved or degraded where more measures are."""

    def measures(docs: DataFrame, name: str) -> DataFrame:
        resolved = graph.resolve(plain_links(docs).withColumn("line", F.lit(0)).withColumn("is_internal", ~F.col("target").rlike("^(https?:|#|mailto:)")), docs)
        one = lambda df, measure: df.agg(F.count("*").alias(name)).select(F.lit(measure).alias("measure"), name)
        linked = resolved.where("resolved is not null and resolved <> uri").select(F.col("resolved").alias("uri")).distinct()
        return one(resolved.where("resolved is null"), "broken_links").union(one(hierarchy(plain_headings(docs)), "heading_issues")).union(one(plain_metadata(docs).select("uri").distinct(), "with_metadata")).union(one(docs.select("uri").join(linked, "uri", "left_anti"), "unreferenced"))

    both = measures(before, "before").join(measures(after, "after"), "measure")
    better = F.when(F.col("measure") == "with_metadata", F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    judged = both.withColumn("effect", F.when(better > 0, "improved").when(better < 0, "degraded").otherwise("neutral"))
    up, down = F.count_if(F.col("effect") == "improved"), F.count_if(F.col("effect") == "degraded")
    overall = judged.agg(F.when(up > down, "improved").when(down > up, "degraded").otherwise("neutral").alias("effect"))
    return judged.unionByName(overall.select(F.lit("overall").alias("measure"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"), "effect"))


def roll_back(before: DataFrame, after: DataFrame, scores: DataFrame) -> DataFrame:
    """(uri, text): after's texts, but before's where scores (uri, score_before, score_after) fell."""
    fell = scores.where("score_after < score_before").select("uri")
    return after.join(fell, "uri", "left_anti").select("uri", "text").unionByName(before.join(fell, "uri", "left_semi").select("uri", "text"))


def title_words(title: Column, stopwords: list[str]) -> Column:
    """array<string>: distinct words of three letters and more in small letters, without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(stopwords)))


def link_from_hub(docs: DataFrame, orphans: DataFrame, hub: str, titles: DataFrame, stopwords: list[str]) -> DataFrame:
    """docs(uri, text) in which the hub's text ends with a list of links to orphans (uri) whose titles (uri, title) share a word with the hub's; the list is one document's text."""
    return link_from_hubs(docs, orphans, titles.where(F.col("uri") == hub).select("uri"), titles, stopwords)


def link_from_hubs(docs: DataFrame, orphans: DataFrame, hubs: DataFrame, titles: DataFrame, stopwords: list[str]) -> DataFrame:
    """docs(uri, text) in which the text of every hub of hubs(uri) ends with a list of links to orphans(uri) whose titles (uri, title) share a word with its own.

    Hubs whose titles have the same words have the same list, so a list is made once for each set of words (and for each hub
    that is an orphan itself, which is not in its own list), by an inverted index of the orphans' titles. Texts meet their
    list last: what is shuffled are lists and texts, not a list a hub.
    """
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("uri"), F.lit(")"))
    lost = titles.join(orphans.select("uri").distinct(), "uri", "left_semi").select(F.col("uri").alias("orphan"), line.alias("line"), F.explode(title_words(F.col("title"), stopwords)).alias("word"))
    own = orphans.select("uri").distinct().withColumn("own", F.col("uri"))
    asked = titles.join(hubs.select("uri"), "uri", "left_semi").join(own, "uri", "left").select("uri", F.to_json(F.struct(F.array_sort(F.array_distinct(title_words(F.col("title"), stopwords))).alias("words"), "own")).alias("kind"), "own", title_words(F.col("title"), stopwords).alias("words"))
    kinds = asked.dropDuplicates(["kind"]).select("kind", "own", F.explode("words").alias("word"))
    met = kinds.join(lost, "word").where("own is null or orphan <> own").select("kind", "orphan", "line").distinct()
    lists = written(met.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("list")), "lists")
    added = F.when(F.col("list").isNotNull(), F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit("\n\n## Additional Resources\n\n"), F.col("list"), F.lit("\n"))).otherwise(F.col("text"))
    placed = docs.join(asked.select("uri", "kind"), "uri", "left")
    if (lists.agg(F.sum(F.octet_length("list"))).first()[0] or 0) <= LIST_BYTES:
        return placed.join(F.broadcast(lists), "kind", "left").select("uri", added.alias("text"))  # measured
    return placed.where("kind is not null").join(lists, "kind", "left").select("uri", added.alias("text")).unionByName(placed.where("kind is null").select("uri", "text"))


def create_missing(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs(uri, text) with the documents of wanted(uri, text) that are not there yet, one of each uri."""
    return docs.select("uri", "text").unionByName(wanted.join(docs.select("uri"), "uri", "left_anti").groupBy("uri").agg(F.min("text").alias("text")))
