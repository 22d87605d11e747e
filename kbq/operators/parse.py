"""From documents to structure: one row a document with nested parts, and long tables of the parts.

Everything is computed within a row, so parsing needs no shuffle whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbq.functions import text as T


def artifacts(docs: DataFrame) -> DataFrame:
    """docs(uri, text): artifact_id, uri, title, metadata, body, headings, sections, paragraphs, links, code_blocks, all_text, word_count. A null text is empty."""
    return completed(stored(docs))


def stored(docs: DataFrame) -> DataFrame:
    """artifacts() without the two columns that are its sections' texts once more; they need not be written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ext = T.extension(F.col("uri"))
    base = docs.select("uri", T.front_matter(text).alias("metadata"), T.body(text).alias("body")).withColumn("lines", F.split("body", "\n", -1))
    none = T.headings(F.array().cast("array<string>"))
    heads = F.when(ext.isin(T.MARKDOWN), T.headings(F.col("lines"))).when(ext == "rst", T.underlined_headings(F.col("lines"))).otherwise(none)
    parsed = base.withColumn("headings", heads).withColumn("sections", T.sections(F.col("lines"), F.col("headings")))
    title = F.coalesce(F.try_element_at("metadata", F.lit("title")), F.try_element_at("headings", F.lit(1))["text"], T.stem(F.col("uri")))
    words = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + T.word_count(s["text"]))
    return parsed.select(
        T.short_hash(F.col("uri")).alias("artifact_id"), "uri", title.alias("title"), "metadata", "body", "headings", "sections",
        T.links(F.col("lines")).alias("links"), T.code_blocks(F.col("body")).alias("code_blocks"), words.alias("word_count"),
    )


def compact(docs: DataFrame) -> DataFrame:
    """stored() with texts once: sections are cut out of the body by the headings' lines where a query asks for them."""
    return stored(docs).drop("sections")


def completed(kept: DataFrame) -> DataFrame:
    """artifacts() of what stored() or compact() gives: all_text and paragraphs are made of the sections where a query asks for them."""
    if "sections" not in kept.columns:
        kept = kept.withColumn("sections", T.sections(F.split("body", "\n", -1), F.col("headings")))
    all_text = F.array_join(F.transform("sections", lambda s: s["text"]), "\n\n")
    return kept.select(
        "artifact_id", "uri", "title", "metadata", "body", "headings", "sections", T.paragraphs(F.col("sections")).alias("paragraphs"), "links", "code_blocks",
        all_text.alias("all_text"), "word_count",
    )


def _long(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select("uri", F.posexplode(name).alias("pos", "x")).select("uri", "pos", "x.*")


def headings(parsed: DataFrame) -> DataFrame:
    return _long(parsed, "headings")


def sections(parsed: DataFrame) -> DataFrame:
    return _long(parsed, "sections")


def paragraphs(parsed: DataFrame) -> DataFrame:
    return _long(parsed, "paragraphs")


def links(parsed: DataFrame) -> DataFrame:
    return _long(parsed, "links")


def code_blocks(parsed: DataFrame) -> DataFrame:
    return _long(parsed, "code_blocks")


def metadata(parsed: DataFrame) -> DataFrame:
    """(uri, key, value) of front matter."""
    return parsed.select("uri", F.explode("metadata").alias("key", "value"))


def flat_text(parsed: DataFrame) -> DataFrame:
    """(uri, flat): title, headings and paragraphs, as embedded."""
    parts = F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), F.transform("headings", lambda h: h["text"]), F.transform("paragraphs", lambda p: p["text"]))
    return parsed.select("uri", F.array_join(parts, "\n\n").alias("flat"))


def link_fingerprints(parsed: DataFrame) -> DataFrame:
    """(uri, targets): the sorted set of internal link targets of each document."""
    inner = F.transform(F.filter("links", lambda x: x["is_internal"]), lambda x: x["target"])
    return parsed.select("uri", F.array_sort(F.array_distinct(inner)).alias("targets"))


def page_headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, text) of HTML headings."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", "pos", F.regexp_extract("h", "(?i)^<h([1-6])", 1).cast("int").alias("level"), T.strip(F.regexp_replace("h", "(?s)<[^>]*>", "")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, target) of anchors' addresses."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?i)<a href="([^"]*)"'), F.lit(1))).alias("pos", "target"))
