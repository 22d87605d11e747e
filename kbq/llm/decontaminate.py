"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

The index stores a posting (row, position, term) for every place in the training texts at which a term of the
benchmark stands. A window of a test item is looked up from its rarest terms: the postings of the rarest one, moved
back by its offset, are the candidate places; they are intersected with the second rarest's, and the survivors with
those of all terms. slop = 0 gives exact phrases; slop > 0 also gives places where every term stands within `slop`
words of its position in the phrase (proximity matches).

Words are runs of letters a-z, digits and code points from 0x80 on, after A-Z are lower-cased. A window is `width`
consecutive words of one item, or the whole of a shorter item. Null texts have no words; null item ids count as the
empty string, items with the same id as one. Every row of docs gives a row, also repeated ones and those with a null
doc_id. Empty tables: no documents give no rows, no items give zero hits. Texts of any length are indexed whole. Other columns are ignored; clean() carries them. The benchmark is
broadcast only if its terms or windows are counted to be few; otherwise Spark shuffles.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbq.llm.common import free_name, materialise, small

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of each text, as a term of its own: its posting tells how many words the row has.
_END = "\n"


def words(text: Column) -> Column:
    """The text's words in order, with an empty string before or after them where the text begins or ends with other characters."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(lowered, _NOT_WORD)


def windows(items: DataFrame, width: int = 13) -> tuple[DataFrame, DataFrame]:
    """(window, offset, term) slots of the distinct windows, and (window, item_id)."""
    found = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.filter(words(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    every = found.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("w"))
    owners = every.groupBy("w").agg(F.collect_set("item_id").alias("items"))
    numbered = materialise(owners.select(F.monotonically_increasing_id().alias("window"), "w", "items"), "windows")
    slots = numbered.select("window", F.posexplode("w").alias("offset", "term"))
    return slots, numbered.select("window", F.explode("items").alias("item_id"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (row, doc_id, tie, term_id, position, n_words). term_id -1 marks the end of a row's words and carries doc_id, n_words and a hash of the text (tie); row is a number of the stored table."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), words(F.col("text")).alias("w"))
    empty = (F.element_at("w", 1) == "").cast("int") + ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    ended = split.select("row", "doc_id", "tie", (F.size("w") - empty).cast("long").alias("n"), F.concat("w", F.array(F.lit(_END))).alias("w"))
    places = ended.select("row", "doc_id", "tie", "n", F.posexplode("w").alias("position", "term"))
    known = terms.union(terms.sparkSession.range(1).select(F.lit(_END), F.lit(-1).cast("long")))
    postings = places.join(small(known), "term")
    at_end = lambda c: F.when(F.col("term_id") == -1, F.col(c))
    return materialise(postings.select("row", at_end("doc_id").alias("doc_id"), at_end("tie").alias("tie"), "term_id", "position", at_end("n").alias("n_words")), "postings")


def find(postings: DataFrame, slots: DataFrame, slop: int = 0) -> DataFrame:
    """(row, window, start, length): places of the windows in the indexed rows. slots: (window, offset, term_id)."""
    real = postings.where("term_id >= 0").select("row", "position", "term_id")
    counts = small(materialise(real.groupBy("term_id").count(), "term-counts"))  # one row a benchmark term
    by_rarity = Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "term_id", "offset")
    ranked = slots.join(counts, "term_id", "left").withColumn("rank", F.row_number().over(by_rarity)).withColumn("length", F.count("*").over(Window.partitionBy("window")))
    ranked = materialise(ranked.select("window", "offset", "term_id", "rank", "length"), "ranked")

    first = small(ranked.where("rank = 1").select("term_id", "window", "length", F.col("offset").alias("anchor")))
    candidates = real.join(first, "term_id").select("row", "window", "length", (F.col("position") - F.col("anchor")).alias("start"))
    second = ranked.where("rank = 2").select("window", F.col("term_id").alias("next_id"), F.col("offset").alias("next_offset"))
    wanted = candidates.join(small(second), "window", "left").withColumn("at", F.col("start") + F.col("next_offset"))
    near = F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)) if slop else F.col("at")
    rarest_two = real.join(small(second.select(F.col("next_id").alias("term_id")).distinct()), "term_id", "left_semi")
    of_one = wanted.where("next_id is null").select("row", "window", "length", "start")
    of_two = wanted.where("next_id is not null").withColumn("place", near).join(rarest_two.select("row", F.col("position").alias("place"), F.col("term_id").alias("next_id")), ["row", "place", "next_id"], "left_semi")
    survivors = materialise(of_one.union(of_two.select("row", "window", "length", "start")).distinct(), "survivors")

    rows = small(survivors.select("row").distinct(), 1_000_000)
    held = real.join(rows, "row", "left_semi")
    slot_of = ranked.select("window", "offset", F.col("term_id"))
    asked = survivors.join(small(slot_of), "window").withColumn("at", F.col("start") + F.col("offset"))
    asked = asked.withColumn("position", F.explode(F.sequence(F.col("at") - slop, F.col("at") + slop)) if slop else F.col("at"))
    met = asked.join(held, ["row", "position", "term_id"], "left_semi")
    whole = met.groupBy("row", "window", "start", "length").agg(F.countDistinct("offset").alias("met") if slop else F.count("*").alias("met"))
    return whole.where("met = length").select("row", "window", "start", "length")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, tie): a row for each row of docs; tie is a hash of the text.

    A document is contaminated if `share` * n_hit >= n_words and n_hit > 0.
    """
    slots, owners = windows(items, width)
    term_ids = materialise(slots.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    postings = index(docs, term_ids)
    hits = materialise(find(postings, slots.join(term_ids, "term").select("window", "offset", "term_id")), "hits")
    order = Window.partitionBy("row").orderBy("start")
    runs = hits.groupBy("row", "start").agg((F.col("start") + F.max("length")).alias("stop"))
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = runs.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(-1))))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    held = hits.select("row", "window").distinct().join(small(owners), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    ends = postings.where("term_id = -1").select("row", "doc_id", "tie", "n_words")
    out = ends.join(covered.join(held, "row"), "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.select("doc_id", "tie", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """docs without contaminated rows; equal texts have equal verdicts, so rows are dropped by their text's hash."""
    tie = free_name(docs, "tie")
    bad = contaminated(docs, items, width, share).where("contaminated").select(F.col("tie").alias(tie)).distinct()
    return docs.join(small(materialise(bad, "contaminated")), F.xxhash64(F.col("text").cast("string")) == F.col(tie), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tie")


ORACLE_SQL = {
    "op3_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
k AS (SELECT DISTINCT item, array_to_string(ws[i:i+12], ' ') AS k, least(len(ws), 13) AS n FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS k FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(i)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN k ON p.k = k.k AND p.n = k.n),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) AS s(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
}
