"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a text and a cutoff beyond which the text is rejected. Cutoffs are not guessed. The labelled
documents of a stratum that the base rules keep are dealt in two by a hash of their text:

1. On a quarter of them, cutoffs are proposed: for every rule the one that catches most bad documents, where each good
   one lost counts as `cost` bad ones and no more than `risk` shared out over the rules may be lost. Rules are ranked by
   what they gain.
2. On the others, the holdout, the union of the first rule, of the first two, and so on is certified: it is taken while
   the exact (Clopper-Pearson) upper bound on the share of good documents that any of its rules rejects is at most
   `risk`. The tests go in that fixed order and stop at the first failure, so they need no further correction within a
   stratum; `delta` is shared out over the strata (Bonferroni).

So with probability 1 - delta, in no stratum do the learned rules together reject more than `risk` of the good
documents. The base rules are given and stand outside of that bound. A stratum without enough labels to certify any
rule has no learned rule.

Words are runs of characters other than space and \\t to \\r. Null and empty texts have no words and fail the base
rules. Labels that are null, or for unknown documents, are not used. Copies of a text are one trial, good if any label
says so. A null stratum is a stratum of its own; any number of strata may be given. Texts of any length are read whole.
Repeated rows get equal results. Empty tables give empty results. Columns of docs other than doc_id, text, the stratum
and those in `carry` are ignored; carried ones may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbq.llm.common import ascii_words, bounded_batches, column, materialise, slices, small, tidy

#: Statistics that the learned rules bound from above, and the step of each one's grid of cutoffs.
RULES = {
    "symbol_ratio": 0.05,  # characters of #*$%&|<> per word
    "mean_word_chars": 0.25,
    "shout_ratio": 0.02,  # share of words with two or more capitals and no small letter (A-Z, a-z)
    "exclaim_ratio": 0.05,  # ! per word
    "dup_line_ratio": 0.02,  # share of lines with a word that repeat an earlier one
    "repeat_word_ratio": 0.02,  # share of words in repeated 5-word windows
    "same_word_ratio": 0.02,  # 1 - distinct words / words, of texts of 50 words and more
}
_RUN = 5


def repeat_words(index: np.ndarray, n_distinct: int, offsets: np.ndarray, run: int = _RUN) -> np.ndarray:
    """For each text the words that lie in a window of `run` words found twice or more in it. Exact: windows are compared by rank, doubled up from single words."""
    n_texts = len(offsets) - 1
    at = np.arange(len(index))
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    rank, width = index.astype(np.int64), 1
    while width < run:  # rank of runs of `width` words -> of min(2 * width, run) words
        step = min(width, run - width)
        pair = rank[: len(rank) - step] * np.int64(max(n_distinct, 1)) + rank[step:]
        found, rank = np.unique(pair, return_inverse=True)
        n_distinct, width = len(found), width + step
    inside = at[: len(rank)] + run <= offsets[1:][text[: len(rank)]]
    place = at[: len(rank)][inside]
    code = text[place] * np.int64(max(n_distinct, 1)) + rank[inside]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = place[count[inverse] > 1]
    edge = np.zeros(len(index) + run + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + run, -1)
    covered = np.cumsum(edge)[: len(index)] > 0
    return np.bincount(text[covered], minlength=n_texts)


def duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


_FEATURES = "doc_id long, stratum string, tie long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{r} double" for r in RULES)


def features(docs: DataFrame, stratum: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: the base statistics, those of RULES and a hash of the text (tie), with the columns of `carry` beside them, named carry_<column>."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(column(batch, "text"), "")
            words, index, offsets = ascii_words(texts)
            n = np.diff(offsets)
            chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            shout = pc.match_substring_regex(words, "^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$").to_numpy(zero_copy_only=False)
            total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[index])])[offsets]) if len(index) else np.zeros(len(n), np.int64)
            bounds = np.concatenate([[0], np.cumsum(total(chars))])
            word_chars = np.diff(bounds)
            symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
            marks = pc.count_substring(texts, "!").to_numpy(zero_copy_only=False).astype(np.int64)
            lines, dup = np.array([duplicate_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2).T
            repeated = repeat_words(index, len(words), offsets)
            text_of = np.repeat(np.arange(len(n)), n)
            distinct = np.bincount(np.unique(text_of * max(len(words), 1) + index) // max(len(words), 1), minlength=len(n))
            per_word = np.maximum(n, 1)
            ratios = [
                symbols / per_word,
                word_chars / per_word,
                total(shout.astype(np.int64)) / per_word,
                marks / per_word,
                dup / np.maximum(lines, 1),
                repeated / per_word,
                np.where(n >= 50, 1 - distinct / per_word, 0.0),
            ]
            out = {"doc_id": column(batch, "doc_id"), "stratum": column(batch, "stratum"), "tie": column(batch, "tie"), "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated.astype(np.int64)}
            out |= dict(zip(RULES, ratios)) | {f"carry_{c}": column(batch, "text" if c == "text" else f"carry_{c}") for c in carry}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})

    kinds = dict(docs.dtypes)
    return rows.mapInArrow(tidy(run), _FEATURES + "".join(f", `carry_{c}` {kinds[c]}" for c in carry))


def binomial_tail(rejected: np.ndarray, good: np.ndarray, p: float) -> np.ndarray:
    """P(X <= rejected) for X ~ Bin(good, p), exactly: the regularised incomplete beta function I(1 - p; good - rejected, rejected + 1) by its continued fraction."""
    rejected, good = np.atleast_1d(rejected).astype(float), np.atleast_1d(good).astype(float)
    out = np.ones(len(good))
    some = np.flatnonzero(rejected < good)
    if not len(some) or p <= 0:
        return out
    if p >= 1:
        out[some] = 0.0
        return out
    a, b = good[some] - rejected[some], rejected[some] + 1
    x = np.full(len(some), 1 - p)
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side; the other follows by symmetry
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(np.array([lgamma(u + v) - lgamma(u) - lgamma(v) + u * log(w) + v * log1p(-w) for u, v, w in zip(a, b, x)])) / a
    tiny = 1e-300
    c, d = np.ones(len(a)), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 1_000_000):
        before = value.copy()
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value = value * c * d
        if (np.abs(value - before) <= 1e-14 * np.abs(value)).all():
            break
    out[some] = np.clip(np.where(swap, 1 - front * value, front * value), 0, 1)
    return out


def upper_bound(rejected: int, good: int, delta: float) -> float:
    """Clopper-Pearson: the share p at which seeing `rejected` or fewer of `good` has probability delta."""
    if rejected >= good:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(rejected, good, middle)[0] > delta else (low, middle)
    return high


def thresholds(labelled: DataFrame, risk: float, delta: float, cost: float, grid: int = 400) -> DataFrame:
    """(stratum, rule, cutoff): one row for each certified rule.

    labelled: one row a distinct text: stratum, tie, quality (0 or 1) and RULES. Everything is counted by Spark; only
    the number of strata reaches the driver.
    """
    spark = labelled.sparkSession
    by_stratum = Window.partitionBy("stratum")
    proposing = F.pmod(F.xxhash64("tie", F.lit("proposal")), F.lit(4)) == 0
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(F.col(r) / F.lit(step)), F.lit(grid)).cast("int").alias("step")) for r, step in RULES.items()])
    counts = labelled.where(proposing).select("stratum", "quality", F.explode(steps).alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("step"))  # a cutoff rejects whatever lies in its step and above
    walked = counts.select("stratum", "rule", "step", F.sum("good").over(down).alias("lost"), F.sum("bad").over(down).alias("caught"), F.sum("good").over(Window.partitionBy("stratum", "rule")).alias("all_good"))
    gain = F.col("caught") - F.lit(float(cost)) * F.col("lost")
    useful = walked.withColumn("gain", gain).where((F.col("step") > 0) & (F.col("gain") > 0) & (F.col("lost") <= F.col("all_good") * F.lit(risk / len(RULES))))
    best = useful.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "step")).alias("b"))
    width = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    cutoff = (F.col("b.step") - 1) * F.element_at(width, F.col("rule"))
    ranked = best.select("stratum", "rule", cutoff.alias("cutoff"), F.row_number().over(by_stratum.orderBy(F.desc("b.gain"), "rule")).alias("rank"))
    ranked = materialise(ranked, "proposed")
    strata = max(ranked.select("stratum").distinct().count(), 1)

    rules = ranked.groupBy(F.col("stratum").alias("of")).agg(F.collect_list(F.struct("rule", "cutoff", "rank")).alias("proposed"))
    values = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])
    held = labelled.where(~proposing & (F.col("quality") == 1)).select("stratum", values.alias("values")).join(small(rules), F.col("stratum").eqNullSafe(F.col("of")))
    hit = F.array_min(F.transform(F.filter("proposed", lambda p: F.element_at("values", p["rule"]) > p["cutoff"]), lambda p: p["rank"]))
    first = held.select("stratum", hit.alias("rank")).groupBy("stratum", "rank").agg(F.count("*").alias("n"))
    every = first.unionByName(ranked.select("stratum", "rank", F.lit(0).cast("long").alias("n")))  # ranks that reject none count too
    per = every.groupBy("stratum", "rank").agg(F.sum("n").alias("n")).withColumn("good", F.sum("n").over(by_stratum))
    tested = per.where("rank is not null").withColumn("lost", F.sum("n").over(by_stratum.orderBy("rank"))).select("stratum", "rank", "lost", "good")

    def certify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = binomial_tail(column(batch, "lost").to_numpy(), column(batch, "good").to_numpy(), risk) <= delta / strata
            yield pa.RecordBatch.from_arrays([column(batch, "stratum"), column(batch, "rank"), pa.array(ok, pa.bool_())], names=["stratum", "rank", "ok"])

    judged = tested.mapInArrow(certify, "stratum string, rank int, ok boolean").withColumn("ok", F.min("ok").over(by_stratum.orderBy("rank")))
    certified = judged.where("ok").select(F.col("stratum").alias("of"), F.col("rank").alias("r"))
    return ranked.join(certified, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("r")), "left_semi").select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, cost: float = 10, stratum: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Features with base_failed, failed_rules and kept, a row for each row of docs. labels: doc_id and quality (1 good, 0 bad)."""
    bounded_batches(docs.sparkSession)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = materialise(features(docs, stratum, carry), "quality").withColumn("base_failed", base)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = found.where("not base_failed").select("doc_id", "stratum", "tie", *RULES).join(marks, "doc_id").groupBy("stratum", "tie").agg(F.max("quality").alias("quality"), *[F.max(r).alias(r) for r in RULES])
    cut = thresholds(materialise(labelled, "labelled"), risk, delta, cost)
    wide = cut.groupBy(F.col("stratum").alias("of")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    judged = found.join(small(materialise(wide, "cutoffs")), F.col("stratum").eqNullSafe(F.col("of")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    judged = judged.withColumn("failed_rules", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return judged.drop("of", *[f"cut_{r}" for r in RULES])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
