"""Hashed TF-IDF embeddings in long form, and exact cosine neighbours."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbq.session import BROADCAST_ROWS, written

STOPWORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()


def _terms(text: Column) -> Column:
    """array<string>: words of two characters and more (a-z, 0-9) and their character trigrams, repeats included."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
    grams = lambda w: F.when(F.length(w) >= 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("c3:"), F.substring(w, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), lambda ws: F.concat(ws, F.flatten(F.transform(ws, grams)))), 1)


def features(docs: DataFrame) -> DataFrame:
    """(uri, term, tf)."""
    return docs.select("uri", F.explode(_terms(F.col("text"))).alias("term")).groupBy("uri", "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term), once for each document that has it: repeats are dropped within the row, so only terms are shuffled."""
    return docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))


def idf(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf): ln((1 + documents) / (1 + df)) + 1."""
    n = docs.agg(F.count("*").alias("n"))
    return found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def buckets(term: Column, size: int, probes: int) -> Column:
    """array<int>: places of a term, from the MD5 of its number and itself (first 32 bits)."""
    place = lambda k: (F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), term).cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")
    return F.array(*[place(k) for k in range(probes)])


def embed(found: DataFrame, weights: DataFrame, size: int = 384, probes: int = 3) -> DataFrame:
    """(uri, dim, value): each term adds its weight to `probes` hashed places, with a sign by the place's parity; rows have length 1."""
    weighed = found.join(weights, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf")).select("uri", "w", F.explode(buckets(F.col("term"), size, probes)).alias("dim"))
    summed = weighed.groupBy("uri", "dim").agg(F.sum(F.when(F.col("dim") % 2 == 0, F.col("w")).otherwise(-F.col("w"))).alias("value"))
    norms = summed.groupBy("uri").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, "uri").select("uri", "dim", (F.col("value") / F.col("norm")).alias("value"))


_WORD = re.compile("[a-z0-9]{2,}")
#: Words that a task keeps before it begins anew, and the longest that every task may know.
_KEPT, _LONG = 300_000, 64


class _Vocabulary(dict):
    """Numbers of words as they come, and of their trigrams; a stop word's number is -1."""

    def __init__(self) -> None:
        super().__init__((w, -1) for w in STOPWORDS)
        self.words: list[str] = []
        self.grams: dict[str, int] = {}
        self.parts, self.ends = array("q"), array("q", [0])  # the trigrams of all words, one after the other, and where each word's end

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.parts.extend(self.grams.setdefault(g, len(self.grams)) for g in (word[i : i + 3] for i in range(len(word) - 2)))
        self.ends.append(len(self.parts))
        return number

    def counted(self, texts: list[str]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """(text, word, times) and (text, trigram, times), distinct, of texts in small letters."""
        found = [list(map(self.__getitem__, _WORD.findall(t))) for t in texts]
        place = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        word = np.fromiter((w for f in found for w in f), np.int64, len(place))
        place, word, times = _summed(place[word >= 0], word[word >= 0], None, len(self.words))
        ends = np.array(self.ends, np.int64)
        n = ends[word + 1] - ends[word]
        at = np.repeat(ends[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return (place, word, times), _summed(np.repeat(place, n), np.array(self.parts, np.int64)[at], np.repeat(times, n), len(self.grams))


def _summed(place: np.ndarray, term: np.ndarray, times: np.ndarray | None, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of their times (1 each if None)."""
    pairs = place * max(1, terms) + term
    if times is None:
        pairs, sums = np.unique(pairs, return_counts=True)
    else:
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, sums = pairs[first], np.add.reduceat(times[order], first) if len(first) else times
    return pairs // max(1, terms), pairs % max(1, terms), sums


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select("uri", F.coalesce(F.lower("text"), F.lit("")).alias("low"))


def _documents_of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of a task's texts a term is."""
    known, words, grams = _Vocabulary(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    more = lambda old, term, size: np.bincount(term, minlength=size) + np.pad(old, (0, size - len(old)))

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known.words + [f"c3:{g}" for g in known.grams], pa.string()), pa.array(np.concatenate([words, grams]))], names=["term", "n"])

    for batch in batches:
        (_, word, _), (_, gram, _) = known.counted(batch.column("low").to_pylist())
        words, grams = more(words, word, len(known.words)), more(grams, gram, len(known.grams))
        if len(known.words) > _KEPT:
            yield told()
            known, words, grams = _Vocabulary(), words[:0], grams[:0]
    yield told()


def _others(terms) -> Callable:
    """(uri, term, tf) of the words that are not among `terms`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = terms.value[0].keys() | set(STOPWORDS)
        for batch in batches:
            found = [Counter(w for w in _WORD.findall(t) if w not in apart) for t in batch.column("low").to_pylist()]
            place = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column("uri").take(pa.array(place)), pa.array([w for f in found for w in f], pa.string()), pa.array([n for f in found for n in f.values()], pa.int64())], names=["uri", "term", "tf"])

    return find


def _vectors(terms, size: int) -> Callable:
    """(uri, dim, value) of texts whose terms are among `terms`, or stand beside them in `more` with weight and places."""

    def embed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, idf, places = terms.value
        own = _Vocabulary()
        of_word, of_gram = array("q"), array("q")
        for batch in batches:
            by_word, by_gram = own.counted(batch.column("low").to_pylist())
            of_word.extend(numbers.get(w, -1) for w in own.words[len(of_word) :])
            of_gram.extend(numbers.get(f"c3:{g}", -1) for g in list(own.grams)[len(of_gram) :])
            total = np.zeros(batch.num_rows * size)

            def add(place: np.ndarray, weight: np.ndarray, dims: np.ndarray, total: np.ndarray = total) -> None:
                cells = (place[:, None] * size + dims).ravel()
                total += np.bincount(cells, np.repeat(weight, dims.shape[1]), len(total))

            for (place, term, times), numbered in ((by_word, of_word), (by_gram, of_gram)):
                term = np.array(numbered, np.int64)[term]
                place, term, times = place[term >= 0], term[term >= 0], times[term >= 0]
                if len(place):
                    add(place, (1 + np.log(times)) * idf[term], places[term])
            if "more" in batch.schema.names and (rest := batch.column("more").flatten()):
                n = pc.fill_null(pc.list_value_length(batch.column("more")), 0).to_numpy()
                add(np.repeat(np.arange(len(n)), n), rest.field("w").to_numpy(), rest.field("places").flatten().to_numpy().reshape(len(rest), -1))
            length = np.sqrt((total * total).reshape(-1, size).sum(axis=1))
            at = np.flatnonzero(total)  # weights are positive and a place has one sign, so no sum of some is 0
            dim = at % size
            value = np.where(dim % 2 == 0, total[at], -total[at]) / length[at // size]
            for cut in range(0, len(at), 100_000):
                part = slice(cut, cut + 100_000)
                yield pa.RecordBatch.from_arrays([batch.column("uri").take(pa.array(at[part] // size)), pa.array(dim[part].astype(np.int32)), pa.array(value[part])], names=["uri", "dim", "value"])
            if len(own.words) > _KEPT:
                own, of_word, of_gram = _Vocabulary(), array("q"), array("q")

    return embed_batches


def embedded(docs: DataFrame, size: int = 384, probes: int = 3, known: int = BROADCAST_ROWS) -> DataFrame:
    """(uri, dim, value) of docs(uri, text), weighed by idf: what `embed` makes of all `features`, made where a text lies.

    Terms are counted, weighed and summed within a text, so none is shuffled with its document. Trigrams (at most 46,656)
    and the `known` words that are in most documents are sent to every task. Only if there are more words, the pairs of
    documents and such rare words are shuffled, and then texts once, to meet the weights of theirs.
    """
    spark, kind = docs.sparkSession, docs.schema["uri"].dataType.simpleString()
    several = docs.groupBy("uri").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():  # texts of one uri are one; a line's end parts words
        docs = docs.groupBy("uri").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    texts = _lowered(docs)
    terms = texts.select("low").mapInArrow(_documents_of_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    bits = F.when(F.col("term").startswith("c3:"), 99).when(F.length("term") > _LONG, 0).otherwise(F.length(F.bin("df")))
    found = written(terms.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), bits.alias("bits")), "weights")
    least, total = 99, 0
    per = dict(map(tuple, found.groupBy("bits").agg(F.count("*")).collect()))
    for b in sorted((b for b in per if 0 < b < 99), reverse=True):
        if (total := total + per[b]) > known:
            break
        least = b
    weighed = found.select("term", "idf", "bits", buckets(F.col("term"), size, probes).alias("places"))
    sent = weighed.where(F.col("bits") >= least).select("term", "idf", "places").toArrow()
    places = sent.column("places").combine_chunks().flatten().to_numpy().reshape(-1, probes).astype(np.int64)
    every = spark.sparkContext.broadcast(({t: i for i, t in enumerate(sent.column("term").to_pylist())}, sent.column("idf").to_numpy(), places))
    if any(b < least for b in per):
        pairs = texts.mapInArrow(_others(every), f"uri {kind}, term string, tf long")
        rare = pairs.join(weighed.where(F.col("bits") < least), "term").select(F.col("uri").alias("of"), F.struct(((1 + F.log("tf")) * F.col("idf")).alias("w"), "places").alias("x"))
        texts = texts.join(rare.groupBy("of").agg(F.collect_list("x").alias("more")), F.col("uri").eqNullSafe(F.col("of")), "left").drop("of")
    return texts.mapInArrow(_vectors(every, size), f"uri {kind}, dim int, value double")


_BLOCK = "ids array<long>, matrix binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, matrix): unit vectors of up to `size` rows as one matrix of 64-bit floats; rows stay in their partitions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = np.stack([np.asarray(v, np.float64) for v in part.column(1).to_pylist()])
                norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([unit.tobytes()], pa.binary())})

    given = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    return rows.where(given & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(pack, _BLOCK)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = 2000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest rows of each query by cosine, exactly. All vectors have one width; null or empty embeddings, those with a null entry and null ids are left out; a zero vector is at similarity 0 of all.

    Queries are a stated set against all rows, in blocks: rows are packed into matrices where they lie, every block of
    queries meets every block of rows in one matrix product, and k candidates a query leave each pair of blocks.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids = np.array(r["q_ids"]), np.array(r["ids"])
                width = len(r["matrix"]) // 8 // len(ids)
                score = np.frombuffer(r["q_matrix"], np.float64).reshape(-1, width) @ np.frombuffer(r["matrix"], np.float64).reshape(-1, width).T
                score[q_ids[:, None] == ids[None, :]] = -2  # a row is none of its own neighbours
                order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 6)), axis=1)[:, :k]
                found = np.take_along_axis(score, order, axis=1)
                keep = found > -2
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], found.shape)[keep]), pa.array(ids[order][keep]), pa.array(found[keep])], names=["query_id", "vec_id", "similarity"])

    asked = written(_blocks(queries, block).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), "queries")
    pairs = written(_blocks(rows, block), "rows").crossJoin(asked)  # written, so that no pair of partitions packs them again
    found = pairs.mapInArrow(best, "query_id long, vec_id long, similarity double").withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
