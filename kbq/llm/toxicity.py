"""Toxicity scores: a learned lexicon met by Levenshtein automata, and context windows that tell quotation from abuse.

1. Terms are learned from all labelled training documents: every word whose log odds of standing in a toxic document,
   and the root of whose likelihood ratio (a z-score), reach their bounds. Spark counts and tests all words; those that
   pass reach the driver, and there are far fewer of them than words (one needs several toxic documents and next to no
   others to reach the z-score; more than `most_terms` are an error, never a cut). They form a trie.
2. The Levenshtein automaton of a word and the trie are run as one deterministic automaton, whose states are sets of
   (trie node, errors) and are made when first met. Terms of 4 letters and more are found with one error (a letter
   changed, added or lost), shorter ones exactly. Each distinct word of a batch is run once.
3. Every hit has a window of `reach` words on both sides: other hits in it speak for abuse, quotation marks and verbs of
   saying for quotation.
4. A logistic regression on these statistics gives the score. It is fitted on about `sample` of the distinct labelled
   training rows, chosen by a hash; counts for the lexicon use all of them.

Labels, lang, source and doc_id are no inputs of a score. Held out are rows whose crc32(doc_id as text) mod 5 is 0, and
rows with a null doc_id count as such. Null and empty texts have no words and score as a text without hits. Every row
gives a row. Without labels of both kinds every score is the share of toxic labels (0 if there are none). No rows: no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import ascii_words, bounded_batches, column, hash_sample, materialise, slices, small, tidy

#: Words that announce somebody else's, in the four languages.
SAYING = {"said", "says", "say", "called", "wrote", "writes", "quote", "quoted", "quoting", "dit", "disait", "écrit", "sagte", "sagt", "schrieb", "dijo", "dice", "escribió"}
_MARKS = "\"“”„«»‹›`"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‹›‘’¡¿…–—"
FEATURES = ["hits", "rate", "weight", "weight_rate", "near", "near_rate", "dense", "quoted", "length"]


def strip_words(words: pa.Array) -> list[str]:
    """Distinct raw words as looked up: in small letters, without marks at either end."""
    return pc.utf8_trim(pc.utf8_lower(words), _EDGE).to_pylist()


class LexiconAutomaton:
    """The product of a word's Levenshtein automaton and the lexicon's trie, made deterministic as words are read."""

    def __init__(self, terms: dict[str, float], errors: int = 1, fuzzy_from: int = 4, most_states: int = 200_000):
        self.weights, self.errors, self.fuzzy_from, self.most_states = terms, errors, fuzzy_from, most_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for term in terms:
            node = 0
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][ch]
            self.ends[node] = term
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepted: list[tuple[str, int] | None] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        """With the nodes reached by letters that the word leaves out; of one node only the fewest errors stay."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, errors = todo.pop()
            if best.get(node, self.errors + 1) <= errors:
                continue
            best[node] = errors
            if errors < self.errors:
                todo += [(child, errors + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(e, -self.weights[t], t) for n, e in state if (t := self.ends[n]) is not None and (e == 0 or len(t) >= self.fuzzy_from)]
            self.accepted.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.numbers[state]

    def _step(self, state: int, ch: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, errors in self.states[state]:
            if ch in self.children[node]:
                items.add((self.children[node][ch], errors))
            if errors < self.errors:
                items.add((node, errors + 1))  # a letter too many
                items.update((child, errors + 1) for child in self.children[node].values())  # another letter
        return self._number(self._closed(items))

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, errors) of the best term within reach of the word, or None."""
        if len(self.states) > self.most_states:
            self._reset()
        state = self.start
        for ch in word:
            move = self.moves[state].get(ch)
            if move is None:
                move = self.moves[state][ch] = self._step(state, ch)
            if not self.states[move]:
                return None
            state = move
        return self.accepted[state]


def _document_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many rows of each label every word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            raw, index, offsets = ascii_words(column(batch, "text"))
            if not len(index):
                continue
            words, of = np.unique(np.array(strip_words(raw), object), return_inverse=True)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            pairs = np.unique(text * np.int64(len(words)) + of[index])
            label = column(batch, "toxic").to_numpy()[pairs // len(words)] == 1
            toxic, clean = (np.bincount(pairs[x] % len(words), minlength=len(words)) for x in (label, ~label))
            keep = np.fromiter(map(bool, words), bool, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words[keep].tolist(), pa.string()), pa.array(toxic[keep]), pa.array(clean[keep])], names=["word", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(tidy(run), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(train: DataFrame, z: float = 4.5, least_odds: float = 1.5, most_terms: int = 1_000_000) -> dict[str, float]:
    """Log odds of the words that mark toxic rows: all that reach both bounds. train: text and toxic (0 or 1)."""
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    a, b, total = F.col("toxic"), F.col("clean"), n_toxic + n_clean
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_clean - b + 0.5))
    share = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    with_it, without = (a + b) / total, (total - a - b) / total
    ratio = 2 * (share(a, with_it * n_toxic) + share(b, with_it * n_clean) + share(n_toxic - a, without * n_toxic) + share(n_clean - b, without * n_clean))
    counted = _document_counts(train).where("toxic > 0").select("word", odds.alias("odds"), ratio.alias("ratio"))
    found = materialise(counted.where((F.col("odds") >= least_odds) & (F.col("ratio") >= z * z)).select("word", "odds"), "lexicon")
    if (n := found.count()) > most_terms:
        raise ValueError(f"{n} words reach the bounds; raise z")
    return {r["word"]: r["odds"] for r in found.orderBy("word").collect()}


def text_features(texts: pa.Array, automaton: LexiconAutomaton, cache: dict[str, tuple[float, int]], reach: int = 8) -> np.ndarray:
    """(texts, FEATURES) matrix."""
    raw, index, offsets = ascii_words(texts)
    n = np.diff(offsets)
    out = np.zeros((len(n), len(FEATURES)))
    out[:, 8] = np.log1p(n)
    if not len(index):
        return out
    words = strip_words(raw)
    weight, kind = np.zeros(len(words)), np.zeros(len(words), np.int8)
    for i, word in enumerate(words):
        if word in cache:
            weight[i], kind[i] = cache[word]
            continue
        hit = automaton.find(word)
        if hit:
            weight[i], kind[i] = cache[word] = (automaton.weights[hit[0]], 1 + (hit[1] > 0))
    marks = pc.match_substring_regex(raw, f"[{_MARKS}]").to_numpy(zero_copy_only=False) | np.fromiter((w in SAYING for w in words), bool, len(words))
    at = np.flatnonzero(kind[index])
    if not len(at):
        return out
    text = np.searchsorted(offsets, at, side="right") - 1
    exact = kind[index[at]] == 1
    hit_sum = np.concatenate([[0], np.cumsum(kind[index] > 0)])
    mark_sum = np.concatenate([[0], np.cumsum(marks[index])])
    low, high = np.maximum(at - reach, offsets[text]), np.minimum(at + reach + 1, offsets[text + 1])
    around = hit_sum[high] - hit_sum[low] - 1
    quoted = mark_sum[high] - mark_sum[low] > 0
    per = lambda values: np.bincount(text, weights=values, minlength=len(n))
    hits, near, weights = per(exact), per(~exact), per(np.where(exact, weight[index[at]], 0))
    each = np.maximum(n, 1) / 100
    out[:, 0], out[:, 1] = np.log1p(hits), np.log1p(hits / each)
    out[:, 2], out[:, 3] = np.log1p(weights), np.log1p(weights / each)
    out[:, 4], out[:, 5] = np.log1p(near), np.log1p(near / each)
    out[:, 6] = np.log1p(per(around * ~quoted))
    out[:, 7] = per(quoted) / np.maximum(hits + near, 1)
    return out


#: The automaton that this Python worker built last, by the name that its lexicon was sent under.
_BUILT: dict[str, LexiconAutomaton] = {}


def _automaton(name: str, lexicon: Broadcast) -> LexiconAutomaton:
    """The automaton of a lexicon, built once a worker: its later tasks find it again."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = LexiconAutomaton(lexicon.value)
    return _BUILT[name]


def features(docs: DataFrame, lexicon: dict[str, float], reach: int = 8) -> DataFrame:
    """(doc_id, FEATURES...), a row for each row of docs. The lexicon is sent to each executor once."""
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = _automaton(name, sent), {}
        for batch in slices(batches, "text", 4 << 20):
            if len(cache) > 200_000:
                cache.clear()
            values = text_features(column(batch, "text"), automaton, cache, reach)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=["doc_id", *FEATURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - (w[1:] * mean / scale).sum()), w[1:] / scale


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, sample: int = 50_000, reach: int = 8) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits): a row for each row of docs."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    lexicon = learn_lexicon(rows.join(small(marks), "doc_id"))
    found = materialise(features(rows, lexicon, reach), "toxicity")
    trials = found.join(small(marks), "doc_id").dropDuplicates(["doc_id", "toxic", *FEATURES])
    chosen = hash_sample(trials, sample, "doc_id", *FEATURES).orderBy("doc_id", *FEATURES).select("toxic", *FEATURES).toArrow()
    y = chosen.column("toxic").to_numpy().astype(float)
    x = np.stack([chosen.column(f).to_numpy() for f in FEATURES], axis=1)
    if len(set(y.tolist())) < 2:
        value = F.lit(float(y.mean()) if len(y) else 0.0)
    else:
        bias, weights = fit(x, y)
        line = F.lit(bias)
        for f, w in zip(FEATURES, weights.tolist()):
            line = line + F.col(f) * F.lit(w)
        value = 1 / (1 + F.exp(-line))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), F.round(F.expm1("hits")).cast("long").alias("n_hits"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
