"""SentencePiece encoding with seeded merge-dropout, and decoding.

The encoder follows the agenda of SentencePiece's BPE: the best-scored adjacent pair that forms a piece is merged
first, the leftmost of equals. With dropout, a candidate merge is skipped if a keyed hash of (seed, text, the unit's place in
the text, where the candidate's two symbols begin, meet and end) falls below the rate. The draw belongs to the
candidate, so results repeat on any cluster layout, and every occurrence of a word has draws of its own. With
`variants` over zero a text's words take turns through so many draws per distinct unit instead. Without dropout the
ids are those of the sentencepiece library, but for U+2581 in a text, which is spelled in bytes so that decoding gives
it back.

No piece has a space mark after another character, nor a line feed; a text is therefore cut before each run of spaces
and around line feeds, and each unit (without dropout each distinct unit) is encoded once a batch, many at a time: all units of one length walk
their agendas together in numpy. Units over 64 characters take a heap, in n log n steps.

Nulls are empty texts; an empty text has no tokens. Every row gives a row. No rows: no rows. Texts of any length are
encoded whole. Columns other than the text are carried by encode() and decode() as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import bounded_batches, column, free_name, mix, slices, tidy

SPACE = "▁"
_UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_LONGEST = 64
_NEVER = np.int32(2**31 - 1)
#: Distinct units whose segmentation a worker keeps.
_KEPT_UNITS = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Tables of a BPE model, and its encoder and decoder."""

    def __init__(self, model_file: str, rate: float = 0.0, seed: int = 0, variants: int = 1):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        ids = {p: i for i, p in text.items()}
        byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([byte_id[b] for b in range(256)], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[ord(" ")] = ids[SPACE]
        self.of_char[ord(SPACE)] = -1
        scores = {i: sp.get_score(i) for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] << 32 | ids[p[k:]]] = (ranks[scores[i]], i)
        self.pairs = pairs
        self._build_table(pairs)
        spelled = [b""] * n
        for b, i in byte_id.items():
            spelled[i] = bytes([b])
        for i, p in text.items():
            spelled[i] = p.replace(SPACE, " ").encode()
        self.spelled_len = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.spelled_len)])[:-1]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.rate, self.seed, self.variants = rate, seed, variants
        self.below = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        self.forget()

    def _build_table(self, pairs: dict) -> None:
        """Open addressing over 2^18 places or more, so that a lookup is a few vector steps."""
        bits = max(18, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.merged = np.full(1 << bits, _NEVER, np.int32), np.zeros(1 << bits, np.int32)
        self.mask = (1 << bits) - 1
        for key, (rank, piece) in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 % 2**64) >> int(self.shift)
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.merged[at] = key, rank, piece

    def forget(self) -> None:
        self.known: list[dict[str, int]] = [{} for _ in range(self.variants)]
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs; rank is _NEVER where a pair forms no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        rank, merged = np.full(len(key), _NEVER, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        while len(todo):
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            found = todo[hit]
            rank[found], merged[found] = self.ranks[at[found]], self.merged[at[found]]
            todo = todo[~hit & (seen != -1)]
            at[todo] = (at[todo] + 1) & self.mask
        return rank, merged

    def _skipped(self, unit_hash: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        place = (start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (middle.astype(np.uint64) * np.uint64(0x165667B19E3779F9)) ^ (stop.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
        return mix(unit_hash ^ mix(place)) < self.below

    def _unit_hashes(self, units: list[str], variant: int) -> np.ndarray:
        key = xxhash.xxh64_intdigest(f"{self.seed}:{variant}")
        return np.fromiter((xxhash.xxh64_intdigest(u, key) for u in units), np.uint64, len(units))

    def _agendas(self, chars: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, list]:
        """Units of one length, a row each: their symbols after all merges, as (rows, symbol arrays by count)."""
        n, width = chars.shape
        rows = np.arange(n)
        ids = self.of_char[chars]
        begin = np.broadcast_to(np.arange(width + 1, dtype=np.int16), (n, width + 1)).copy()
        rank, merged = (x.reshape(n, width - 1) for x in self._lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()))
        if self.rate:
            live = np.argwhere(rank != _NEVER)
            r, c = live[:, 0], live[:, 1]
            skip = self._skipped(hashes[r], begin[r, c], begin[r, c + 1], begin[r, c + 2])
            rank[r[skip], c[skip]] = _NEVER
        done = []
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            at = np.arange(len(rows))
            going = rank[at, best] != _NEVER if rank.shape[1] else np.zeros(len(rows), bool)
            if not going.all():
                done.append((rows[~going], ids[~going], begin[~going]))
                rows, ids, begin, rank, merged, best = (x[going] for x in (rows, ids, begin, rank, merged, best))
                at = np.arange(len(rows))
            if not len(rows):
                return rows, done
            ids[at, best] = merged[at, best]
            drop = lambda x, first: np.take_along_axis(x, (c := np.arange(x.shape[1] - 1)) + (c >= first[:, None]), axis=1)
            ids, begin = drop(ids, best + 1), drop(begin, best + 1)
            rank, merged = drop(rank, best), drop(merged, best)
            for side in (best - 1, best):  # the pairs that the new symbol forms
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                if not len(ok):
                    continue
                c = side[ok]
                new_rank, new_merged = self._lookup(ids[ok, c], ids[ok, c + 1])
                if self.rate:
                    live = np.flatnonzero(new_rank != _NEVER)
                    o, k = ok[live], c[live]
                    new_rank[live[self._skipped(hashes[rows[o]], begin[o, k], begin[o, k + 1], begin[o, k + 2])]] = _NEVER
                rank[ok, c], merged[ok, c] = new_rank, new_merged

    def agenda(self, unit: str, unit_hash: int) -> list[tuple[int, int]]:
        """(symbol, where it begins) of one unit after all merges, by a heap of candidates; symbol -1 is a character without a piece."""
        ids = [int(self.of_char[ord(ch)]) for ch in unit]
        begin, stop = list(range(len(unit))), list(range(1, len(unit) + 1))
        after, before = [*range(1, len(unit)), -1], list(range(-1, len(unit) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else -1
            if a < 0 or b < 0 or ids[a] < 0 or ids[b] < 0:
                return
            found = self.pairs.get(ids[a] << 32 | ids[b])
            if found and not (self.rate and self._skipped(np.array([unit_hash], np.uint64), *(np.array([x]) for x in (begin[a], begin[b], stop[b])))[0]):
                heapq.heappush(heap, (found[0], a, stop[b], begin[b]))

        for a in range(len(unit)):
            offer(a)
        while heap:
            _, a, end, meet = heapq.heappop(heap)
            b = after[a]
            if ids[a] == -2 or b < 0 or begin[b] != meet or stop[b] != end or stop[a] != meet:
                continue  # one of the two has been merged since
            ids[a], stop[a] = self.pairs[ids[a] << 32 | ids[b]][1], stop[b]
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            ids[b] = -2
            offer(before[a])
            offer(a)
        return [(i, at) for i, at in zip(ids, begin) if i != -2]

    def _learn(self, units: list[str], variant: int) -> None:
        """Segment units that are new and keep the result."""
        flat, size = self._segment(units, self._unit_hashes(units, variant))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        first = len(self.size)
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.known[variant].update(zip(units, range(first, first + len(units))))

    def _segment(self, units: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, under the draws of their hashes, and how many each has."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        size = np.zeros(len(units), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # units, and a row of ids for each
        spelled = lambda i, symbols: found.append((np.array([i]), self._spell(units[i], symbols)[None, :]))
        for width in np.unique(lengths):
            which = np.flatnonzero(lengths == width)
            if width > _LONGEST:
                for i in which:
                    spelled(i, self.agenda(units[i], int(hashes[i])))
                continue
            chars = np.frombuffer("".join(units[i] for i in which.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, width)
            _, done = self._agendas(chars, hashes[which])
            for rows, ids, begin in done:
                plain = (ids >= 0).all(axis=1)
                found.append((which[rows[plain]], ids[plain]))
                for r, row, at in zip(which[rows[~plain]].tolist(), ids[~plain], begin[~plain]):
                    spelled(r, list(zip(row.tolist(), at.tolist())))
        for which, ids in found:
            size[which] = ids.shape[1]
        begins = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        for which, ids in found:
            flat[begins[which][:, None] + np.arange(ids.shape[1])] = ids
        return flat, size

    def _spell(self, unit: str, symbols: list[tuple[int, int]]) -> np.ndarray:
        """Characters without a piece become their bytes' ids."""
        out: list[int] = []
        for i, at in symbols:
            out.extend([i] if i >= 0 else self.byte_ids[list(unit[at].encode())].tolist())
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one entry more than texts)."""
        if not self.variants:
            return self._encode_each(texts)
        if len(self.size) > _KEPT_UNITS:
            self.forget()
        by_variant: list[list[str]] = [[] for _ in range(self.variants)]
        places: list[list[np.ndarray]] = [[] for _ in range(self.variants)]
        bounds, total = [0], 0
        for text in texts:
            units = _UNIT.findall(" " + text) if text else []
            turn = xxhash.xxh64_intdigest(text, self.seed) % self.variants if text else 0
            for v in range(self.variants):
                first = (v - turn) % self.variants
                by_variant[v] += units[first :: self.variants]
                places[v].append(np.arange(total + first, total + len(units), self.variants))
            total += len(units)
            bounds.append(total)
        entry = np.zeros(total, np.int64)
        for v, units in enumerate(by_variant):
            known = self.known[v]
            if new := [u for u in dict.fromkeys(units) if u not in known]:
                self._learn(new, v)
            if units:
                entry[np.concatenate(places[v])] = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        size = self.size[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[entry] - ends[:-1], size)]
        return ids, ends[np.array(bounds)]

    def _encode_each(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """encode() with draws for every occurrence."""
        lists = [_UNIT.findall(" " + text) if text else [] for text in texts]
        keys = np.fromiter((xxhash.xxh64_intdigest(text or "", self.seed) for text in texts), np.uint64, len(texts))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
        hashes = mix(np.repeat(keys, counts) ^ mix(place.astype(np.uint64)))
        flat, size = self._segment([u for units in lists for u in units], hashes)
        return flat, np.concatenate([[0], np.cumsum(size)])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts, without a space in front (encoding puts one there). Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary spell nothing."""
        known = (ids >= 0) & (ids < len(self.spelled_len))
        if not known.all():
            ids, bounds = ids[known], np.concatenate([[0], np.cumsum(known)])[bounds]
        size = self.spelled_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.spelled[np.arange(ends[-1]) + np.repeat(self.spelled_at[ids] - ends[:-1], size)].tobytes()
        cuts = ends[bounds].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[tuple, Pieces] = {}


def _pieces(*parameters) -> Pieces:
    """One model a worker process, kept over tasks."""
    if parameters not in _LOADED:
        _LOADED.clear()
        _LOADED[parameters] = Pieces(*parameters)
    return _LOADED[parameters]


def encode(docs: DataFrame, model_file: str | None = None, rate: float = 0.1, seed: int = 1, variants: int = 0, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with an array<int> column of piece ids (empty for null texts)."""
    model_file = model_file or default_model()

    source = free_name(docs, "source_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(model_file, rate, seed, variants)
        for batch in slices(batches, source, 1 << 20):
            ids, bounds = model.encode(column(batch, source).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            keep = [i for i, name in enumerate(batch.schema.names) if name != source]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), lists], names=[*(batch.schema.names[i] for i in keep), to])
        model.forget()

    named = docs.withColumn(source, F.col(text).cast("string")).drop(to)
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in named.dtypes if name != source)
    return named.mapInArrow(tidy(run), f"{kinds}{', ' * bool(kinds)}`{to}` array<int>")


def decode(docs: DataFrame, model_file: str | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """docs with the texts that the ids spell; null ids give null, null entries spell nothing."""
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [np.array([i for i in x or [] if i is not None], np.int64) for x in column(part, ids).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                texts = model.decode(np.concatenate(lists), bounds)
                out = [t if ok else None for t, ok in zip(texts, column(part, ids).is_valid().to_pylist())]
                keep = [i for i, name in enumerate(part.schema.names) if name != to]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(out, pa.string())], names=[*(part.schema.names[i] for i in keep), to])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes if name != to)
    return docs.mapInArrow(run, f"{kinds}, `{to}` string")


def round_trip(docs: DataFrame, model_file: str | None = None, rate: float = 0.1, seed: int = 1, variants: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, lossless): each text encoded and decoded from its ids within one pass.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    model_file = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(model_file, rate, seed, variants)
        for batch in slices(batches, "text", 1 << 20):
            texts = column(batch, "text").to_pylist()
            ids, bounds = model.encode(texts)
            back = model.decode(ids, bounds)
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in back]
            out = [column(batch, "doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(digest), pa.array([a == (b or "") for a, b in zip(back, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])
        model.forget()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
