"""Removal of passages that repeat across (or within) documents, by fixed-block anchors.

A passage is repeated if a window of `window` consecutive words also starts anywhere else. Blocks of
b = (window + 1) // 2 words lie end to end in every document, so each window holds at least one whole block, and a
repeated window's block is met by a rolling probe of b words at the other place.

1. Every document's blocks are indexed and every rolling window of b words is a probe. Both travel as packed arrays,
   sorted and freed of repeats in each task. Blocks whose words a task meets again are settled there: they are hits, and
   only that their words repeat is told to others. So a passage that millions of documents share costs its bucket one
   entry a task. A bucket's task finds which of the other blocks' words occur in more than one place.
2. Documents with such blocks extend the hits to both sides: every window over a hit block is looked up over the corpus
   by its words' fingerprint of 96 bits (from rolling hashes of two seeded hashes of each word; the chance that any two unequal ones of
   10^13 windows share theirs is below one in a thousand). Windows that repeat within a batch are settled there and travel once, whatever
   their number. Runs of repeated windows are the maximal exact repeats; their words are removed.

Documents are known by two hashes of (doc_id, text), so a null or repeated doc_id loses no row: rows that are wholly
equal get equal results, each counting as a place of the other's windows. A null text has no words. Texts with fewer
words than a window lose none; texts of any length are read whole. An empty table gives an empty result. Columns other
than doc_id and text are ignored.
Block hashes are cut to 32 bits and a bucket, which can only let needless blocks into step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import ascii_words, bounded_batches, column, grouped, materialise, n_buckets, pack_ints, rolling, rows_of, slices, starts_within, tidy, unpack, unpack_ints, word_hashes

#: Words or windows a task holds before it hands on their packed arrays.
_HELD = 3_000_000
#: Documents that are finished together in step 2.
_SHARD = 1000


def _flat_hashes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    words, index, offsets = ascii_words(texts)
    return words, index, offsets, word_hashes(words)[index] if len(index) else np.zeros(0, np.uint64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal entries of a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[a]), slice(a, b)


def hit_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """(k1, k2, blocks array): the numbers of each document's blocks whose words occur in more than one place."""
    buckets = n_buckets(keyed.sparkSession)
    schema = "bucket int, probes binary, twice binary, hash binary, k1 binary, k2 binary, number binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            probes = np.concatenate([x[0] for x in held])
            code = ((probes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (probes & np.uint64(0xFFFFFFFF))
            code, count = np.unique(code, return_counts=True)
            twice = code[count > 1]
            h, k1, k2, number = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            b_bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            settled = np.isin(b_bucket << np.uint64(32) | (h & np.uint64(0xFFFFFFFF)), twice, kind="sort")
            spread = np.where(settled, k1.view(np.uint64) % np.uint64(buckets), b_bucket)  # settled blocks needn't meet their words' bucket
            order = np.lexsort((spread, settled))
            h, k1, k2, number, spread = (x[order] for x in (h, k1, k2, number, spread))
            n_open = len(h) - int(settled.sum())
            done = [(int(b), b"", b"", b"", k1[n_open:][s].tobytes(), k2[n_open:][s].tobytes(), number[n_open:][s].astype(np.int32).tobytes()) for b, s in _by_bucket(spread[n_open:])]
            h, k1, k2, number, b_bucket = (x[:n_open] for x in (h, k1, k2, number, spread))
            t_cut = np.searchsorted(twice >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            b_cut = np.searchsorted(b_bucket, np.arange(buckets + 1, dtype=np.uint64))
            rows = done
            for bucket, s in _by_bucket(code >> np.uint64(32)):
                t, b = slice(t_cut[bucket], t_cut[bucket + 1]), slice(b_cut[bucket], b_cut[bucket + 1])
                rows.append((bucket, pack_ints(code[s] & np.uint64(0xFFFFFFFF), True), pack_ints(twice[t] & np.uint64(0xFFFFFFFF), True), h[b].astype(np.uint32).tobytes(), k1[b].tobytes(), k2[b].tobytes(), number[b].astype(np.int32).tobytes()))
            names = ["bucket", "probes", "twice", "hash", "k1", "k2", "number"]
            for at in range(0, len(rows), 64):
                part = list(zip(*rows[at : at + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(x, pa.binary()) for x in part[1:])], names=names)

        for batch in slices(batches, "text"):
            _, _, offsets, h = _flat_hashes(column(batch, "text"))
            at = starts_within(offsets, block)
            if not len(at):
                continue
            probes = rolling(h, block)[at]
            row = rows_of(offsets, at)
            within = at - offsets[row]
            own = within % block == 0
            k1, k2 = (column(batch, k).to_numpy() for k in ("k1", "k2"))
            held.append((probes, probes[own], k1[row[own]], k2[row[own]], within[own] // block))
            size += len(probes)
            if size >= _HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "bucket"):
            seen, count = np.unique(unpack_ints(rows.column("probes").to_pylist(), True), return_counts=True)
            again = np.union1d(seen[count > 1], unpack_ints(rows.column("twice").to_pylist(), True))
            is_open = pc.greater(pc.binary_length(rows.column("hash")), 0)
            waiting, settled = rows.filter(is_open), rows.filter(pc.invert(is_open))
            hit = np.isin(unpack(waiting, "hash", np.uint32), again)
            out = [pa.array(np.concatenate([unpack(waiting, name, dtype)[hit], unpack(settled, name, dtype)])) for name, dtype in (("k1", np.int64), ("k2", np.int64), ("number", np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["k1", "k2", "number"])

    packed = keyed.mapInArrow(tidy(pack), schema).repartition("bucket").sortWithinPartitions("bucket")
    hits = packed.mapInArrow(tidy(meet), "k1 long, k2 long, number int")
    return hits.groupBy("k1", "k2").agg(F.collect_set("number").alias("blocks"))


def _runs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): an order in which equal pairs stand together, and where each run of them begins in it."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)


#: A fingerprint as it travels.
_PAIR = np.dtype([("first", "<u8"), ("second", "<u4")])


def _both(first: np.ndarray, second: np.ndarray) -> bytes:
    out = np.empty(len(first), _PAIR)
    out["first"], out["second"] = first, second.astype(np.uint32)
    return out.tobytes()


def repeated_windows(hit: DataFrame, window: int, block: int) -> DataFrame:
    """(shard, rows binary, starts binary): in each shard of `hit` the rows and word positions where repeated windows start."""
    buckets = n_buckets(hit.sparkSession)
    names = ["bucket", "shard", "hash", "row", "start", "twice"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    schema = "bucket int, shard long, hash binary, row binary, start binary, twice binary"

    def rows_out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            words, index, offsets, h = _flat_hashes(column(batch, "text"))
            at = starts_within(offsets, window)
            if not len(at):
                continue
            row = rows_of(offsets, at)
            within = at - offsets[row]
            marks = np.zeros(offsets[-1] + 1, bool)  # begin of a hit block
            lists = column(batch, "blocks")
            marks[np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy().astype(np.int64) * block] = True
            over = marks[at + -within % block]  # the first block that begins in the window; it ends in it too
            at, row, within = at[over], row[over], within[over]
            first, second = rolling(h, window)[at], rolling(word_hashes(words, 1)[index], window)[at]
            order, begins = _runs(first, second)
            several = np.diff(np.concatenate([begins, [len(order)]])) > 1
            here = np.zeros(len(order), bool)  # windows that repeat within the batch
            here[order] = np.repeat(several, np.diff(np.concatenate([begins, [len(order)]])))
            heads = order[begins[several]]
            heads = heads[np.argsort(first[heads] % np.uint64(buckets), kind="stable")]
            out = [(b, 0, b"", b"", b"", _both(first[heads][s], second[heads][s])) for b, s in _by_bucket(first[heads] % np.uint64(buckets))]
            shards, places = (column(batch, k).to_numpy() for k in ("shard", "place"))
            for known in (True, False):
                some = np.flatnonzero(here == known)
                shard, place, start = shards[row[some]], places[row[some]], within[some]
                bucket = np.zeros(len(some), np.uint64) if known else first[some] % np.uint64(buckets)
                by = np.lexsort((place, bucket, shard))
                some, shard, place, start, bucket = (x[by] for x in (some, shard, place, start, bucket))
                for _, s in _by_bucket(shard):
                    number = int(shard[s][0])
                    for b, t in _by_bucket(bucket[s]):
                        digest = b"" if known else _both(first[some[s][t]], second[some[s][t]])
                        out.append((number % buckets if known else b, number, digest, pack_ints(place[s][t], True), pack_ints(start[s][t]), b""))
            yield rows_out(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "bucket"):
            digests, owners, packed_rows, packed_starts = (rows.column(c).to_pylist() for c in ("hash", "shard", "row", "start"))
            settled = [i for i, d in enumerate(digests) if not d and packed_rows[i]]
            open_ = [i for i, d in enumerate(digests) if d]
            pairs, twice = (np.frombuffer(b"".join(x), _PAIR) for x in (digests, [t or b"" for t in rows.column("twice").to_pylist()]))
            every = np.concatenate([pairs, twice])
            order, begins = _runs(every["first"], every["second"])
            weight = np.concatenate([np.ones(len(pairs), np.int64), np.full(len(twice), 2)])[order]
            again = np.zeros(len(every), bool)
            if len(order):
                again[order] = np.repeat(np.add.reduceat(weight, begins) > 1, np.diff(np.concatenate([begins, [len(order)]])))
            again = again[: len(pairs)]
            shard = np.repeat(np.array([owners[i] for i in open_], np.int64), [len(digests[i]) // _PAIR.itemsize for i in open_])[again]
            row, start = unpack_ints([packed_rows[i] for i in open_], True)[again], unpack_ints([packed_starts[i] for i in open_])[again]
            by = np.lexsort((row, shard))
            shard, row, start = shard[by], row[by], start[by]
            out = [(s, pack_ints(row[t], True), pack_ints(start[t])) for s, t in _by_bucket(shard)] + [(owners[i], packed_rows[i], packed_starts[i]) for i in settled]
            part = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], names=["shard", "rows", "starts"])

    packed = hit.mapInArrow(tidy(pack), schema).repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(tidy(meet), "shard long, rows binary, starts binary")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for each row of docs; kept words are joined by one space."""
    bounded_batches(docs.sparkSession)
    block = (window + 1) // 2
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    keyed = keyed.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"))
    blocks = hit_blocks(keyed.select("text", "k1", "k2"), block)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished rows of documents without a hit block; the others go on, in shards of at most _SHARD rows."""
        kept_type, places = pa.string(), pa.int32()
        for number, batch in enumerate(slices(batches, "text", 8 << 20)):
            hit = column(batch, "blocks").is_valid()
            for going, part in ((False, batch.filter(pc.invert(hit))), (True, batch.filter(hit))):
                size = part.num_rows
                texts, core = column(part, "text"), column(part, "core").to_numpy()
                n, digest, kept = [], [], []
                for text in [] if going else texts.to_pylist():
                    words = text.encode().split()
                    joined = b" ".join(words)
                    n.append(len(words))
                    digest.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined.decode() if with_text else None)
                none = lambda kind: pa.nulls(size, kind)
                out = {"doc_id": column(part, "doc_id")}
                if going:
                    place = np.arange(size, dtype=np.int32)
                    out |= {"n_words": none(pa.int64()), "n_removed": none(pa.int64()), "kept_sha256": none(kept_type), "kept_text": none(kept_type), "text": texts, "blocks": column(part, "blocks"), "shard": pa.array((core << 32) | (number << 8) | (place // _SHARD)), "place": pa.array(place)}
                else:
                    out |= {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array([0] * size, pa.int64()), "kept_sha256": pa.array(digest, kept_type), "kept_text": pa.array(kept, kept_type), "text": none(kept_type), "blocks": column(part, "blocks"), "shard": none(pa.int64()), "place": none(places)}
                yield pa.RecordBatch.from_pydict(out | {"done": pa.array([not going] * size, pa.bool_())})

    joined = keyed.join(blocks, ["k1", "k2"], "left").select("doc_id", "text", "blocks", F.spark_partition_id().cast("long").alias("core"))
    passed = materialise(joined.mapInArrow(tidy(first_pass), f"{_RESULT}, text string, blocks array<int>, shard long, place int, done boolean"), "repeats", ("done",), "zstd")
    going = passed.where("not done").select("doc_id", "text", "blocks", "shard", "place")
    starts = repeated_windows(going.select("text", "blocks", "shard", "place"), window, block)

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        at_row, at_start = (unpack_ints(right.column(c).to_pylist(), c == "rows").astype(np.int64) for c in ("rows", "starts"))
        order = np.argsort(at_row, kind="stable")
        at_row, at_start = at_row[order], at_start[order]
        n, removed, digest, kept = [], [], [], []
        for text, place in zip(left.column("text").to_pylist(), left.column("place").to_pylist()):
            words = text.encode().split()
            own = at_start[np.searchsorted(at_row, place) : np.searchsorted(at_row, place, side="right")]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + window, -1)
            covered = np.cumsum(edge)[:-1] > 0
            left_over = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
            n.append(len(words))
            removed.append(int(covered.sum()))
            digest.append(hashlib.sha256(left_over).hexdigest())
            kept.append(left_over.decode() if with_text else None)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept_text": pa.array(kept, pa.string())})

    finished = going.select("shard", "place", "doc_id", "text").groupBy("shard").cogroup(starts.groupBy("shard")).applyInArrow(second_pass, _RESULT)
    out = passed.where("done").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").union(finished)
    return out if with_text else out.drop("kept_text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE_SQL = {
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
r AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM p SEMI JOIN r USING (k), range(0, 35) AS s(j)),
g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
}
