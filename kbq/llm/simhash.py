"""SimHash near-duplicate classes, with pigeonring filtering of candidate pairs.

A document's fingerprint has a bit for each of the 64 bits of XXH64, set if more than half of its word shingles have it
set. Fingerprints that differ in at most `max_distance` bits (t) are linked; a class is a connected component of links.

Cut into m = t + 1 segments on a ring (three at least), two linked fingerprints have a segment from which every chain of l consecutive
segments differs in at most floor(l * t / m) <= l - 1 bits. So they agree wholly on that segment and differ in at most
one bit on the next: both are therefore found under a key made of the first segment and the second with one bit
masked. Distinct fingerprints meet under such keys only; the longer chains are checked before the full distance, and
what a key's fingerprints give is a forest of links, never all pairs. No candidate is dropped or capped. A key that
many fingerprints share is cut again by the bits outside of it.

Classes are found among distinct fingerprints; rows meet only their own fingerprint's entry, and fingerprints or
classes with a large share of the rows are not shuffled. Nulls and texts without words have fingerprint zero, linked like any other. Copies share a fingerprint and meet in a
row count only. Rows with a null doc_id are kept; a class's id is the smallest doc_id that is not null. An empty table
gives an empty result. Texts of any length are read whole. Columns other than doc_id and text are ignored; keep_one
carries them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import ascii_words, bounded_batches, column, drop_scratch, free_name, join_hot, materialise, read_back, slices, small, tidy, write_scratch

_CHUNK = 1 << 16
#: Pairs compared at once, and fingerprints of a key that are compared without further cuts.
_CELLS = 1 << 20
_DENSE = 2000


def shingle_hashes(texts: pa.Array, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the lower-cased (A-Z) words of each text, and where each text's shingles begin."""
    words, index, offsets = ascii_words(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes = np.diff(offsets)
    n_shingles = np.where(sizes == 0, 0, np.maximum(sizes - width + 1, 1))
    begins = np.concatenate([[0], np.cumsum(n_shingles)]).astype(np.int64)
    if not len(index):
        return np.zeros(0, np.uint64), begins
    flat = words.take(pa.array(index))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer().to_pybytes()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    first = np.arange(begins[-1]) - np.repeat(begins[:-1] - offsets[:-1], n_shingles)
    last = np.minimum(first + width, np.repeat(offsets[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[first].tolist(), (starts[last] + lengths[last]).tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(first)), begins


def majority_bits(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text the 64-bit word of the bits that over half of its hashes have."""
    n = np.diff(begins)
    counts = np.zeros((len(n), 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = int(np.searchsorted(begins, at, side="right") - 1)
        hi = int(np.searchsorted(begins, at + len(part), side="left"))
        some = np.flatnonzero(n[lo:hi]) + lo
        cuts = np.maximum(begins[some] - at, 0)
        counts[some] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, tie, fp): the fingerprint of each row's whole text as a signed 64-bit integer; tie is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = majority_bits(*shingle_hashes(column(batch, "text"), width, seed))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tie"), pa.array(fp.view(np.int64))], names=["doc_id", "tie", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, tie long, fp long")


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that share out 64 bits."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def ring(max_distance: int) -> list[tuple[int, int]]:
    """The segments for a distance: one more than it, and three at least, so that a key has room for its head."""
    return segments(max(max_distance + 1, 3))


def head_shift(cut: list[tuple[int, int]]) -> int:
    """Where a key's head begins: above the widest two neighbours, for every start alike."""
    return max(w + cut[(i + 1) % len(cut)][1] for i, (_, w) in enumerate(cut))


def chain_keys(fp: np.ndarray, max_distance: int) -> np.ndarray:
    """(fingerprints, keys) matrix: for each start of a chain and each masked bit of its second segment a key."""
    cut = ring(max_distance)
    columns = []
    for i, (shift, width) in enumerate(cut):
        shift2, width2 = cut[(i + 1) % len(cut)]
        first = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        second = (fp >> np.uint64(shift2)) & np.uint64((1 << width2) - 1)
        for bit in range(width2):
            masked = second & ~np.uint64(1 << bit)
            head = np.uint64(i * 64 + bit) << np.uint64(head_shift(cut))
            columns.append(head | (first << np.uint64(width2)) | masked)
    return np.stack(columns, axis=1)


def chain_passes(diff: np.ndarray, start: int, max_distance: int) -> np.ndarray:
    """Which differences keep every chain from segment `start` within its budget: l - 1 bits over l segments, max_distance at most."""
    cut = ring(max_distance)
    seen = np.zeros(diff.shape, np.int64)
    ok = np.ones(diff.shape, bool)
    for length in range(1, len(cut) + 1):
        shift, width = cut[(start + length - 1) % len(cut)]
        part = (diff >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        seen = seen + np.bitwise_count(part)
        ok &= seen <= min(length - 1, max_distance)
    return ok


def forest(fp: np.ndarray, start: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (root, member) that connect what is linked under one key: each fingerprint is visited once and compared with those not yet reached."""
    rest = np.sort(fp)
    while len(rest) > 1:
        root, rest = rest[:1], rest[1:]
        front, reached = root, []
        while len(front) and len(rest):
            size = max(1, _CELLS // len(rest))
            block, front = front[:size], front[size:]
            linked = chain_passes(block[:, None] ^ rest[None, :], start, max_distance).any(axis=0)
            if linked.any():
                reached.append(rest[linked])
                front = np.concatenate([front, rest[linked]])
                rest = rest[~linked]
        if reached:
            members = np.concatenate(reached)
            yield np.repeat(root, len(members)), members


def forests(fp: np.ndarray, start: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """forest() for a key of any size: of many fingerprints those are compared that agree on one of max_distance + 1 stretches of the bits outside the key, as linked ones do."""
    if len(fp) <= _DENSE:
        yield from forest(fp, start, max_distance)
        return
    cut = ring(max_distance)
    outside = [shift + b for k, (shift, width) in enumerate(cut) if k not in (start, (start + 1) % len(cut)) for b in range(width)]
    for stretch in np.array_split(np.array(outside), max_distance + 1):
        mask = np.uint64(sum(1 << int(b) for b in stretch))
        order = np.argsort(fp & mask, kind="stable")
        some = fp[order]
        cuts = np.flatnonzero(np.diff(some & mask)) + 1
        for group in np.split(some, cuts):
            if len(group) > 1:
                yield from forest(group, start, max_distance)


def links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """(a, b), a < b unsigned: links among distinct fingerprints (column fp) that connect exactly what lies within max_distance."""
    cut = ring(max_distance)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = column(batch, "fp").to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), 8192):
                fp = all_fp[at : at + 8192]
                keys = chain_keys(fp, max_distance)
                out = [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=["key", "fp"])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Batches whose last key's rows wait until that key ends."""
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                key, fp = column(batch, "key").to_numpy(), column(batch, "fp").to_numpy()
                if not len(key):
                    continue
                end = int(np.searchsorted(key, key[-1]))
                if end or (held and held[-1][0][-1] != key[-1]):
                    held.append((key[:end], fp[:end]))
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held = []
                held.append((key[end:], fp[end:]))
            if held:
                yield tuple(np.concatenate(x) for x in zip(*held))

        for key, fp_signed in whole():
            if len(key) < 2:
                continue
            fp = fp_signed.view(np.uint64)
            begins = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            sizes = np.diff(np.concatenate([begins, [len(key)]]))
            starts = (key[begins] >> head_shift(cut)) // 64
            found_a, found_b = [], []
            for i in range(len(cut)):  # the many groups of two at once
                two = begins[(sizes == 2) & (starts == i)]
                ok = chain_passes(fp[two] ^ fp[two + 1], i, max_distance)
                found_a.append(fp[two][ok])
                found_b.append(fp[two + 1][ok])
            for g in np.flatnonzero(sizes > 2):
                for a, b in forests(fp[begins[g] : begins[g] + sizes[g]], int(starts[g]), max_distance):
                    found_a.append(a)
                    found_b.append(b)
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            out = [pa.array(np.ascontiguousarray(pairs[:, c]).view(np.int64)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b"])

    by_key = distinct.mapInArrow(tidy(keyed), "key long, fp long").repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(tidy(connect), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b) by alternating large-star and small-star rounds.

    Each star is written to the shared folder, so a lost executor costs one at most and no plan holds more than one. root
    is the component's smallest node as signed integers. Nodes without edges have no row.
    """
    spark: SparkSession = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        least = materialise(least, "least")
        joined = join_hot(near, least, "u")
        if large:
            out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u")))
        return out.where("a <> b").distinct()

    def settled(df: DataFrame) -> bool:
        """Whether df is stars alone: every node is a root, or has one edge to a root. Then nothing would change any more."""
        ends = df.select(F.col("a").alias("u"), F.lit(0).alias("above"), F.lit(1).alias("below")).union(df.select("b", F.lit(1), F.lit(0)))
        per = ends.groupBy("u").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        return per.where("above > 1 or above = 1 and below = 1").isEmpty()

    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    path = write_scratch(ordered, "links")
    current = read_back(spark, path, ordered.schema)
    while not settled(current):
        for large in (True, False):
            next_path = write_scratch(star(current, large), "links")
            drop_scratch(spark, path)
            path, current = next_path, read_back(spark, next_path, ordered.schema)
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).union(current.select("a", "a").distinct())


def classed(docs: DataFrame, first: Column, width: int = 4, seed: int = 42, max_distance: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): rows has (doc_id, tie, fp) for each row of docs, entries (fp, n, first) for each distinct fingerprint: its rows and the least value of `first`, an expression over rows, in the whole class."""
    bounded_batches(docs.sparkSession)
    rows = materialise(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(first).alias("first")), "distinct")
    rooted = materialise(components(links(distinct.select("fp"), max_distance)).select(F.col("node").alias("fp"), "root"), "roots")
    members = materialise(distinct.join(rooted, "fp").select("fp", "root", F.col("n").alias("copies"), "first"), "members")
    of_root = materialise(members.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")), "classes")
    linked = join_hot(members, of_root, "root").select("fp", F.col("copies").alias("n"), F.col("least").alias("first"))
    return rows, materialise(linked.unionByName(distinct.join(rooted, "fp", "left_anti")), "entries")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs. fingerprint: 16 lowercase hex digits."""
    rows, entries = classed(docs, F.col("doc_id"), width, seed, max_distance)
    found = join_hot(rows, entries, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, seed: int = 42, max_distance: int = 4) -> DataFrame:
    """docs without near-duplicates: of each class the row with the smallest doc_id stays (of equals the one with the smallest hash of its text, nulls last); of wholly repeated rows one stays."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    rows, entries = classed(docs, row, width, seed, max_distance)
    marked = join_hot(rows, entries, "fp").select("doc_id", "tie", row.eqNullSafe(F.col("first")).alias("stays"))
    other, tie, stays = (free_name(docs, c) for c in ("other", "tie", "stays"))
    judged = marked.groupBy("doc_id", "tie").agg(F.max("stays").alias(stays), F.count("*").alias("n")).where(~F.col(stays) | (F.col("n") > 1))
    rest = materialise(judged.select(F.col("doc_id").alias(other), F.col("tie").alias(tie), F.col(stays)), "near-duplicates")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tie))
    kept = docs.join(small(rest), same, "left_anti")
    repeated = docs.join(small(rest.where(F.col(stays))), same, "left_semi")
    return kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
