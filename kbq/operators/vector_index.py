"""An index for cosine search: every row in the list of its nearest centroid, lists passed over where the triangle inequality allows it.

Centroids are fitted on a bounded sample (`sample` rows); every row is assigned. A query first meets its `probe` nearest
lists. The angle to its k-th neighbour there bounds what is still of interest: a list can hold nothing nearer if the
query's angle to the centroid lies further from the list's angles (its nearest and farthest row's) than that. The lists
that are left are met as well, so results are exact; with exact=False they are not, and recall has to be measured. How
much is passed over depends on how the vectors cluster: nothing of note if they lie evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbq.session import written

#: Rows of a list, or queries that meet it, that stand in one matrix.
_BLOCK = 2000
#: Angles and similarities are compared with this much to spare; similarities are rounded to 6 places.
_SPARE = 2e-6
#: The centroids travel to every task: at most this many.
MOST_LISTS = 65_536


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _usable(rows: DataFrame) -> DataFrame:
    given = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("vec_id").isNotNull()
    return rows.where(given).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]))


def fit(vectors: np.ndarray, lists: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Centroids of unit vectors by k-means on the sphere; a centroid that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        moved = _unit(sums)
        centres = np.where((moved != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


@dataclass
class Index:
    """blocks: (list, ids, matrix); per list its rows and the smallest and largest angle to its centroid."""

    centres: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: DataFrame


def build(rows: DataFrame, lists: int | None = None, sample: int = 20_000, seed: int = 42) -> Index:
    """Index rows(vec_id, embedding) of one width; null and empty embeddings, those with a null entry and null ids are left out. lists: the square root of the rows unless given."""
    usable = _usable(rows)
    n = usable.count()
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
    part = usable if n <= sample else usable.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 32) < F.lit(int(sample / n * 2**32)))
    drawn = part.orderBy(F.xxhash64("vec_id")).select("embedding").collect()
    centres = fit(_unit(np.array([r["embedding"] for r in drawn], np.float64).reshape(len(drawn), -1)), lists, seed=seed) if drawn else np.zeros((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch)
                score = unit @ centres.T
                nearest = score.argmax(axis=1)
                apart = np.arccos(np.clip(score[np.arange(len(unit)), nearest], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(apart), batch.column(0), pa.array([u.tobytes() for u in unit], pa.binary())], names=["list", "apart", "vec_id", "unit"])

    assigned = written(usable.mapInArrow(assign, "list int, apart double, vec_id long, unit binary"), "assigned")
    sizes, low, high = np.zeros(len(centres), np.int64), np.full(len(centres), np.pi), np.zeros(len(centres))
    for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high")).collect():  # a row a list
        sizes[r["list"]], low[r["list"]], high[r["list"]] = r["n"], r["low"], r["high"]
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(64))  # a long list lies in many partitions
    dealt = assigned.select("list", "vec_id", "unit").repartition("list", F.when(F.col("list").isin([int(i) for i in np.flatnonzero(sizes > 64 * _BLOCK)[:1000]]), spread).otherwise(0)).sortWithinPartitions("list", "vec_id")
    return Index(centres, sizes, low, high, written(_packed(dealt, "ids", "matrix"), "lists"))


def _packed(rows: DataFrame, ids: str, matrix: str) -> DataFrame:
    """(list, ids, matrix): rows (list, id, unit), sorted by list, as blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            for a, b in _runs(number):
                for at in range(a, b, _BLOCK):
                    some = batch.slice(at, min(_BLOCK, b - at))
                    yield pa.RecordBatch.from_arrays([pa.array([number[a]], pa.int32()), pa.array([some.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(some.column(2).to_pylist())], pa.binary())], names=["list", ids, matrix])

    return rows.mapInArrow(pack, f"list int, {ids} array<long>, {matrix} binary")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:]))


def _met(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): of asked (list, query_id, unit) the k best rows of each block of the list."""

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

    packed = _packed(asked.repartition("list").sortWithinPartitions("list"), "q_ids", "q_matrix")
    return index.blocks.join(packed, "list").mapInArrow(best, "query_id long, vec_id long, similarity double")


def search(index: Index, queries: DataFrame, k: int = 5, probe: int = 4, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, similarity, rank), (query_id, compared)): the k nearest rows of each query(vec_id, embedding), of equals those with the smallest ids, and how many rows each was compared with."""
    centres, sizes, low, high = index.centres, index.sizes, index.low, index.high
    probe = min(probe, len(centres))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest lists of queries without a bound; of others those that the bound leaves, without the nearest."""
        for batch in batches:
            if not batch.num_rows or not sizes.any():
                continue
            unit = _matrix(batch)
            apart = np.arccos(np.clip(unit @ centres.T, -1, 1))
            first = np.zeros(apart.shape, bool)
            np.put_along_axis(first, np.argsort(apart, axis=1, kind="stable")[:, :probe], True, axis=1)
            if batch.num_columns > 2:
                bound = np.arccos(np.clip(batch.column(2).to_numpy(zero_copy_only=False) - _SPARE, -1, 1))[:, None]
                nearest = np.maximum(apart - high, low - apart)
                chosen = ~first & (nearest <= bound + _SPARE) & (sizes > 0)
            else:
                chosen = first & (sizes > 0)
            q, c = np.nonzero(chosen)
            packed = pa.array([u.tobytes() for u in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), batch.column(0).take(pa.array(q)), packed.take(pa.array(q)), pa.array(sizes[c])], names=["list", "query_id", "unit", "n"])

    schema = "list int, query_id long, unit binary, n long"
    asked = written(_usable(queries).dropDuplicates(["vec_id"]), "queries")
    routes = written(asked.mapInArrow(route, schema), "routes")
    found = written(_met(index, routes.drop("n"), k), "met")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "vec_id")
    if exact:
        ranked = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        bounds = ranked.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("similarity")).alias("bound"))
        more = written(asked.join(bounds, "vec_id", "left").select("vec_id", "embedding", F.coalesce("bound", F.lit(-1.0)).alias("bound")).mapInArrow(route, schema), "routes")
        routes = routes.unionByName(more)
        found = found.unionByName(_met(index, more.drop("n"), k))
    rounded = found.withColumn("similarity", F.round("similarity", 6))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where(F.col("rank") <= k)
    return ranked, routes.groupBy("query_id").agg(F.sum("n").alias("compared"))
