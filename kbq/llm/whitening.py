"""Whitening of embeddings: leading components of their covariance by Chebyshev-filtered subspace iteration.

Vectors become integers once (floor(scale * c) + shift), so the number of rows, the sums of dimensions and each row's
squared distance from the mean are exact. A block of orthonormal vectors Q is then filtered by a Chebyshev polynomial of
the covariance, which stays small on the unwanted part of the spectrum, [0, smallest Ritz value of the block], and grows
fast above it. Every step of the recurrence is one distributed pass of centred products X'XQ: each task reads packed
blocks of rows and gives one matrix as wide as the block, and Spark adds those up entry by entry. QR and Rayleigh-Ritz
follow each filter, until the residuals of all wanted components certify them.

Only matrices of dimensions x block reach the driver, never rows. Nulls: vectors that are null or hold null or non-finite
entries are left out; so are those whose width is not the table's greatest. Zero vectors stay, and empty ones if all are.
Entries too large for a long saturate. Repeated rows each count; rows with a null id are kept. An empty table gives an
empty result. A component without variance has null whitened values; there are as many components as dimensions at most.
Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import bounded_batches, column, materialise, tidy

#: Rows of a packed block.
_ROWS = 2000
_LONG = 2.0**63


def packed(rows: DataFrame, scale: int, shift: int, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """((ids, matrix) blocks of integer vectors, width): written once, so that each pass is a scan of packed bytes."""
    width = int(rows.agg(F.max(F.size(vector))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                lists = part.column(1)
                part = part.filter(pc.equal(pc.fill_null(pc.list_value_length(lists), -1), width))
                flat = pc.fill_null(part.column(1).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
                usable = np.isfinite(flat).all(axis=1)
                with np.errstate(over="ignore"):
                    moved = np.floor(scale * flat[usable]) + shift
                whole = np.clip(moved, -_LONG, _LONG - 1024).astype(np.int64)  # the largest double that a long holds
                ids = part.column(0).filter(pa.array(usable))
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([whole.tobytes()], pa.binary())], names=["ids", "matrix"])

    given = rows.select(F.col(id_column).cast("long"), F.col(vector).cast("array<double>"))
    if not width:
        given = given.where("false")
    return materialise(given.mapInArrow(tidy(run), "ids array<long>, matrix binary"), "vectors"), width


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, raw in zip(column(batch, "ids"), column(batch, "matrix").to_pylist()):
            yield ids.values, np.frombuffer(raw, np.int64).reshape(-1, width)


def added(blocks: DataFrame, width: int, make, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of make(x) over all blocks, an array of `shape` of doubles: a task gives one array, and Spark adds entries by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _blocks(batches, width):
            total += make(x)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "value"])

    sums = blocks.mapInArrow(tidy(run), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(int(np.prod(shape)))
    for r in sums:
        out[r["place"]] = r["value"]
    return out.reshape(shape)


def exact_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for _, x in _blocks(batches, width):
            n += len(x)
            part = x.sum(axis=0) if np.abs(x.astype(np.float64)).max() * len(x) < _LONG / 2 else x.astype(object).sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width, dtype=np.int32)), pa.array([str(v) for v in (n, *sums)])], names=["place", "value"])

    found = {r["place"]: int(r["value"]) for r in blocks.mapInArrow(tidy(run), "place int, value string").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n. The numerator n * x - S is exact where a long holds it."""
    if max(np.abs(x.astype(np.float64)).max() * n, np.abs(sums.astype(np.float64)).max()) < _LONG / 4:
        return (n * x - sums.astype(np.int64)) / n
    return np.array((n * x.astype(object) - sums) / n, np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S) ** 2; None where a long can't hold one."""
    far, large = np.abs(x.astype(np.float64) * n - sums.astype(np.float64)).max(), max(np.abs(x.astype(np.float64)).max() * n, np.abs(sums.astype(np.float64)).max())
    if far * far * x.shape[1] < _LONG / 2 and large < _LONG / 4:
        off = n * x - sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - sums
    return [v if v < _LONG else None for v in (off * off).sum(axis=1).tolist()]


@dataclass
class Components:
    """Leading eigenvectors (columns of `vectors`) and values of the covariance, with what certifies them."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def components(blocks: DataFrame, width: int, count: int = 8, extra: int = 24, degree: int = 10, tolerance: float = 1e-13, most_rounds: int = 60, seed: int = 42) -> Components:
    """The `count` leading components of blocks' covariance (divisor n).

    A round filters a block of count + extra vectors by a polynomial of `degree`; rounds end when every wanted residual
    is below tolerance * largest value, or when residuals below 1e-10 of it no longer shrink, as rounding keeps them there.
    """
    n, sums = exact_sums(blocks, width)
    wanted, size = min(count, width), min(width, count + extra)
    if not n:
        return Components(0, sums, 0.0, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0)
    total = np.array(sums, object)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        """V @ q."""
        nonlocal passes
        passes += 1

        def make(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, total)
            return c.T @ (c @ q)

        return added(blocks, width, make, q.shape) / n

    trace = float(added(blocks, width, lambda x: np.array([(centred(x, n, total) ** 2).sum()]), (1,))[0]) / n
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    best, stuck = np.inf, 0
    for _ in range(most_rounds):
        image = times(q)
        ritz, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * ritz, axis=0)[:wanted]
        top = max(float(ritz[0]), 0.0)
        worst = float(residuals.max())
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if size == width or worst <= tolerance * top or (stuck >= 2 and worst <= 1e-10 * top):
            break
        half = max(float(ritz[-1]), top * 1e-12) / 2  # centre and half-width of the damped interval [0, smallest Ritz value]
        scale = half / (top - half)  # values near the largest stay near one
        before, now, rate = q, (image - half * q) * (scale / half), scale
        for _ in range(degree - 1):
            following = 1 / (2 / scale - rate)
            before, now = now, (times(now) - half * now) * (2 * following / half) - before * (rate * following)
            rate = following
        q = np.linalg.qr(now)[0]
    else:
        raise ArithmeticError(f"components are not certified after {most_rounds} rounds: residual {worst:.3g}, largest value {top:.3g}")
    return Components(n, sums, trace, np.maximum(ritz[:wanted], 0.0), q[:, :wanted], residuals, passes)


def whiten(rows: DataFrame, count: int = 8, scale: int = 1024, shift: int = 100000, id_column: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each usable vector a row a component, numbered from 1 by falling variance."""
    spark: SparkSession = rows.sparkSession
    bounded_batches(spark)
    blocks, width = packed(rows, scale, shift, id_column, vector)
    found = components(blocks, width, count, **options)
    n, total, kinds = found.n, np.array(found.sums, object), len(found.values)
    real = found.values > 1e-12 * max(found.trace, 1e-300)
    turn = np.divide(found.vectors, np.sqrt(found.values), out=np.full_like(found.vectors, np.nan), where=real)

    def moment(x: np.ndarray) -> np.ndarray:
        """Sums of whitened values and of their products, the latter below the former."""
        w = centred(x, n, total) @ turn[:, real]
        return np.vstack([w.sum(axis=0), w.T @ w])

    error = 0.0
    if real.any():
        sums = added(blocks, width, moment, (int(real.sum()) + 1, int(real.sum()))) / n
        error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(int(real.sum()))).max())
    share = found.values / found.trace if found.trace else np.zeros(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, width):
            w = centred(x, n, total) @ turn
            per = pa.array(np.repeat(np.arange(len(x)), kinds))
            out = [ids.take(per), pa.array(np.tile(np.arange(1, kinds + 1, dtype=np.int32), len(x))), pa.array(deviations(x, n, total), pa.int64()).take(per), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, len(x)))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "component", "deviation", "whitened", "explained"])

    each = blocks.mapInArrow(tidy(run), "vec_id long, component int, deviation long, whitened double, explained double")
    return each.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
