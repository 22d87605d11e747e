"""What several operators share: scratch tables in the cluster's shared folder, and numpy word kernels for Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side of a join may have and still be sent to every executor (a few MB at the row widths used here).
BROADCAST_ROWS = 200_000
#: Rows that a table of keys may have and still be sent whole, whether its keys are hot or not (under 1 MB).
FEW_ROWS = 20_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of its own only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="kbq-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. A lost executor never loses it."""
    return read_back(df.sparkSession, write_scratch(df, name, partition_by, compression), df.schema)


def write_scratch(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str = "snappy") -> str:
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", compression).parquet(path)
    return path


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most `rows` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of table, which has one row for each key and in `n` the number of rows that have it (null keys match nothing).

    A key with more than its share of the rows (over a quarter of a shuffle partition's mean) is sent to every executor,
    so its rows stay where they are; there are at most four such keys for each partition. The other keys meet by a
    shuffle. A table of few rows is sent whole, and nothing is sent if no key has more than its share: each broadcast
    and each job costs the driver memory. table is read twice: give one that is written.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, total, most = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    least = total / (4 * parts)
    if size <= FEW_ROWS:
        return rows.join(F.broadcast(table.drop("n")), key)
    if most <= least:
        return rows.join(table.drop("n"), key)
    hot, cold = table.where(F.col("n") > least).drop("n"), table.where(F.col("n") <= least).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows of df (all, if it has fewer), chosen by a hash of their keys: the same rows on any cluster, and none pass through one task."""
    n = df.count()
    return df if n <= rows else df.where(F.shiftrightunsigned(F.xxhash64(*keys), 32) < F.lit(int(rows / n * 2**32)))


def n_buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Hash buckets for packed exchanges: they grow with the shuffle partitions the cluster is set to."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space (space, \\t to \\r): distinct words, the index of each word, where each text's words begin.

    A null text has no words. offsets has one entry more than texts.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.not_equal(flat, "")  # white space at either end leaves empty strings
    sizes = np.diff(lists.offsets.to_numpy())
    if flat.null_count or not pc.all(full, min_count=0).as_py():
        keep = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(keep)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat, offsets = flat.filter(full), ends[bounds]
    else:
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets.astype(np.int64)


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` entries, by doubling; len(h) - width + 1 entries (none if h is shorter)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    part, size, base = h, 1, int(_BASE)
    done, length = None, 0  # hash of the leading `length` entries of each run
    left = width
    while left:
        if left & 1:
            if done is None:
                done, length = part, size
            else:  # append `part`, which begins `length` entries on
                n = len(part) - length
                done = done[:n] * np.uint64(base) + part[length:]
                length += size
        left >>= 1
        if left:
            part = part[:-size] * np.uint64(base) + part[size:]
            base, size = base * base % 2**64, size * 2
    return mix(done[: len(h) - width + 1])


def starts_within(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions of the flat word array at which a run of `width` words lies within one text."""
    sizes = np.diff(offsets)
    runs = np.maximum(sizes - width + 1, 0)
    total = int(runs.sum())
    before = np.concatenate([[0], np.cumsum(runs)[:-1]]) if len(runs) else runs
    return np.arange(total) - np.repeat(before - offsets[:-1], runs)


def rows_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each flat position belongs to."""
    return np.searchsorted(offsets, positions, side="right") - 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches of a few MB, so that long texts do not add up in an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run for mapInArrow, giving memory back when a task ends: workers are kept for later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of the text column (a longer text stands alone): bounds a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        ends = np.cumsum(sizes)
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows with one key from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = column(batch, key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if at is not None and keys[a] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The numpy arrays packed into a binary column, one after another."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype)


#: lengths[c]: the byte lengths of the four ids under control byte c.
_LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.int64)


def pack_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    begin = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        long = np.flatnonzero(size > k) if k else slice(None)
        if k and not len(long):
            break
        data[begin[long] + k] = values[long] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def unpack_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    begin = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    values = raw[begin].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(size > k)
        if len(long):
            values[long] |= raw[begin[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def pack_ints(values: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned 32-bit integers in as many bytes as they need; ascending ones as differences."""
    values = values.astype(np.uint32)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    control, data = pack_block(values)
    return np.uint32(len(values)).tobytes() + control + data


def unpack_ints(packed: list[bytes | None], ascending: bool = False) -> np.ndarray:
    """The values of several packs, one after another."""
    out = [np.zeros(0, np.uint32)]
    for pack in packed:
        if pack:
            n = int(np.frombuffer(pack, np.uint32, 1)[0])
            control = -(-n // 4)
            values = unpack_block(pack[4 : 4 + control], pack[4 + control :], n)
            out.append(np.cumsum(values, dtype=np.uint32) if ascending else values)
    return np.concatenate(out)
