"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Texts are encoded with the tokenizers library and an end id is appended to each. Ids are counted over the whole corpus
and ranked by frequency, so that frequent ids take one byte, others two, three or four. A block of a file holds the
documents' numbers and lengths, a control stream (two bits an id: its number of bytes less one, four ids a byte) and a
data stream. Decoding looks a control byte up in a table of 256 rows that gives the lengths of its four ids, and
gathers the data bytes in numpy; nothing is decoded id by id. The ids by rank lie beside the blocks, so that a folder
can be read without anything else.

Files are parts of a range partitioning by doc_id, each sorted by it (rows with one doc_id by their text's hash, null
doc_ids first), written by Spark's own committer.

For byte-level models with the usual splitting pattern, a text is cut into units: before each run of spaces and line
feeds that follows no other white space, and between a letter and a mark (ASCII). No piece of the pattern crosses such
a place, so the library encodes each distinct unit once a worker, many in one call; what belongs to which unit follows
from the pieces' lengths in bytes. Added tokens (special ones) are cut out first, as the library does. Models of any
other make encode whole texts in the library.

Nulls are empty texts: they have the end id alone. Every row gives a row; no rows give no rows. Texts of any length are
encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kbq.llm.common import bounded_batches, column, materialise, pack_block, read_back, scratch_root, slices, small, tidy, unpack_block

_BLOCK = 1 << 20
#: Units that a worker keeps, and units that one call of the library encodes.
_KEPT = 1_000_000
_TOGETHER = 2000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _flags(codes: str) -> np.ndarray:
    """Which byte values are those of the (ASCII) characters."""
    out = np.zeros(256, bool)
    out[np.frombuffer(codes.encode(), np.uint8)] = True
    return out


_BREAK = _flags(" \n")
_LETTER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARK = _flags("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
#: ASCII that some libraries count as white space.
_SPACE = _flags("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")


def _ends_in_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000)."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    general = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
    return (one >= 0x80) & (((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | general | ((three == 0xE3) & (two == 0x80) & (one == 0x80)))


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after another, and where each text's units begin (one entry more than texts)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    before, after = data[:-1], data[1:]
    white = np.flatnonzero(_BREAK[after] & ~_SPACE[before]) + 1
    white = white[~_ends_in_white(data, white)]
    starts = np.zeros(len(data) + 1, bool)
    starts[white] = True
    starts[1:-1] |= _LETTER[before] & _MARK[after]
    starts[bounds] = True
    starts[len(data)] = True
    cuts = np.flatnonzero(starts).astype(np.int32)
    units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    return units, np.searchsorted(cuts, bounds)


class CachedTokenizer:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each core a worker of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        added = {t["content"]: t["id"] for t in made["added_tokens"]}
        splitter = made["pre_tokenizer"] or {}
        self.by_unit = (
            splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter["add_prefix_space"]
            and made["model"]["type"] == "BPE" and not made["model"]["dropout"] and not made["model"].get("unk_token") and all(made[k] is None for k in ("normalizer", "truncation", "padding"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"])
        )
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.n_bytes = np.zeros(self.size, np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = len(piece.encode()) if piece in added else len(piece)  # a letter of a piece stands for a byte
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> pa.Array:
        """Have the library encode new units; returns them as they are kept. Units that begin with a break and do not end in white space are strung together, others go by themselves."""
        apart = [u[0] not in " \n" or u[-1].isspace() or u[-1] in "\x1c\x1d\x1e\x1f\x85" for u in units]
        strung = [u for u, a in zip(units, apart) if not a]
        single = [u for u, a in zip(units, apart) if a]
        order = pa.array(strung + single, pa.string())
        calls = [["".join(strung[i : i + _TOGETHER])] for i in range(0, len(strung), _TOGETHER)] + [single[i : i + _TOGETHER] for i in range(0, len(single), _TOGETHER)]
        ids = [np.array(e.ids, np.int32) for call in calls for e in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)] + [np.zeros(0, np.int32)]
        flat = np.concatenate(ids)
        ends = np.cumsum(pc.binary_length(order).to_numpy(), dtype=np.int64)
        stops = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends, side="left") + 1
        self.known = pa.concat_arrays([self.known, order])
        self.flat = np.concatenate([self.flat, flat])
        self.length = np.concatenate([self.length, np.diff(stops, prepend=0)])
        return order

    def _entries(self, units: pa.Array) -> np.ndarray:
        """The place of each unit among the kept ones, after learning those that are new."""
        first = len(self.known)
        found = pc.index_in(units, value_set=self.known)
        entry = found.fill_null(0).to_numpy().copy()
        if found.null_count:
            new = units.filter(found.is_null())
            learned = self._learn(new.unique().to_numpy(zero_copy_only=False).tolist())
            entry[found.is_null().to_numpy(zero_copy_only=False)] = first + pc.index_in(new, value_set=learned).to_numpy()
        return entry

    def _segments(self, texts: pa.Array, end: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts cut at added tokens: the pieces, the id that follows each, and where each text's pieces begin."""
        lists = [self.at_added.split(t) for t in texts.to_pylist()]
        pieces = [x for parts in lists for x in parts[::2]]
        after = [i for parts in lists for i in [*(self.added[x] for x in parts[1::2]), end]]
        sizes = np.array([(len(parts) + 1) // 2 for parts in lists], np.int64)
        return pa.array(pieces, pa.string()), np.array(after, np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with `end` after it, and where each one's ids begin (one entry more than texts). Nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_unit:
            lists = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, end] for t in texts.to_pylist()]
            return np.array([i for ids in lists for i in ids], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        after, of_text = np.full(len(texts), end, np.int32), None
        if self.added and pc.any(pc.match_substring_regex(texts, self.at_added.pattern)).as_py():
            texts, after, of_text = self._segments(texts, end)
        if len(self.length) > _KEPT:
            self.forget()
        units, bounds = units_of(texts)
        entry = self._entries(units)
        begin = np.cumsum(self.length) - self.length
        size = self.length[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat((begin[entry] - ends[:-1]).astype(np.int32), size) + np.arange(ends[-1], dtype=np.int32)]
        stops = ends[bounds] + np.arange(len(bounds))  # the ids that follow move later texts on
        ids = np.empty(int(stops[-1]), np.int32)
        last = np.zeros(len(ids), bool)
        last[stops[1:] - 1] = True
        ids[last], ids[~last] = after, flat
        return ids, stops if of_text is None else stops[of_text]


_LOADED: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]


def tokenise(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """(doc_id, tie, ids): each row's ids as compressed 32-bit or, where the vocabulary allows, 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        kind = np.uint16 if tokenizer.size <= 1 << 16 else np.uint32
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text", 8 << 20):
            ids, bounds = tokenizer.encode(column(batch, "text"), end)
            ids = ids.astype(kind)
            packed = [pack(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tie"), pa.array(packed, pa.binary())], names=["doc_id", "tie", "ids"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, tie long, ids binary")


def _unpacked(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    lists = [np.frombuffer(unpack(x), kind) for x in column(batch, "ids").to_pylist()]
    return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)


def ranks(tokenised: DataFrame, vocabulary: int, kind) -> np.ndarray:
    """Ids by falling frequency over the corpus, the smaller of equals first. At most one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                counts += np.bincount(_unpacked(batch.slice(at, 500), kind)[0], minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    found = tokenised.select("ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return np.argsort(-counts, kind="stable").astype(np.uint32)


_FILE = "part int, block int, n_docs long, n_tokens long, doc_ids binary, has_id binary, lengths binary, control binary, data binary"
_RANKS = "ids binary"


def write_files(docs: DataFrame, target: str | None = None, path: str | None = None, end: int = 0) -> str:
    """Write docs' ids below `target` (a folder of the shared storage; scratch if not given), as blocks and the ids by rank; its path."""
    path = path or default_tokenizer()
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    tokenised = materialise(tokenise(docs, path, end), "tokens")
    by_rank = ranks(tokenised, vocabulary, kind)
    rank_of = np.argsort(by_rank).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, block, part = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([x[1] for x in held])
            names = pa.concat_arrays([x[2] for x in held])
            control, data = pack_block(rank_of[ids])
            row = [part, block, len(lengths), len(ids), names.fill_null(0).to_numpy().tobytes(), np.packbits(names.is_valid().to_numpy(zero_copy_only=False)).tobytes(), lengths.tobytes(), control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in _FILE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                part = column(some, "part")[0].as_py()
                ids, lengths = _unpacked(some, kind)
                held.append((ids, lengths, column(some, "doc_id")))
                total += len(ids)
                if total >= _BLOCK:
                    yield flush()
                    held, total, block = [], 0, block + 1
        if held:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokenised.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", F.spark_partition_id().alias("part"), "ids").mapInArrow(tidy(run), _FILE)
    target = target or f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    blocks.write.parquet(f"{target}/blocks")
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], _RANKS).coalesce(1).write.parquet(f"{target}/ranks")
    return target


def read_files(spark: SparkSession, target: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files below `target` alone."""
    blocks = read_back(spark, f"{target}/blocks", _FILE)
    by_rank = np.frombuffer(read_back(spark, f"{target}/ranks", _RANKS).first()["ids"], np.uint32)  # one entry per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[unpack_block(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                lengths = np.frombuffer(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                has_id = np.unpackbits(np.frombuffer(row["has_id"], np.uint8))[: len(lengths)].astype(bool)
                size = len(lengths)
                out = {"part": pa.array([row["part"]] * size, pa.int32()), "block": pa.array([row["block"]] * size, pa.int32()), "doc_id": pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=~has_id), "inner": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    read = blocks.select("part", "block", "n_tokens", "doc_ids", "has_id", "lengths", "control", "data").mapInArrow(tidy(run), "part int, block int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    heads = blocks.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    within = heads.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n"))
    parts = heads.groupBy("part").agg(F.sum("n").alias("total"))  # one row a file
    above = parts.withColumn("above", F.sum("total").over(Window.orderBy("part")) - F.col("total")).select("part", "above")
    offsets = within.join(small(above), "part").select("part", "block", (F.col("above") + F.col("before")).alias("base"))
    out = read.join(small(offsets), ["part", "block"]).withColumn("start", F.col("base") + F.col("inner"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(spark, write_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
