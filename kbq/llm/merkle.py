"""A Merkle manifest of a table: a leaf for each row, an eight-ary tree for each language, one tree over the languages' roots.

Digests are lowercase hex SHA-256 of concatenated hex digests. Leaves of a tree ascend by doc_id (nulls first, equal ids
by their leaf); every eight consecutive nodes of a level, the last run fewer, become one of the next until one is left.

Proofs are octopus multiproofs: a leaf partition holds up to 512 consecutive leaves of a tree. It computes the smallest
union of node coordinates that it can't derive itself, fetches those once, derives the interiors that its leaves share,
and expands each leaf's own proof from them locally. Upper levels of the tree are few nodes and are broadcast when they
are counted to be; the others meet by a shuffle, in which no node is asked for by more than a small share of the
partitions. Nothing passes through the driver but the greatest number of leaves and nodes a level.

Nulls: a null field counts as `-`, a null lang is a tree of its own, before the others. Empty and very long texts are
hashed whole within the JVM. Repeated rows are leaves of their own. An empty table gives no rows. Columns other than the
five are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbq.llm.common import BROADCAST_ROWS, bounded_batches, column, join_hot, materialise, small, tidy

_RUN = 8
#: Levels that a leaf partition derives alone, and its leaves.
_LEVELS = 3
_BLOCK = _RUN**_LEVELS

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields, each `-` if null, else its UTF-8 length in bytes, a colon and itself."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // _RUN))
    return out


def missing(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that who has leaves first..last-1 of n still needs for the proofs of all of them."""
    out = []
    for level, size in enumerate(sizes(n)[:-1]):
        low, high = first // _RUN * _RUN, min(-(-last // _RUN) * _RUN, size)
        out += [(level, i) for i in (*range(low, first), *range(last, high))]
        first, last = low // _RUN, -(-high // _RUN)
    return out


class Partition:
    """A leaf partition with the nodes it fetched: its levels, the root they lead to, and each leaf's siblings."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.first, self.levels = first, []
        for level, size in enumerate(sizes(n)[:-1]):
            low, high = first // _RUN * _RUN, min(-(-(first + len(leaves)) // _RUN) * _RUN, size)
            held = [fetched[level, i] for i in range(low, first)] + leaves + [fetched[level, i] for i in range(first + len(leaves), high)]
            self.levels.append((low, held))
            first, leaves = low // _RUN, [node(held[i : i + _RUN]) for i in range(0, len(held), _RUN)]
        self.root = leaves[0]

    def run(self, level: int, place: int) -> list[str]:
        low, held = self.levels[level]
        at = place // _RUN * _RUN - low
        return held[at : at + _RUN]

    def proofs(self, count: int) -> list[str]:
        """Siblings, level by level and left to right, of `count` leaves from the first on; what leaves share is joined once."""
        above = {0: ""}
        for level in range(len(self.levels) - 1, -1, -1):
            low, held = self.levels[level]
            span = range(self.first, self.first + count) if level == 0 else range(self.first // _RUN**level, (self.first + count - 1) // _RUN**level + 1)
            now = {}
            for i in span:
                at = i // _RUN * _RUN - low
                now[i] = "".join(held[at : i - low]) + "".join(held[i - low + 1 : at + _RUN]) + above[i // _RUN]
            above = now
        return [above[i] for i in range(self.first, self.first + count)] if self.levels else [""] * count

    def path(self, place: int) -> list[tuple[int, list[str]]]:
        """(place in the run, the run) on each level above a leaf."""
        out = []
        for level in range(len(self.levels)):
            out.append((place % _RUN, self.run(level, place)))
            place //= _RUN
        return out

    def fold(self, place: int, digest: str) -> str:
        """The root that another digest at a leaf's place leads to, with the siblings as they are."""
        return fold(digest, self.path(place))


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    for at, run in path:
        digest = node([*run[:at], digest, *run[at + 1 :]])
    return digest


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place within their tree by `order`, and n, the tree's rows. rows is read more than once: give one that is written.

    Rows are dealt by range, so a large tree lies in many partitions; what precedes a partition is added from counts a partition.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("rank", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = np.array(column(batch, "tree").to_pylist(), object)
            ranks = np.empty(len(names), np.int64)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if names[a] != at:
                    at, seen = names[a], 0
                ranks[a:b] = np.arange(seen, seen + b - a)
                seen += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(names), part, np.int64)), pa.array(ranks)], names=[*batch.schema.names, "part", "rank"])

    by = ["tree", *order]
    numbered = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, schema), "numbered")
    counts = materialise(numbered.groupBy("tree", "part").agg(F.count("*").alias("rows")), "counts")
    before = F.expr("sum(rows) over (partition by tree order by part rows between unbounded preceding and 1 preceding)")
    offsets = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.expr("sum(rows) over (partition by tree)").alias("n"))
    return numbered.join(small(materialise(offsets, "offsets")), ["tree", "part"]).withColumn("pos", F.col("before") + F.col("rank")).drop("part", "rank", "before")


def _of_rows(step: Callable[[dict], list[dict]], schema: pa.Schema) -> Callable:
    """A mapInArrow function from one that gives rows for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from pa.Table.from_pylist(step(r), schema).to_batches()

    return tidy(run)


_NODES = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())])
_NODES_SQL = "tree string, level int, place long, n long, digest string, top boolean"


def build(blocks: DataFrame, most: int) -> DataFrame:
    """(tree, level, place, n, digest, top): the nodes from the level of leaf partitions upward; top marks a tree's root. blocks: tree, block, n, items (pos, digest, ...); most: leaves of the largest tree."""

    def climb(r: dict, base: int, keep: bool) -> list[dict]:
        held = [x["digest"] for x in sorted(r["items"], key=lambda x: x["pos"])]
        count = len(sizes(r["n"])) - 1
        found, place, level = [], r["block"] * _BLOCK, base
        while level < min(base + _LEVELS, count):
            held, place, level = [node(held[i : i + _RUN]) for i in range(0, len(held), _RUN)], place // _RUN, level + 1
            if keep or level == base + _LEVELS or level == count:
                found += [{"tree": r["tree"], "level": level, "place": place + i, "n": r["n"], "digest": d, "top": level == count} for i, d in enumerate(held)]
        return found or [{"tree": r["tree"], "level": base, "place": 0, "n": r["n"], "digest": held[0], "top": True}]

    nodes = materialise(blocks.mapInArrow(_of_rows(lambda r: climb(r, 0, False), _NODES), _NODES_SQL), "nodes")
    base, every = _LEVELS, nodes
    while base < len(sizes(most)) - 1:
        grouped = every.where(~F.col("top") & (F.col("level") == base)).groupBy("tree", F.expr(f"place div {_BLOCK}").alias("block"), "n").agg(F.collect_list(F.struct(F.col("place").alias("pos"), "digest")).alias("items"))
        every = every.unionByName(materialise(grouped.mapInArrow(_of_rows(lambda r, b=base: climb(r, b, True), _NODES), _NODES_SQL), "nodes"))
        base += _LEVELS
    return every


def fetched(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """blocks with `got`, the nodes (level, place, digest) that a leaf partition can't derive, each fetched once."""
    coordinate = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int64())]))
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("wanted", coordinate)])

    def ask(r: dict) -> list[dict]:
        first = r["block"] * _BLOCK
        return [{"tree": r["tree"], "block": r["block"], "wanted": [{"level": a, "place": b} for a, b in missing(first, min(first + _BLOCK, r["n"]), r["n"])]}]

    asked = blocks.select("tree", "block", "n").mapInArrow(_of_rows(ask, schema), "tree string, block long, wanted array<struct<level:int,place:long>>")
    wanted = asked.select("tree", "block", F.explode("wanted").alias("w")).select("tree", "block", "w.*")
    held = nodes.select("tree", "level", "place", "digest")
    counts = {r["level"]: r["count"] for r in held.groupBy("level").count().collect()}  # a row for each level of the tree
    low = max(counts, default=0) + 1
    while low - 1 in counts and sum(counts[k] for k in counts if k >= low - 1) <= BROADCAST_ROWS:
        low -= 1
    key = ["tree", "level", "place"]
    found = wanted.where(F.col("level") >= low).join(F.broadcast(held.where(F.col("level") >= low)), key)
    if low > _LEVELS:
        found = found.unionByName(wanted.where(F.col("level") < low).join(held.where(F.col("level") < low), key))
    got = found.groupBy("tree", "block").agg(F.collect_list(F.struct("level", "place", "digest")).alias("got"))
    return blocks.join(got, ["tree", "block"], "left")


def _partition(r: dict) -> tuple[Partition, list[dict]]:
    items = sorted(r["items"], key=lambda x: x["pos"])
    return Partition(items[0]["pos"], [x["digest"] for x in items], r["n"], {(x["level"], x["place"]): x["digest"] for x in r["got"] or []}), items


def forest(rows: DataFrame, order: list[str], carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaf partitions with what they fetched, root a tree) of rows (tree, digest, ...): trees of the digests by `order`."""
    placed = positions(rows, order)
    blocks = materialise(placed.groupBy("tree", F.expr(f"pos div {_BLOCK}").alias("block"), "n").agg(F.collect_list(F.struct("pos", "digest", *carry)).alias("items")), "leaf-partitions")
    most = blocks.agg(F.max("n")).first()[0]
    nodes = build(blocks, most or 1)
    return materialise(fetched(blocks, nodes), "partitions"), nodes.where("top").select("tree", F.col("digest").alias("subroot"), "n")


def proofs(docs: DataFrame, every: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs.

    Rows of which `every` divides the CRC-32 of the doc_id are tampered with: their texts' A-Z are lower-cased (every 0:
    none). folded_root is what the leaf, tampered with or not, and its siblings lead to; verified, whether that is root.
    """
    bounded_batches(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    changed = [*fields[:-1], F.translate(F.col("text").cast("string"), _UPPER, _LOWER)]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0 if every else F.lit(False)
    name = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    leaves = materialise(docs.select(name.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), F.when(chosen, leaf(changed)).alias("tampered")), "leaves", compression="zstd")
    parts, roots = forest(leaves, ["doc_id", "digest"], ["doc_id", "tampered"])
    tops = materialise(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"), F.col("n").alias("leaves")), "subroots")
    upper, root = forest(tops, ["name"], ["name", "leaves"])
    step = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))
    paths_schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("subroot", pa.string()), ("path", step)])

    def paths(r: dict) -> list[dict]:
        whole, items = _partition(r)
        return [{"tree": x["name"], "n": -(-x["leaves"] // _BLOCK), "subroot": x["digest"], "path": [{"at": a, "run": b} for a, b in whole.path(x["pos"])]} for x in items]

    of_tree = upper.mapInArrow(_of_rows(paths, paths_schema), "tree string, n long, subroot string, path array<struct<at:int,run:array<string>>>")
    of_tree = materialise(of_tree.join(F.broadcast(root.select(F.col("subroot").alias("root")))), "paths")
    out = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])

    def expand(r: dict) -> list[dict]:
        whole, items = _partition(r)
        above = [(x["at"], x["run"]) for x in r["path"]]
        beside = "".join("".join(run[:at] + run[at + 1 :]) for at, run in above)
        same, found = fold(whole.root, above), []
        for x, siblings in zip(items, whole.proofs(len(items))):
            folded = same if x["tampered"] in (None, x["digest"]) else fold(whole.fold(x["pos"], x["tampered"]), above)
            found.append({"doc_id": x["doc_id"], "leaf": x["digest"], "subroot": r["subroot"], "root": r["root"], "proof_sha256": sha256((siblings + beside).encode()).hexdigest(), "folded_root": folded, "verified": folded == r["root"]})
        return found

    whole = join_hot(parts.withColumnRenamed("n", "in_tree"), of_tree, "tree").withColumnRenamed("in_tree", "n")
    return whole.mapInArrow(_of_rows(expand, out), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _levels_sql(name: str, levels: int) -> str:
    """Levels 0 to `levels` of the trees in `<name>0` (tree, pos, n, digest), where n is the number of nodes of the level."""
    parts = []
    for k in range(levels):
        parts.append(f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 8, n)")
        parts.append(f"{name}s{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos), '') AS siblings, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind FROM {name}{k} a LEFT JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY a.tree, a.pos)")
    return ",\n".join(parts)


def _oracle(levels: int = 7, upper: int = 2) -> str:
    """SQL for trees of at most 8**levels leaves and 8**upper languages."""
    field = lambda c: f"(CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END)"
    fields = " || ".join(field(c) for c in FIELDS)
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    changed = " || ".join(field(c) if c != "text" else f"(CASE WHEN text IS NULL THEN '-' ELSE strlen({lower})::VARCHAR || ':' || {lower} END)" for c in FIELDS)
    step = "list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor(crc, b))"
    crc = f"xor(list_reduce([ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')], lambda crc, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
    proof, joins, fold_sql = [], [], "l.given"
    for k in range(levels):
        joins.append(f"LEFT JOIN ts{k} ON ts{k}.tree = l.tree AND ts{k}.pos = l.pos // {8**k}")
        proof.append(f"coalesce(ts{k}.siblings, '')")
        fold_sql = f"(CASE WHEN ts{k}.pos IS NULL THEN {fold_sql} ELSE sha256(ts{k}.before || {fold_sql} || ts{k}.behind) END)"
    up_proof, up_joins, up_fold = [], [], "p.folded_subroot"
    for k in range(upper):
        up_joins.append(f"LEFT JOIN us{k} ON us{k}.pos = u.pos // {8**k}")
        up_proof.append(f"coalesce(us{k}.siblings, '')")
        up_fold = f"(CASE WHEN us{k}.pos IS NULL THEN {up_fold} ELSE sha256(us{k}.before || {up_fold} || us{k}.behind) END)"
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM t{k} WHERE n = 1" for k in range(levels + 1))
    top_roots = " UNION ALL ".join(f"SELECT digest FROM u{k} WHERE n = 1" for k in range(upper + 1))
    return f"""
WITH hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({fields}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({changed}) ELSE sha256({fields}) END AS given FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
t0 AS (SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM l),
{_levels_sql("t", levels)},
subroots AS ({tops}),
u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM subroots),
u_of AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots),
{_levels_sql("u", upper)},
top AS ({top_roots}),
p AS (SELECT l.tree, l.doc_id, l.leaf, {" || ".join(proof)} AS proof, {fold_sql} AS folded_subroot FROM l {" ".join(joins)}),
q AS (SELECT p.doc_id, p.leaf, u.subroot, (SELECT digest FROM top) AS root, sha256(p.proof || {" || ".join(up_proof)}) AS proof_sha256, {up_fold} AS folded_root FROM p JOIN u_of u ON u.name = p.tree {" ".join(up_joins)})
SELECT *, folded_root = root AS verified FROM q
"""


ORACLE_SQL = {"op12_merkle": _oracle()}
