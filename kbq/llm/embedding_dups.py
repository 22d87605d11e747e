"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Vectors of one direction are one node, so copies meet in a row count only. A table's key is k signs of a node's products
with random hyperplanes; k grows with the logarithm of the number of nodes, and there are so many tables that a pair at
the threshold misses all of them with probability `miss` at most. Vectors and hyperplanes are rounded to integers for
the signs, whose products are exact in floating point: a node has the same keys wherever they are computed.

Under each key first only sketches of 128 signs meet; nodes without a partner within the distance that linked pairs stay
below (but for `miss`) bring no vector. The others are compared exactly, in double precision. A pair counts in the first
table in which it meets, and what leaves a key is a count a node and a forest of links, never all pairs.

Dense groups are taken out before: balls about leaders within half the threshold's angle, in which every pair is linked
without a comparison. Leaders come from a bounded sample (`sample` rows) and only decide how pairs are found. By the
triangle inequality a node is linked with all of a ball, with none of it, or is compared with its members. Keys with more
than `_CAP` nodes are cut into parts, of which each pair meets in a cell of its own, so no task holds more than two parts.

Null, zero and empty vectors, and those with null or non-finite components, link with nothing and are their own classes.
Vectors of different width are compared as if the shorter ended in zeros. Rows with a null vec_id are kept; a class's id
is its smallest vec_id that is not null. Repeated rows each count as vectors. An empty table gives an empty result.
Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import bounded_batches, column, hash_sample, join_hot, materialise, small, tidy
from kbq.llm.simhash import components

#: Nodes of a key, or of a part of one, that are compared with each other in one task.
_CAP = 4096
#: Pairs compared at once.
_CELLS = 1 << 20
_SKETCH = 128
#: Angles are compared with this much to spare; cosines near one give them to about 1e-8.
_SPARE = 1e-6
_TABLE_SHIFT = 40
#: Keys of balls have table number -1 - ball.
_MOST_BALLS = 64


def dense(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, usable): vectors as rows of doubles, shorter ones ending in zeros; usable are those not null, with finite entries only and not all zero."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), width))
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    finite = np.isfinite(out).all(axis=1) & lists.is_valid().to_numpy(zero_copy_only=False)
    return out, finite & (out != 0).any(axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; very large and small entries don't overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)) + 0.0


def directions(rows: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, int]:
    """((vec_id, key, unit) of all rows, width): key is a digest of the direction, null for vectors that link with nothing."""
    width = int(rows.agg(F.max(F.size(vector))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, usable = dense(batch.column(1), max(width, 1))
            units = np.zeros_like(vectors)
            units[usable] = unit(vectors[usable])
            packed = [u.tobytes() if ok else None for u, ok in zip(units, usable)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p and md5(p).digest() for p in packed], pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "key", "unit"])

    given = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>"))
    return materialise(given.mapInArrow(tidy(run), "vec_id long, key binary, unit binary"), "directions"), max(width, 1)


class Tables:
    """Hyperplanes and how many of them: `count` tables of `k` signs for n nodes, cosine `least` and a chance to miss a pair."""

    def __init__(self, n: int, width: int, least: float, miss: float, seed: int):
        same = 1 - math.acos(least) / math.pi
        self.k = min(max(6, math.ceil(math.log2(max(n, 1) / 128))), _TABLE_SHIFT - 1)
        self.count = max(math.ceil(math.log(miss) / math.log1p(-(same**self.k))), -(-_SKETCH // self.k))
        self.planes = np.round(np.random.default_rng(seed).standard_normal((width, self.count * self.k)) * 2**12)
        tail, self.distance = 1.0, -1
        while tail > miss / 10:  # the least distance that a linked pair's sketches exceed with a tenth of that chance
            self.distance += 1
            tail -= math.comb(_SKETCH, self.distance) * (1 - same) ** self.distance * same ** (_SKETCH - self.distance)

    def signs(self, units: np.ndarray) -> np.ndarray:
        return np.round(units * 2**20) @ self.planes > 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """(nodes, tables) matrix of keys."""
        bits = signs.reshape(-1, self.k).astype(np.float64) @ 2.0 ** np.arange(self.k)
        return bits.astype(np.int64).reshape(len(signs), self.count)

    def sketches(self, signs: np.ndarray) -> np.ndarray:
        """(nodes, 2) matrix of 64-bit words."""
        return np.ascontiguousarray(np.packbits(signs[:, :_SKETCH], axis=1)).view(np.int64)


def leaders(units: np.ndarray, reach: float, share: float = 0.01, fewest: int = 8) -> np.ndarray:
    """Centres of the densest parts of a sample, each the mean direction of at least `share` of it (and `fewest`) within the angle `reach` of one of them."""
    found, left = [], units
    while len(found) < _MOST_BALLS and len(left) >= max(fewest, share * len(units)):
        near = left @ left.T >= math.cos(reach)
        best = int(near.sum(axis=1).argmax())
        if near[best].sum() < max(fewest, share * len(units)):
            break
        found.append(unit(left[near[best]].mean(axis=0, keepdims=True))[0])
        left = left[left @ found[-1] < math.cos(reach)] if (left @ found[-1] >= math.cos(reach)).any() else left[~near[best]]
    return np.array(found).reshape(-1, units.shape[1])


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def _units(batch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column(batch, "unit").to_pylist()), np.float64).reshape(-1, width)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin and end) from batches sorted by key and cell; a group is never cut."""
    held: list[pa.RecordBatch] = []

    def give() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, cell = (rows.column(c).to_numpy() for c in ("key", "cell"))
        return rows, np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(key)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, cuts = give()
        if len(cuts) > 2:
            last = int(cuts[-2])
            yield rows.slice(0, last).combine_chunks(), cuts[:-1]
            held = rows.slice(last).to_batches()
    if held:
        yield give()


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sides are compared: 2 with 2 in a cell of one part, 0 with 1 in a cell of two."""
    return (a[:, None] + b[None, :] == 1) | ((a[:, None] == 2) & (b[None, :] == 2))


_MEETING = "key long, cell long, side int, node long"


def sketch_partners(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """The rows (key, cell, side, node) whose sketch is within `distance` of another's in their group."""
    for rows, cuts in whole_groups(batches):
        one, two = (rows.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))
        side = rows.column("side").to_numpy()
        keep = np.zeros(len(side), bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            step = max(1, _CELLS // (b - a))
            for at in range(a, b if b - a > 1 else a, step):
                end = min(at + step, b)
                differ = np.bitwise_count(one[at:end, None] ^ one[None, a:b]) + np.bitwise_count(two[at:end, None] ^ two[None, a:b])
                near = (differ <= distance) & _meets(side[at:end], side[a:b])
                near[np.arange(end - at), np.arange(at - a, end - a)] = False
                keep[at:end] = near.any(axis=1)
        if keep.any():
            yield from rows.select(["key", "cell", "side", "node"]).filter(pa.array(keep)).to_batches()


def exact_links(batches: Iterator[pa.RecordBatch], tables: Tables, width: int, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, n): for a node its links first met in this group, as n with b null; and links a-b that connect what is linked."""
    for rows, cuts in whole_groups(batches):
        units = _units(rows, width)
        node, copies, side, key = (rows.column(c).to_numpy() for c in ("node", "copies", "side", "key"))
        keys = tables.keys(tables.signs(units))
        found = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            table = int(key[a]) >> _TABLE_SHIFT
            count, label = np.zeros(b - a, np.int64), np.arange(b - a)
            step = max(1, _CELLS // (b - a))
            for at in range(a, b, step):
                end = min(at + step, b)
                linked = (units[at:end] @ units[a:b].T >= least) & _meets(side[at:end], side[a:b])
                linked[np.arange(end - at), np.arange(at - a, end - a)] = False
                i, j = np.nonzero(linked)
                for x in np.flatnonzero(linked.any(axis=1)):
                    near = np.flatnonzero(linked[x])
                    x += at - a
                    others = near[label[near] != label[x]]
                    if len(others):
                        labels, first = np.unique(label[others], return_index=True)
                        found[0].append(np.repeat(node[a + x], len(first)))
                        found[1].append(node[a + others[first]])
                        found[2].append(np.zeros(len(first), np.int64))
                        label[np.isin(label, labels)] = label[x]
                i += at - a
                earlier = np.zeros(len(i), bool)
                for t in range(max(table, 0)):
                    earlier |= keys[a + i, t] == keys[a + j, t]
                np.add.at(count, i[~earlier], copies[a + j[~earlier]])
            some = np.flatnonzero(count)
            found[0].append(node[a + some])
            found[1].append(np.full(len(some), -1))
            found[2].append(count[some])
        if found[0]:
            x, y, n = (np.concatenate(f) for f in found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64(), mask=y < 0), pa.array(n, pa.int64())], names=["a", "b", "n"])


def dealt(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """entries (key, node, ...) with the cells that each takes part in: of keys in sizes (key, parts) one for each pair of parts, else one."""
    parts = F.coalesce("parts", F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("node"), parts)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct((F.least("own", j) * F.col("parts") + F.greatest("own", j)).alias("cell"), F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("side")))
    joined = entries.join(small(sizes), "key", "left").withColumn("own", own).withColumn("parts", parts)
    return joined.select(*entries.columns, F.explode(cells).alias("c")).select(*entries.columns, "c.cell", "c.side")


def table_meetings(nodes: DataFrame, tables: Tables, width: int) -> DataFrame:
    """(key, cell, side, node) of nodes outside of balls that a sketch near their own meets under a key."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.arange(tables.count, dtype=np.int64) << _TABLE_SHIFT
        for batch in batches:
            if batch.num_rows:
                signs = tables.signs(_units(batch, width))
                keys, sketch = tables.keys(signs) | head, tables.sketches(signs)
                per = np.repeat(np.arange(batch.num_rows), tables.count)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), column(batch, "node").take(pa.array(per)), pa.array(sketch[per, 0]), pa.array(sketch[per, 1])], names=["key", "node", "s0", "s1"])

    made = nodes.where("ball is null").select("node", "unit").mapInArrow(tidy(entries), "key long, node long, s0 long, s1 long")
    hot = materialise(made.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > _CAP).select("key", F.ceil(F.col("n") / _CAP).alias("parts")), "hot-keys")
    sorted_rows = dealt(made, hot).repartition("key", "cell").sortWithinPartitions("key", "cell")
    distance = tables.distance
    return sorted_rows.mapInArrow(tidy(lambda batches: sketch_partners(batches, distance)), _MEETING)


def ball_relations(nodes: DataFrame, centres: np.ndarray, balls: dict[int, dict], theta: float, width: int) -> DataFrame:
    """(node, copies, other, all): balls of which a node outside is linked with every member (all) or may be with some; of two balls the one with the smaller number is met by the other's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = angles(_units(batch, width), centres)
            own = pc.fill_null(column(batch, "ball"), len(centres)).to_numpy(zero_copy_only=False)
            for c, b in balls.items():
                near = (apart[:, c] < theta + b["radius"] + _SPARE) & (own > c)
                every = apart[near, c] <= theta - b["radius"] - _SPARE
                mask = pa.array(near)
                yield pa.RecordBatch.from_arrays([column(batch, "node").filter(mask), column(batch, "copies").filter(mask), pa.array(np.full(len(every), c, np.int32)), pa.array(every)], names=["node", "copies", "other", "all"])

    return nodes.select("node", "copies", "ball", "unit").mapInArrow(tidy(run), "node long, copies long, other int, all boolean")


def ball_meetings(nodes: DataFrame, near: DataFrame, balls: dict[int, dict]) -> DataFrame:
    """(key, cell, side, node): members of a ball and the nodes that may be linked with some of them, in parts of which each two meet once."""
    parts = lambda n: F.lit(-(-n // _CAP)).cast("long")
    asked = {r["other"]: r["count"] for r in near.groupBy("other").count().collect()}  # a row a ball at most
    out = nodes.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), "node").where("false")
    for c, n in asked.items():
        rows, columns = parts(balls[c]["members"]), parts(n)
        key = F.lit((-1 - c) << _TABLE_SHIFT).cast("long")
        across = lambda own, row, other: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda j: row(F.pmod(F.xxhash64("node"), own), j)))
        members = nodes.where(F.col("ball") == c).select(key.alias("key"), across(rows, lambda i, j: i * columns + j, columns).alias("cell"), F.lit(1).alias("side"), "node")  # noqa: B023
        others = near.where(F.col("other") == c).select(key.alias("key"), across(columns, lambda j, i: i * columns + j, rows).alias("cell"), F.lit(0).alias("side"), "node")  # noqa: B023
        out = out.unionByName(members).unionByName(others)
    return out


def near_duplicates(rows: DataFrame, least: float = 0.9, miss: float = 1e-4, seed: int = 42, sample: int = 2000, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row: links are pairs with a cosine of `least` (above 0) or more."""
    spark: SparkSession = rows.sparkSession
    bounded_batches(spark)
    every, width = directions(rows, id_column, vector)
    distinct = every.where("key is not null").groupBy("key", "unit").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    plain = materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "key", "unit", "copies", "first"), "nodes")
    theta = math.acos(least)
    drawn = hash_sample(plain, sample, "node").select("unit").limit(2 * sample).collect()
    centres = leaders(np.frombuffer(b"".join(bytes(r["unit"]) for r in drawn), np.float64).reshape(-1, width), theta / 2 - 2 * _SPARE)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ball, apart = np.zeros(n, np.int32), np.full(n, math.pi)
            if n and len(centres):
                all_angles = angles(_units(batch, width), centres)
                ball = all_angles.argmin(axis=1).astype(np.int32)
                apart = all_angles[np.arange(n), ball]
            outside = apart > theta / 2 - 2 * _SPARE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball, pa.int32(), mask=outside), pa.array(apart, pa.float64(), mask=outside)], names=[*batch.schema.names, "ball", "apart"])

    nodes = materialise(plain.mapInArrow(tidy(assign), "node long, key binary, unit binary, copies long, first long, ball int, apart double"), "assigned")
    tables = Tables(plain.count(), width, least, miss, seed)
    balls = {r["ball"]: r.asDict() for r in nodes.where("ball is not null").groupBy("ball").agg(F.max("apart").alias("radius"), F.sum("copies").alias("copies"), F.min("node").alias("chief"), F.count("*").alias("members")).collect()}  # a row a ball
    meetings = table_meetings(nodes, tables, width)
    related = None
    if balls:
        related = materialise(ball_relations(nodes, centres, balls, theta, width), "ball-relations")
        meetings = meetings.unionByName(ball_meetings(nodes, related.where("not all"), balls))
    meetings = materialise(meetings, "meetings")
    compared = meetings.join(nodes.select("node", "unit", "copies"), "node").repartition("key", "cell").sortWithinPartitions("key", "cell")
    found = materialise(compared.mapInArrow(tidy(lambda batches: exact_links(batches, tables, width, least)), "a long, b long, n long"), "links-found")
    counts, edges = found.where("b is null").select(F.col("a").alias("node"), "n"), found.where("b is not null").select("a", "b")
    if balls:
        of_ball = lambda field: F.element_at(F.create_map(*[F.lit(x) for c, b in balls.items() for x in (c, b[field])]), F.col("c"))
        joined = related.where("all").select("node", "copies", F.col("other").alias("c"))
        gained = {r["c"]: r["n"] for r in joined.groupBy("c").agg(F.sum("copies").alias("n")).collect()}  # a row a ball
        for c, b in balls.items():
            b["whole"] = b["copies"] + gained.get(c, 0)
        members = nodes.where("ball is not null").select("node", "copies", F.col("ball").alias("c"))
        counts = counts.unionByName(joined.select("node", of_ball("copies").alias("n"))).unionByName(members.select("node", (of_ball("whole") - F.col("copies")).alias("n")))
        edges = edges.unionByName(joined.select(F.col("node").alias("a"), of_ball("chief").alias("b"))).unionByName(members.select(F.col("node").alias("a"), of_ball("chief").alias("b")))
    rooted = materialise(components(edges.where("a <> b")), "roots")
    of_node = nodes.select("node", "key", "copies", "first").join(counts.groupBy("node").agg(F.sum("n").alias("others")), "node", "left").join(rooted, "node", "left")
    classed = materialise(of_node.select("key", "copies", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "classed")
    least_id = materialise(classed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "classes")
    entries = materialise(join_hot(classed, least_id, "root").select("key", F.col("copies").alias("n"), "n_links", "component_id"), "entries")
    linked = join_hot(every.where("key is not null").select("vec_id", "key"), entries, "key").select("vec_id", "n_links", "component_id")
    alone = every.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs: for small tables only.
ORACLE_SQL = {"op11_embedding_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = vec_id
"""}
