"""Runs kept as tables: versions that are published whole by one of several writers, keyed tables, upserts, access counts and reads.

A store is a folder with data and a folder `versions` that holds a small file a version, which says where each table
lies. A version counts once its file is there, and that file is created only if no other job has created it (compare and
set), so readers see a whole version or the one before, two writers never take one number, and a job that fails halfway
leaves only files that nobody reads. A writer that comes second takes over what the first one published and, if it had
read any of that, computes its change anew.

Keyed tables lie in buckets by a hash of their key, sorted and with Bloom filters, and within a bucket by the value of
one more column if that is named. Reads by key or value open only the folders that can hold it; an upsert rewrites only
the buckets of its keys. Where rows are wide, it can lie as a layer over them instead, which takes the place of rows of
its keys when they are read; buckets are rewritten once there are a few layers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbq.session import freed, small


def _file(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content in one step; False if there is one of that name already."""
    files, target = _file(spark, path)
    _, temporary = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    try:
        if files.getUri().getScheme() == "file":  # renaming a local file replaces the target, a link does not
            local = lambda p: jvm.java.io.File(files.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(temporary))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(temporary, False)
    return True


def version(spark: SparkSession, folder: str) -> int | None:
    """The newest published version; None in a new store."""
    files, path = _file(spark, f"{folder}/versions")
    if not files.exists(path):
        return None
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return max((int(n) for n in names if n.isdigit()), default=None)


@dataclass
class Snapshot:
    """The tables of one version. What is read from it is noted, to tell whether a change depends on what another writer published."""

    spark: SparkSession
    folder: str
    number: int | None
    tables: dict
    used: set[tuple[str, str | None]] = field(default_factory=set)

    @classmethod
    def newest(cls, spark: SparkSession, folder: str) -> "Snapshot":
        number = version(spark, folder)
        return cls(spark, folder, number, {} if number is None else json.loads(spark.read.text(f"{folder}/versions/{number}", wholetext=True).first()[0]))

    def load(self, name: str) -> DataFrame | None:
        """A whole table; None if there is none of that name."""
        self.used.add((name, None))
        entry = self.tables.get(name)
        if entry is None:
            return None
        return self._read(entry, sorted({b for held in (entry["buckets"], *entry.get("layers", [])) for b in held})) if "buckets" in entry else self.spark.read.parquet(entry["place"])

    def _read(self, entry: dict, buckets, values: list | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        wanted = None if values is None else {f"v{str(v).encode().hex().upper()}" for v in values}

        def rows(held: dict, schema: T.StructType) -> DataFrame | None:
            paths = []
            for b in buckets:
                place, parts = held.get(str(b), (None, []))
                paths += [f"{place}/part={p}" for p in parts if wanted is None or p in wanted]
            return self.spark.read.schema(schema).parquet(*paths) if paths else None

        found = rows(entry["buckets"], schema)
        found = self.spark.createDataFrame([], schema) if found is None else found
        over = [x for layer in entry.get("layers", []) if (x := rows(layer, T.StructType(schema.fields + [T.StructField(_GONE, T.BooleanType())]))) is not None]
        if not over:
            return found
        found = found.withColumns({_GONE: F.lit(False), _LAYER: F.lit(0)})
        for i, layer in enumerate(over):
            found = found.unionByName(layer.withColumn(_LAYER, F.lit(i + 1)))
        newest = found.withColumn(_TOP, F.max(_LAYER).over(Window.partitionBy(*entry["key"])))
        return newest.where((F.col(_LAYER) == F.col(_TOP)) & ~F.col(_GONE)).select(*schema.names)

    def lookup(self, name: str, values: list) -> DataFrame:
        """Rows of a keyed table with one of a few values of its first key column, from their buckets alone."""
        entry = self.tables[name]
        keys = self.spark.createDataFrame([(str(v),) for v in values], f"{entry['key'][0]} string")
        return self.matching(name, keys).where(F.col(entry["key"][0]).cast("string").isin([str(v) for v in values]))

    def matching(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a keyed table whose first key column stands in keys; only buckets of those are opened, of which there is a fixed number."""
        entry = self.tables[name]
        first = entry["key"][0]
        asked = keys.select(F.col(first)).distinct()
        buckets = [r[0] for r in asked.select(bucket_of(F.col(first), entry["n"])).distinct().collect()]
        self.used |= {(name, str(b)) for b in buckets}
        return self._read(entry, buckets).join(small(asked), first, "left_semi")

    def with_value(self, name: str, values: list) -> DataFrame:
        """Rows of a keyed table whose `within` column has one of the values; other folders are not opened."""
        self.used.add((name, None))
        entry = self.tables[name]
        return self._read(entry, entry["buckets"], values)

    def buckets(self, name: str, rows: DataFrame) -> DataFrame | None:
        """The buckets that hold the keys of rows; None if there is no such table."""
        entry = self.tables.get(name)
        if entry is None:
            self.used.add((name, None))
            return None
        wanted = [r[0] for r in rows.select(bucket_of(F.col(entry["key"][0]), entry["n"])).distinct().collect()]
        self.used |= {(name, str(b)) for b in wanted}
        return self._read(entry, wanted)


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int").alias("bucket")


#: Tables stay, so they are written small: filters of keys as large as a file needs them, not a MB each.
_FORMAT = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true"}

#: Columns of layers: whether a row only says that its key is gone, which layer it is of, and which is the newest with its key.
_GONE, _LAYER, _TOP = "_gone", "_layer", "_top"


@dataclass
class Keyed:
    """Rows for the buckets of a keyed table: `rows` are all that these buckets hold from now on, `touched` the numbers of those."""

    rows: DataFrame
    key: list[str]
    n: int = 64
    within: str | None = None
    touched: list[int] | None = None
    #: Files a bucket is cut into, so that a key with a large share of the rows does not make one of them long.
    files: int = 1
    #: What is made of the rows once they lie by their buckets.
    then: Callable[[DataFrame], DataFrame] | None = None
    #: Whether the rows lie over what the buckets hold, with a column that says whether a key is gone.
    layer: bool = False


def layered(snapshot: Snapshot, name: str, incoming: DataFrame, key: list[str], gone: DataFrame, n: int = 64, files: int = 1, most: int = 8) -> Keyed:
    """The change of `upserted` as a layer that holds no more than the incoming rows and the keys that are gone; buckets are not read. The buckets concerned are rewritten instead once the table has `most` layers. A layer takes the place of all rows of its keys."""
    held = snapshot.tables.get(name)
    if held is None or held["within"] is not None or len(held.get("layers", [])) >= most:
        return upserted(snapshot, name, incoming, key, n, gone=gone, files=files)
    lost = gone.select(*key).join(incoming.select(*key), key, "left_anti")
    rows = incoming.withColumn(_GONE, F.lit(False)).unionByName(lost.withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
    return Keyed(rows, key, held["n"], files=files, layer=True)


def upserted(snapshot: Snapshot, name: str, incoming: DataFrame, key: list[str], n: int = 64, within: str | None = None, merged: Callable[[DataFrame, DataFrame], DataFrame] | None = None, gone: DataFrame | None = None, files: int = 1) -> Keyed:
    """The change that puts incoming rows over those of the same key, or what merged(current, incoming) makes of the buckets concerned; gone: keys to be dropped."""
    n = snapshot.tables.get(name, {}).get("n", n)
    concerned = incoming.select(key[0]) if gone is None else incoming.select(key[0]).union(gone.select(key[0]))
    touched = [r[0] for r in concerned.select(bucket_of(F.col(key[0]), n)).distinct().collect()]  # as many as there are buckets at most
    current = snapshot.buckets(name, concerned)
    if current is None:
        return Keyed(incoming, key, n, within, touched, files)
    kept = current if gone is None else current.join(gone.select(*key), key, "left_anti")
    return Keyed((merged or (lambda old, new: old.join(new, key, "left_anti").unionByName(new)))(kept, incoming), key, n, within, touched, files)


def _write(spark: SparkSession, folder: str, name: str, change: DataFrame | Keyed) -> dict:
    """Write a table's new data, under a name of its own, and say where it lies."""
    place = f"{folder}/data/{name}-{uuid.uuid4().hex}"
    if isinstance(change, DataFrame):
        with freed(spark):
            change.write.option("compression", "zstd").parquet(place)
        return {"place": place}
    value = F.lit("all") if change.within is None else F.concat(F.lit("v"), F.hex(F.col(change.within).cast("string").cast("binary")))
    cut = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in change.key]), F.lit(change.files))
    bucket = bucket_of(F.col(change.key[0]), change.n)
    dealt = change.rows.repartition(bucket, cut)
    rows = dealt if change.then is None else change.then(dealt)
    marked = rows.withColumn("bucket", bucket).withColumn("part", F.coalesce(value, F.lit("null"))).sortWithinPartitions("bucket", "part", *change.key)
    with freed(spark):
        marked.write.partitionBy("bucket", "part").options(**_FORMAT, **{"parquet.bloom.filter.enabled#" + change.key[0]: "true"}).parquet(place)
    files, root = _file(spark, place)
    held = {}
    for b in files.listStatus(root):
        if b.isDirectory():
            held[b.getPath().getName().split("=")[1]] = [f"{place}/{b.getPath().getName()}", [p.getPath().getName().split("=", 1)[1] for p in files.listStatus(b.getPath()) if p.isDirectory()]]
    return {"key": change.key, "n": change.n, "within": change.within, "schema": json.loads(rows.schema.json()), "buckets": held, "touched": None if change.touched is None else [str(b) for b in change.touched], "layer": change.layer}


def put(spark: SparkSession, folder: str, name: str, rows: Keyed) -> tuple[dict, DataFrame]:
    """Write a whole keyed table: what a change may name in its place, and its rows, read back. It counts once that change is published."""
    entry = _write(spark, folder, name, rows)
    return entry, Snapshot(spark, folder, None, {name: entry}).load(name)


def _put(tables: dict, written: dict) -> dict:
    """tables with what was written put in place, bucket by bucket in keyed tables."""
    out = dict(tables)
    for name, entry in written.items():
        touched = entry.get("touched")
        held = out.get(name)
        plain = {k: v for k, v in entry.items() if k not in ("touched", "layer")}
        if entry.get("layer") and held is not None:
            out[name] = held | {"layers": held.get("layers", []) + [entry["buckets"]]}
        elif touched is not None and held is not None:
            kept = lambda buckets: {b: x for b, x in buckets.items() if b not in touched}
            out[name] = plain | {"buckets": kept(held["buckets"]) | entry["buckets"], "layers": [x for layer in held.get("layers", []) if (x := kept(layer))]}
        else:
            out[name] = plain
    return out


def _changed(name: str, bucket: str | None, before: dict, now: dict) -> bool:
    a, b = before.get(name), now.get(name)
    held = lambda entry: [layer.get(bucket) for layer in (entry["buckets"], *entry.get("layers", [])) if bucket in layer]
    return a != b if bucket is None or a is None or b is None else held(a) != held(b)


def transact(spark: SparkSession, folder: str, change: Callable[[Snapshot], dict[str, DataFrame | Keyed | dict]], tries: int = 50) -> int:
    """Publish the tables that `change` makes of the newest version, or has `put`, as the next one; tables it doesn't name are carried on.

    If other writers publish meanwhile, their tables and buckets are taken over; where the change had read any of those, it
    is computed again from the newest version. So no writer's rows are lost.
    """
    for _ in range(tries):
        base = Snapshot.newest(spark, folder)
        written = {name: made if isinstance(made, dict) else _write(spark, folder, name, made) for name, made in change(base).items()}
        newest = base
        while not any(_changed(name, bucket, base.tables, newest.tables) for name, bucket in base.used):
            number = (newest.number or 0) + 1
            if create_if_absent(spark, f"{folder}/versions/{number}", json.dumps(_put(newest.tables, written))):
                return number
            newest = Snapshot.newest(spark, folder)
    raise RuntimeError(f"{tries} other versions were published meanwhile")


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame | Keyed | dict]) -> int:
    """Publish tables as they are, whatever stood there before."""
    return transact(spark, folder, lambda _: tables)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the newest published version; None if there is none."""
    return Snapshot.newest(spark, folder).load(name)


def fork(spark: SparkSession, folder: str, to: str) -> str:
    """A new store that begins with the newest version of another; data is shared, not copied."""
    create_if_absent(spark, f"{to}/versions/1", json.dumps(Snapshot.newest(spark, folder).tables))
    return to


def retain(spark: SparkSession, folder: str, versions: int) -> int:
    """Forget all but the newest versions and delete the data that none of the kept ones names; the number of versions forgotten. Readers of forgotten versions must have ended."""
    newest = version(spark, folder) or 0
    files, path = _file(spark, f"{folder}/versions")
    if not newest:
        return 0
    numbers = sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit())
    keep, drop = numbers[-versions:], numbers[:-versions]
    named = "".join(r[0] for r in spark.read.text([f"{folder}/versions/{n}" for n in keep], wholetext=True).collect())
    old = "".join(r[0] for r in spark.read.text([f"{folder}/versions/{n}" for n in drop], wholetext=True).collect()) if drop else ""
    for n in drop:
        files.delete(_file(spark, f"{folder}/versions/{n}")[1], False)
    for d in files.listStatus(_file(spark, f"{folder}/data")[1]):
        name = d.getPath().getName()
        if name in old and name not in named:  # what no version names yet may be another writer's
            files.delete(d.getPath(), True)
    return len(drop)


def merge(current: DataFrame, incoming: DataFrame, key: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """current with incoming's rows put over those of the same key, one row a key on either side. keep: columns whose new value is an expression over `old` and `new`, structs of both rows (null where a side has none)."""
    columns = current.columns
    old, new = current.select(*key, F.struct(*columns).alias("old")), incoming.select(*key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full_outer")
    taken = {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in columns} | (keep or {})
    return both.select(*[taken[c].alias(c) for c in columns])


def merge_signals(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored findings (signal_id, uri, severity, status, last_run, access_count) after a run: attributes are renewed, a resolved status and the access count stay."""
    return merge(current, incoming, ["signal_id"], {
        "status": F.when(F.col("old.status") == "resolved", F.col("old.status")).otherwise(F.coalesce("new.status", "old.status")),
        "access_count": F.coalesce("old.access_count", "new.access_count"),
    })


def merge_lifecycle(current: DataFrame, seen: DataFrame, run: str) -> DataFrame:
    """(signal_id, first_run, last_run, status) after a run: every finding that was seen is persistent, unless it is resolved; verification alone changes that (`verified`)."""
    new = seen.select("signal_id", F.lit(run).alias("first_run"), F.lit(run).alias("last_run"), F.lit("persistent").alias("status"))
    return merge(current, new, ["signal_id"], {"first_run": F.coalesce("old.first_run", "new.first_run"), "status": F.when(F.col("old.status") == "resolved", F.col("old.status")).otherwise(F.coalesce("new.status", "old.status"))})


def verified(lifecycle: DataFrame, outcome: DataFrame) -> DataFrame:
    """The lifecycle after a verification (signal_id, gone): what is gone is resolved, what is there although it was resolved is recurring."""
    joined = lifecycle.join(outcome.select("signal_id", "gone"), "signal_id", "left")
    status = F.when(F.col("gone"), "resolved").when(~F.col("gone") & (F.col("status") == "resolved"), "recurring").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("gone")


def persist(spark: SparkSession, folder: str, run: str, artifacts: DataFrame, signals: DataFrame, assessment: DataFrame, n: int = 16) -> int:
    """Publish a run whole, or not at all: artifacts by uri, findings (signal_id, uri, severity, status, last_run, access_count) by id with `merge_signals`, the run's links to them, their lifecycle, and its assessment row (assessment_id, ...). Other runs may be published at the same time; the number of the version."""

    def change(now: Snapshot) -> dict:
        links = signals.select(F.lit(run).alias("assessment_id"), "signal_id")
        return {
            "artifacts": upserted(now, "artifacts", artifacts, ["uri"], n), "signals": upserted(now, "signals", signals, ["signal_id"], n, merged=merge_signals),
            "links": upserted(now, "links", links, ["assessment_id", "signal_id"], n, files=8), "assessments": upserted(now, "assessments", assessment, ["assessment_id"], n),
            "lifecycle": upserted(now, "lifecycle", signals.select("signal_id", F.lit(run).alias("first_run"), F.lit(run).alias("last_run"), F.lit("persistent").alias("status")), ["signal_id"], n, merged=lambda old, new: merge_lifecycle(old, new, run)),
        }

    return transact(spark, folder, change)


def record_modified(current: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, source, modified_at) with the latest time of each document and source."""
    return current.unionByName(uris).groupBy("uri", "source").agg(F.max("modified_at").alias("modified_at"))


def clear_source(assessments: DataFrame, links: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Assessments (assessment_id, source) and link rows (assessment_id, signal_id) without those of a source; findings themselves stay."""
    gone = assessments.where(F.col("source") == source).select("assessment_id")
    return assessments.where(~F.col("source").eqNullSafe(source)), links.join(gone, "assessment_id", "left_anti")


def touch(signals: DataFrame, retrieved: DataFrame, at: Column) -> DataFrame:
    """signals with access_count raised by the times their id stands in retrieved(signal_id), and last_access set for those."""
    n = retrieved.groupBy("signal_id").agg(F.count("*").alias("n"))
    joined = signals.join(n, "signal_id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_access", F.when(F.col("n").isNotNull(), at).otherwise(F.col("last_access"))).drop("n")


def set_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the status that changes(key, status) gives them, if any."""
    return rows.join(changes.select(key, F.col("status").alias("to")), key, "left").withColumn("status", F.coalesce("to", "status")).drop("to")


def of_assessment(links: DataFrame, signals: DataFrame) -> DataFrame:
    """The findings of each assessment: links (assessment_id, signal_id) with the findings' columns."""
    return links.join(signals, "signal_id")


def not_seen(runs: DataFrame, recorded: DataFrame, key: str = "dedup_key") -> DataFrame:
    """runs whose key is not recorded yet, the first of equal ones."""
    return runs.join(recorded.select(key), key, "left_anti").dropDuplicates([key])


def latest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n newest rows by a time, of equals those with the smallest tie: a report, so n is small."""
    return rows.orderBy(F.desc(by), tie).limit(n)


def append_log(rows: DataFrame, folder: str) -> None:
    """Add rows (skip events, decision traces, outcomes) to a log; rows are never changed."""
    rows.write.mode("append").parquet(folder)


def with_previous(assessments: DataFrame, source: str = "source") -> DataFrame:
    """assessments (assessment_id, source, created_at) with `previous`, the id of the one before of the same source, and `back`, 1 for the newest. One row a run: a source's runs fit one task."""
    w = Window.partitionBy(source)
    return assessments.withColumn("previous", F.lag("assessment_id").over(w.orderBy("created_at", "assessment_id"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("created_at"), F.desc("assessment_id"))))


def to_json(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., json): every row as one JSON object, for export."""
    return rows.select(*key, F.to_json(F.struct(*rows.columns)).alias("json"))
