"""Stores with several writers, keyed tables, and assessments kept up to date by edits."""

import os
import random
import tempfile
import threading
import time

import pytest
from pyspark.sql import functions as F

from kbq import session
from kbq.operators import collectors, maintained, store
from kbq.session import prepare


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def fresh_folder():
    return tempfile.mkdtemp(prefix="kbq-store-")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_writers_at_once_lose_nothing(spark):
    folder = fresh_folder()
    failed = []

    def writer(w):
        try:
            for i in range(3):
                rows = spark.createDataFrame([(f"{w}-{i}", w), ("both", w)], "id string, writer int")
                one = lambda now, rows=rows: {"keyed": store.upserted(now, "keyed", rows, ["id"], n=4), "plain": rows if (old := now.load("plain")) is None else old.unionByName(rows)}
                store.transact(spark, folder, one)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted(r["id"] for r in store.load(spark, folder, "keyed").collect()) == ["0-0", "0-1", "0-2", "1-0", "1-1", "1-2", "2-0", "2-1", "2-2", "both"]
    assert store.load(spark, folder, "plain").count() == 18 and store.version(spark, folder) == 9
    assert not store.create_if_absent(spark, f"{folder}/versions/9", "{}")
    assert store.retain(spark, folder, 1) == 8
    assert store.load(spark, folder, "keyed").count() == 10 and store.load(spark, folder, "plain").count() == 18


def test_keyed_reads_open_their_buckets_only(spark):
    folder = fresh_folder()
    rows = spark.range(4000).select(F.concat(F.lit("doc/"), "id").alias("uri"), (F.col("id") % 10 == 0).alias("resolved"), "id").withColumn("status", F.when(F.col("resolved"), "resolved").otherwise("open/new"))
    store.publish(spark, folder, {"signals": store.Keyed(rows, ["uri"], 16, within="status")})
    now = store.Snapshot.newest(spark, folder)
    assert len(now.load("signals").inputFiles()) == 32 and now.load("signals").count() == 4000
    one = now.lookup("signals", ["doc/77"])
    assert [r["id"] for r in one.collect()] == [77] and len(one.inputFiles()) == 2
    assert now.lookup("signals", ["none"]).count() == 0
    done = now.with_value("signals", ["resolved"])
    assert len(done.inputFiles()) == 16 and done.count() == 400
    before = now.tables["signals"]["buckets"]
    store.transact(spark, folder, lambda s: {"signals": store.upserted(s, "signals", s.lookup("signals", ["doc/77"]).withColumn("status", F.lit(None).cast("string")), ["uri"], within="status")})
    after = store.Snapshot.newest(spark, folder)
    assert sum(before[b] != after.tables["signals"]["buckets"][b] for b in before) == 1
    assert [r["status"] for r in after.lookup("signals", ["doc/77"]).collect()] == [None] and after.load("signals").count() == 4000


TEXTS = ["Use OpenAPI here.", "The openapi file.", "Open API again.", "This requires Python 3.9.", "This requires Python 3.11.", "Response caching is enabled by default.", "Response caching is disabled by default.",
         "The legacy token endpoint is deprecated.", "Best practice: the legacy token endpoint.", "Words that are the same at the start of several documents, long enough to be a signature.", "See above for docker.",
         "[one](a1.md) [two](b/a2.md)", "[up](../a3.md)", "[three](a3)", "[exact](a1.md) [gone](nowhere.md)", "[self](a4.md)", "## TODO\n\n# Part\n\n## Overview"]


def random_doc(rng):
    return "# " + rng.choice(["Alpha", "Beta"]) + "\n\n" + "\n\n".join(rng.sample(TEXTS, rng.randint(1, 5)))


@pytest.mark.parametrize("seed", [1])
def test_edits_equal_whole_assessments(spark, seed):
    """Random edits, navigation edges included, against assessing everything anew."""
    rng, folder = random.Random(seed), fresh_folder()
    names = [f"{d}a{i}.md" for d in ("", "b/", "c/") for i in range(8)]
    docs = {n: random_doc(rng) for n in names[:20]}
    edges = [(rng.choice(names), rng.choice(names), t) for t in ("navigation", "parent_child", "cross_reference") for _ in range(4)]
    navigation = spark.createDataFrame(edges, "source_uri string, target_uri string, relation_type string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "uri string, text string")
    maintained.build(spark, folder, frame(docs), navigation, buckets=4)
    for step in range(2):
        gone = rng.sample(sorted(docs), 2)
        new = {n: random_doc(rng) for n in rng.sample(names, 3)} if step else {sorted(docs)[0]: docs[sorted(docs)[0]]}
        docs = {k: v for k, v in docs.items() if k not in gone} | new
        maintained.edit(spark, folder, frame(new), spark.createDataFrame([(g,) for g in gone], "uri string"))
        kb, found = maintained.load(spark, folder)
        whole = collectors.KnowledgeBase.of(frame(docs), navigation)
        assert rows_of(found) == rows_of(collectors.signals(whole))
        assert rows_of(kb.edges) == rows_of(whole.edges.distinct())
        assert rows_of(kb.resolved) == rows_of(whole.resolved)
    counters = store.load(spark, folder, "counters")
    assert rows_of(counters.select("key", "sub", "n", "first", "last")) == rows_of(maintained.counted(store.load(spark, folder, "entries")))


def test_edits_of_most_documents_and_own_checks(spark):
    folder = fresh_folder()
    frame = lambda d: spark.createDataFrame(list(d.items()), "uri string, text string")

    @collectors.collector("own_check", "trust", "cross_artifact")
    def own(kb):
        n = kb.artifacts.agg(F.count("*").alias("n")).where("n > 2")
        return kb.artifacts.select("uri").join(n, F.lit(True), "left_semi").select("uri", F.lit("own_check").alias("collector_id"), F.lit("many").alias("signal_type"), F.lit(None).cast("int").alias("line"), F.lit("").alias("discriminator"))

    try:
        docs = {f"d{i}.md": "# A\n\nUse OpenAPI." for i in range(2)}
        maintained.build(spark, folder, frame(docs), buckets=2)
        for change in ({"d2.md": "# B\n\nopenapi"}, {f"d{i}.md": "# C\n\n[x](d0.md)" for i in range(3)}):
            docs |= change
            maintained.edit(spark, folder, frame(change))
            assert rows_of(maintained.load(spark, folder)[1]) == rows_of(collectors.signals(collectors.KnowledgeBase.of(frame(docs))))
    finally:
        del collectors.REGISTRY["own_check"]


def test_layers_take_the_place_of_rows(spark):
    """Layers, read with what they lie over, are what upserts make of it; buckets are rewritten after a few."""
    rng, folder, held = random.Random(9), fresh_folder(), {f"k{i}": 0 for i in range(30)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id string, n int")
    store.publish(spark, folder, {"rows": store.Keyed(frame(held), ["id"], 4)})
    first = store.Snapshot.newest(spark, folder).tables["rows"]["buckets"]
    for step in range(1, 5):
        new = {f"k{rng.randint(0, 40)}": step for _ in range(4)}
        gone = rng.sample(sorted(held), 3)
        store.transact(spark, folder, lambda now, new=new, gone=gone: {"rows": store.layered(now, "rows", frame(new), ["id"], spark.createDataFrame([(g,) for g in gone], "id string"), most=3)})
        held = {k: v for k, v in held.items() if k not in gone} | new
        now = store.Snapshot.newest(spark, folder)
        assert dict(map(tuple, now.load("rows").collect())) == held
        assert [r["n"] for r in now.lookup("rows", [next(iter(new))]).collect()] == [step]
        assert (now.tables["rows"]["buckets"] == first) == (step < 4)
    assert len(now.tables["rows"]["layers"]) < 3 + 1


def test_edits_leave_texts_where_they_are(spark, monkeypatch):
    """A text is kept once; an edit reads and rewrites no other document's and leaves no table beside its version."""
    root = fresh_folder()
    folder, shared = f"{root}/store", f"{root}/shared"
    docs = spark.createDataFrame([(f"a{i}.md", f"# A\n\nNumber {i} and docker.\n\n## B\n\n[x](a{i + 1}.md)") for i in range(40)], "uri string, text string")
    new = spark.createDataFrame([("a3.md", "# New\n\ntext")], docs.schema)
    with monkeypatch.context() as m:
        m.setattr(session, "shared_folder", lambda _: shared)
        maintained.build(spark, folder, docs, buckets=4)
        kept = store.Snapshot.newest(spark, folder)
        maintained.edit(spark, folder, new, docs.where("uri = 'a7.md'").select("uri"))
    assert os.listdir(shared) == []
    assert not {"sections", "paragraphs", "all_text"} & set(kept.load("artifacts").columns)
    now = store.Snapshot.newest(spark, folder)
    assert now.tables["artifacts"]["buckets"] == kept.tables["artifacts"]["buckets"] and len(now.tables["artifacts"]["layers"]) == 1
    kb, found = maintained.load(spark, folder)
    assert kb.artifacts.count() == 39 and kb.artifacts.where("uri = 'a3.md'").first()["all_text"] == "text"
    assert rows_of(found) == rows_of(collectors.signals(collectors.KnowledgeBase.of(docs.where("uri not in ('a3.md', 'a7.md')").union(new))))


def test_shuffle_files_go_when_a_table_is_there(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    there = shuffled()
    table = session.written(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 11).alias("k")).count(), "groups")
    until = time.time() + 20
    while shuffled() - there and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - there
    assert table.count() == 11
