"""Operators of the engine on hand-written cases."""

from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.operators import collectors as C
from kbq.operators import graph, history, incremental, memory, parse, problems, scoring, store, validation, vector
from kbq.session import prepare
from kbq.sources import files
from kbq.streaming import runs


def kb(spark, *docs):
    prepare(spark)
    return C.KnowledgeBase.of(spark.createDataFrame(list(docs), "uri string, text string"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_structure(spark):
    base = kb(spark, ("a.md", "---\ntitle: A: b\ntitle: C\n---\nlead\n# One\ntext\n\nmore\n```py\n# code\n```\n[x](b.md) ![i](http://e.x/i.png)\n"), ("b.txt", "# not a heading"), ("n.md", None), ("r.rst", "Top\n===\nbody\n"))
    a = {r["uri"]: r for r in base.artifacts.collect()}
    assert a["a.md"]["title"] == "C" and a["a.md"]["artifact_id"] == __import__("hashlib").sha256(b"a.md").hexdigest()[:16]
    assert [(h["line"], h["level"], h["text"]) for h in a["a.md"]["headings"]] == [(2, 1, "One"), (7, 1, "code")]
    assert [s["text"] for s in a["a.md"]["sections"]][0] == "lead"
    assert [(x["language"], x["line"]) for x in a["a.md"]["code_blocks"]] == [("py", 6)]
    assert [(x["target"], x["is_internal"]) for x in a["a.md"]["links"]] == [("b.md", True), ("http://e.x/i.png", False)]
    assert a["b.txt"]["headings"] == [] and len(a["b.txt"]["sections"]) == 1 and a["b.txt"]["title"] == "b"
    assert a["n.md"]["word_count"] == 0 and [h["text"] for h in a["r.rst"]["headings"]] == ["Top"]


def test_links(spark):
    base = kb(spark, ("d/a.md", "[1](../c.md#t) [2](./b) [3](#top) [4](mailto:x) [5](b.md?q)"), ("d/b.md", "x"), ("c.md", "[self](c.md)"))
    found = graph.resolve(parse.links(base.artifacts), base.artifacts)
    assert rows(found.na.fill("-"), "uri", "target", "resolved") == [("c.md", "c.md", "c.md"), ("d/a.md", "../c.md#t", "c.md"), ("d/a.md", "./b", "d/b.md"), ("d/a.md", "b.md?q", "d/b.md"), ("d/a.md", "mailto:x", "-")]
    assert rows(graph.in_degree(base.artifacts, base.edges, parse.links(base.artifacts)), "uri", "inbound") == [("c.md", 3), ("d/a.md", 0), ("d/b.md", 1)]
    assert rows(C.orphan_documents(base), "uri") == [("d/a.md",)]
    assert rows(C.orphan_documents(kb(spark, ("only.md", "x"))), "uri") == []


def test_checks(spark):
    base = kb(
        spark,
        ("a.md", "# Step 3\nRequires Python 3.9.\n\nRouting is enabled by default. The old token call is deprecated."),
        ("b.md", "# API\nrequires python 3.11.\n\nRouting is disabled by default. We are recommending the old token call.\n\nit is above."),
        ("c.md", "---\ndate: 2024-13-45\n---\n# Ops\nOn Jan 5, 2024 we said so. See below."),
    )
    assert rows(C.heading_quality(base), "uri", "signal_type") == [("a.md", "numbered_only"), ("c.md", "too_short")]
    assert rows(C.version_conflicts(base), "uri", "version") == [("b.md", "3.11")]
    assert rows(C.default_conflicts(base), "uri") == [("a.md",), ("b.md",)]
    assert rows(C.deprecation_conflicts(base), "uri") == [("a.md",)]
    assert rows(C.freshness(base, as_of="2025-01-04"), "uri", "signal_type") == [("a.md", "no_date_signal"), ("b.md", "no_date_signal")]
    assert rows(C.freshness(base, as_of="2025-01-05"), "uri", "signal_type")[2] == ("c.md", "stale_content")
    assert rows(C.dangling_references(base), "uri", "dangling_reference_count") == [("b.md", 1), ("c.md", 1)]


def test_empty_corpus(spark):
    base = kb(spark, ("z.md", ""))
    none = C.KnowledgeBase(base.artifacts.where("false"), base.resolved.where("false"), base.edges)
    assert C.signals(none).count() == 0


def test_scores(spark):
    dims = spark.createDataFrame([("u", d, 100, 0) for d in scoring.WEIGHTS] + [("v", d, 0 if d == "workflow" else 100, 0) for d in scoring.WEIGHTS], "uri string, dimension string, score int, signals long")
    assert rows(scoring.overall(dims, ["uri"]), "uri", "base", "adjusted", "caps") == [("u", 100, 100, ""), ("v", 90, 30, "zero_dimension")]
    assert scoring.invalid_entries(scoring.policy(spark)).count() == 0


def test_history(spark):
    seen = spark.createDataFrame([(1, "s"), (3, "s"), (1, "t"), (3, "n"), (1, "p"), (2, "p"), (3, "p")], "run int, signal_id string")
    batch = rows(history.lifecycle(seen), "signal_id", "status")
    assert batch == [("n", "new"), ("p", "persistent"), ("s", "recurring"), ("t", "resolved")]
    state = spark.createDataFrame([], "signal_id string, first_seen int, last_seen int, runs int, status string")
    for run in (1, 2, 3):
        state = history.advance(state, seen.where(F.col("run") == run), run)
    assert rows(state, "signal_id", "status") == batch
    one = spark.createDataFrame([("i", "s", 1, 1.0)], "issue_type string, strategy string, at int, value double")
    assert abs(history.ema(one).first()["ema"] - 0.65) < 1e-12
    pairs = spark.createDataFrame([(i, float(i), float(i)) for i in range(19)], "id int, confidence double, outcome double")
    assert history.diagnosis_quality(pairs).first()["status"] == "insufficient_data"


def test_fixes(spark):
    docs = spark.createDataFrame([("a", "# T\n[x](gone.md) see above"), ("b", "---\ndate: old\n---\nx")], "uri string, text string")
    dated = problems.set_metadata(docs, "date", F.lit("new"), F.lit("T"))
    assert rows(dated, "text") == [("---\ndate: new\n---\nx",), ("---\ntitle: T\ndate: new\n---\n# T\n[x](gone.md) see above",)]
    assert rows(problems.set_metadata(dated, "date", F.lit("new"), F.lit("T")), "text") == rows(dated, "text")
    broken = spark.createDataFrame([("a", "x", "gone.md")], "uri string, text string, target string")
    assert rows(problems.unlink(docs, broken), "text")[0] == ("# T\nx see above",)
    assert rows(problems.fix_references(docs), "text")[0] == ("# T\n[x](gone.md) see the referenced documentation",)
    wanted = spark.createDataFrame([("a", "docker.com")], "uri string, domain string")
    assert "# T\n\n[docker.com](https://docker.com)\n" in rows(problems.add_canonical(docs, wanted), "text")[0][0]


def test_vectors(spark):
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, None)], "vec_id int, embedding array<float>")
    assert rows(vector.nearest(data.where("vec_id = 1"), data, 1), "query_id", "vec_id") == [(1, 2)]
    docs = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha"), ("c", "")], "uri string, text string")
    found = vector.features(docs)
    long = vector.embed(found, vector.idf(found, docs).select("term", "idf"))
    assert all(abs(r["n"] - 1) < 1e-9 for r in long.groupBy("uri").agg(F.sum(F.col("value") ** 2).alias("n")).collect())


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("# A\n")
    (tmp_path / "x" / "b.exe").write_text("no")
    (tmp_path / "skip.txt").write_text("no")
    assert rows(files.read(spark, str(tmp_path), exclude=("skip",)), "uri", "text") == [("x/a.md", "# A\n")]


def test_normal_path(spark):
    got = spark.range(1).select(*[T.normal_path(F.lit(p)) for p in ("a/./b/../c", "../x", "a//b")]).first()
    assert tuple(got) == ("a/c", "../x", "a/b")


def test_entry_survives_without_llm(tmp_path):
    """The entry in a copy of the repository without the training-data operators."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "kbq", tmp_path / "kbq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_store(spark, tmp_path):
    """A version counts once it is published; tables that are not given are carried on."""
    folder = str(tmp_path)
    one = spark.createDataFrame([("a", "u", "LOW", "resolved", 1, 3), ("b", "u", "LOW", "persistent", 1, 2)], "signal_id string, uri string, severity string, status string, last_run int, access_count long")
    two = spark.createDataFrame([("a", "u", "HIGH", "persistent", 2, 0), ("c", "v", "LOW", "persistent", 2, 0)], one.schema)
    assert store.version(spark, folder) is None and store.load(spark, folder, "signals") is None
    store.publish(spark, folder, {"signals": one, "other": one})
    store.publish(spark, folder, {"signals": store.merge_signals(store.load(spark, folder, "signals"), two)})
    one.write.parquet(f"{folder}/version=3/signals")  # a job that failed before it published
    assert rows(store.load(spark, folder, "signals"), "signal_id", "severity", "status", "access_count") == [("a", "HIGH", "resolved", 3), ("b", "LOW", "persistent", 2), ("c", "LOW", "persistent", 0)]
    assert store.load(spark, folder, "other").count() == 2 and store.version(spark, folder) == 2
    assert rows(store.touch(one.withColumn("last_access", F.lit(0)), two.select("signal_id"), F.lit(9)), "signal_id", "access_count", "last_access") == [("a", 4, 9), ("b", 2, 0)]


def test_incremental(spark):
    """Findings from what is kept and what changed equal those of a whole assessment, whether links changed or not."""
    texts = {f"d/{i}.md": f"# Title {i}\nSome REST API text number {i} for all of the readers there.\n[n]({i + 1}.md)\n" for i in range(8)}
    before = kb(spark, *texts.items())
    edited = {"d/1.md": texts["d/1.md"] + "Use RESTful calls. See above.\n"}
    for more, gone in (({}, []), ({"d/9.md": "# TODO\n[x](0.md)"}, ["d/3.md"])):
        now = {k: v for k, v in (texts | edited | more).items() if k not in gone}
        docs = spark.createDataFrame(list(now.items()), "uri string, text string")
        changed = history.changes(incremental.snapshot(before), incremental.snapshot(C.KnowledgeBase.of(docs)))
        assert rows(changed, "uri", "event") == sorted([("d/1.md", "modified"), *[(u, "added") for u in more], *[(u, "deleted") for u in gone]])
        base, found = incremental.reassess(before, C.signals(before), docs, changed)
        whole = C.KnowledgeBase.of(docs)
        assert rows(found.na.fill(-1), "uri", "signal_type", "line", "signal_id", "occurrence") == rows(C.signals(whole).na.fill(-1), "uri", "signal_type", "line", "signal_id", "occurrence")
        assert rows(base.edges, "source_uri", "target_uri") == rows(whole.edges, "source_uri", "target_uri")


def test_hub_and_validation(spark):
    docs = spark.createDataFrame([("i.md", "# Guide to caches\nText.\n"), ("a.md", "# Tuning caches\n```\n[no](x.md)\n```\n[b](b.md)"), ("b.md", "# Other\n### Deep\n### Deep\n")], "uri string, text string")
    titles = spark.createDataFrame([("i.md", "Guide to caches"), ("a.md", "Tuning caches"), ("b.md", "Other")], "uri string, title string")
    linked = validation.link_from_hub(docs, titles.select("uri"), "i.md", titles, C.STOPWORDS)
    assert rows(linked.where("uri = 'i.md'"), "text") == [("# Guide to caches\nText.\n\n## Additional Resources\n\n- [Tuning caches](a.md)\n",)]
    assert rows(validation.plain_links(docs), "uri", "target") == [("a.md", "b.md")]
    assert rows(validation.hierarchy(validation.plain_headings(docs)), "uri", "issue") == [("b.md", "duplicate"), ("b.md", "jump")]
    effects = {r["measure"]: r["effect"] for r in validation.validate(docs, linked).collect()}
    assert effects == {"broken_links": "neutral", "heading_issues": "neutral", "with_metadata": "neutral", "unreferenced": "improved", "overall": "improved"}


def test_custom_rule(spark, monkeypatch):
    monkeypatch.setattr(problems, "CUSTOM_RULES", {})

    @problems.cross_check("many_findings")
    def many(signals, score):
        return signals.agg((F.count("*") > 2).alias("fires")).withColumn("rule", F.lit("many_findings"))

    signals = spark.createDataFrame([("c", "k", f"{i}.md") for i in range(3)], "collector_id string, signal_type string, uri string")
    fired = {r["rule"]: r["fires"] for r in problems.cross_checks(signals, spark.createDataFrame([(100,)], "connectivity int")).collect()}
    assert len(fired) == 6 and fired["many_findings"] and not fired["navigation_collapse"]


def test_fixed_values():
    """Weights add up, and every kind of finding of a category is one that some check gives."""
    assert abs(sum(scoring.WEIGHTS.values()) - 1) < 1e-9 and abs(sum(problems.PARTS.values()) - 1) < 1e-9
    given = {kind for _, kind, *_ in scoring.POLICY}
    assert {k for kinds in memory.CATEGORY_KINDS.values() for k in kinds} <= given
    assert len(problems.DANGLING_FIXES) == 15


def test_odd_paths(spark, tmp_path):
    """Folders and files with spaces, percent signs and other letters; a single file; roots with and without a slash or scheme."""
    root = tmp_path / "my docs 100%+é"
    (root / "x y").mkdir(parents=True)
    for name in ("a.md", "x y/b c.txt", "x y/é%20+.rst", "skip.py"):
        (root / name).write_text(name)
    want = [("a.md", "a.md"), ("x y/b c.txt", "x y/b c.txt"), ("x y/é%20+.rst", "x y/é%20+.rst")]
    for given in (str(root), f"{root}/"):
        assert [tuple(r) for r in files.in_order(files.read(spark, given)).collect()] == want
    assert [tuple(r) for r in files.read(spark, str(root / "x y" / "b c.txt")).collect()] == [("b c.txt", "x y/b c.txt")]
    assert files.read(spark, str(root / "x y" / "b c.txt"), exclude=("b c",)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("[b](b.md)")
    (tmp_path / "b.md").write_text("# B\n")
    (tmp_path / "c.md").write_text("[a](a.md)")
    modified = spark.createDataFrame([("c.md",)], "uri string")
    prepare(spark)
    base = files.knowledge_base(spark, str(tmp_path), first=1, modified=modified)
    assert rows(base.artifacts, "uri") == [("a.md",), ("c.md",)] and rows(base.edges, "source_uri", "target_uri") == [("c.md", "a.md")]
    files.register(lambda source: source.startswith("test://"), lambda spark, source, **options: spark.createDataFrame([(source, "x")], "uri string, text string"))
    assert rows(files.read(spark, "test://x"), "uri") == [("test://x",)]


def test_gate_and_cross_checks_use_computed_scores(spark, monkeypatch):
    from kbq.plans import scores, work

    def given(*kinds):
        signals = spark.createDataFrame([(c, t, f"{i}.md") for i, (c, t) in enumerate(kinds)], "collector_id string, signal_type string, uri string")
        for module in (scores, work):
            monkeypatch.setattr(module, "interpreted", lambda *_: scoring.interpret(signals, scoring.policy(spark)))
        fires = {r["rule"]: r["fires"] for r in work.cross_checks(spark, "").collect()}
        return scores.exit_gate(spark, "").first()["exit_code"], fires["navigation_collapse"]

    link, orphan, apart = ("link_integrity", "broken_link"), ("link_integrity", "orphan"), ("knowledge_connectivity", "orphan_artifact")
    assert given() == (0, False)
    assert given(link, link, orphan) == (0, False)
    assert given(*[link] * 20, orphan, *[apart] * 20) == (1, True)
    assert given(link, ("heading_quality", "placeholder")) == (2, False)
