"""Work that must not grow faster than its input: what meets what is looked at beside the results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kbq.functions import text as T
from kbq.operators import collectors, memory, parse, scoring, validation, vector
from kbq.plans import remember, runs
from kbq.session import prepare, written
from kbq.streaming import runs as streamed


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_similar_meets_only_the_newest(spark, monkeypatch):
    """A document with many outcomes gives a problem no more than the n newest of them; results are those of all pairs."""
    rng = random.Random(3)
    past = [(f"o{i}", f"t{rng.randint(0, 1)}", [f"u{rng.choice([0, 0, 0, k])}" for k in rng.sample(range(6), 2)], rng.randint(0, 40)) for i in range(300)]
    asked = [(f"p{i}", f"t{rng.randint(0, 1)}", [f"u{k}" for k in rng.sample(range(9), 2)]) for i in range(40)]
    kept = {}
    plain = memory.written
    monkeypatch.setattr(memory, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    found = memory.similar(spark.createDataFrame(asked, "problem_id string, issue_type string, uris array<string>"), spark.createDataFrame(past, "outcome_id string, issue_type string, uris array<string>, created_at int"), 3)
    want = []
    for p, kind, uris in asked:
        same = sorted((-at, o, set(us) & set(uris)) for o, k, us, at in past if k == kind)
        close = [o for _, o, shared in same if shared][:3]
        want += [(p, o, True) for o in close] or [(p, o, False) for _, o, _ in same[:3]]
    assert rows(found) == sorted(want, key=repr)
    assert kept["newest"].groupBy("issue_type", "uri").count().agg(F.max("count")).first()[0] == 3


def test_closed_runs_fold_once(spark):
    """Closed runs are folded by joins and aggregates; a batch that is given again changes nothing, a gap between batches is one."""
    closed = lambda *seen: spark.createDataFrame(list(seen), "run long, signal_id string")
    one = streamed.folded(None, closed((1, "a"), (2, "a"), (1, "b"), (3, "b")))
    assert rows(one) == [("a", 1, 2, 2, False), ("b", 1, 3, 2, True)]
    two = closed((3, "a"), (4, "a"), (5, "c"))
    then = streamed.folded(one, two)
    assert rows(then) == [("a", 1, 4, 4, False), ("c", 5, 5, 1, False)]
    assert rows(streamed.folded(then, two)) == []
    assert rows(streamed.folded(then, closed((6, "a")))) == [("a", 1, 6, 5, True)]


def test_arrivals_are_dealt(spark, monkeypatch):
    """Documents arrive in as many files as they are read in, not through one task."""

    class Enough(Exception):
        pass

    def stop(folder, *_):
        raise Enough(folder.removesuffix("/store"))

    docs = spark.range(300).select(F.concat(F.lit("d"), "id", F.lit("7.md")).alias("uri"), F.lit("text").alias("text")).repartition(6)
    monkeypatch.setattr(remember, "kb_docs", lambda *_: docs)
    monkeypatch.setattr(remember.R, "assess_once", stop)
    with pytest.raises(Enough) as done:
        remember.stream_assessed(spark, "")
    assert len(spark.read.parquet(f"{done.value}/arrivals").inputFiles()) > 2


def test_runs_are_told_apart_without_a_join(spark, monkeypatch):
    """Findings know their document's number; and a table that is small on disk is not broadcast unless it was measured."""
    found = written(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("heading_quality").alias("collector_id"), F.lit("u").alias("uri"), F.lit("LOW").alias("severity"), F.lit("s").alias("signal_id"), F.lit(1).alias("occurrence")), "found")
    monkeypatch.setattr(runs, "interpreted", lambda *_: found)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before, after = runs.run_pair(spark, "")
    assert before.count() == 1800 and after.count() == 2000
    assert not any("Join" in plan(df) for df in (*runs.run_pair(spark, ""), *runs.two_runs(spark, "")))
    assert "Broadcast" not in plan(found.join(found.select("doc_id", F.lit(1).alias("x")), "doc_id"))


def test_hubs_of_the_same_words_share_a_list(spark, monkeypatch):
    """A list is made for each set of words, not for each hub; a hub that is an orphan is not in its own; both ways of joining agree."""
    docs = spark.createDataFrame([(f"h{i}", "hub") for i in range(6)] + [(f"o{i}", "text") for i in range(4)], "uri string, text string")
    titles = spark.createDataFrame([(f"h{i}", "The guide" if i < 5 else "Other words") for i in range(6)] + [(f"o{i}", f"Guide {i}") for i in range(4)], "uri string, title string")
    hubs, lost = docs.where("uri like 'h%' or uri = 'o0'").select("uri"), docs.where("uri like 'o%' or uri = 'h4'").select("uri")
    kept = {}
    plain = validation.written
    monkeypatch.setattr(validation, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    line = {u: f"- [{t}]({u})" for u, t in map(tuple, titles.collect())}
    listed = lambda *uris: "\n\n## Additional Resources\n\n" + "\n".join(sorted(line[u] for u in uris)) + "\n"
    orphans = ["o0", "o1", "o2", "o3", "h4"]
    want = {f"h{i}": "hub" + listed(*[o for o in orphans if o != f"h{i}"]) for i in range(5)} | {"h5": "hub", "o0": "text" + listed("o1", "o2", "o3", "h4")} | {f"o{i}": "text" for i in (1, 2, 3)}
    for most in (validation.LIST_BYTES, 0):
        monkeypatch.setattr(validation, "LIST_BYTES", most)
        kept.clear()
        assert dict(rows(validation.link_from_hubs(docs, lost, hubs, titles, ["the"]))) == want
        assert kept["lists"].count() == 3  # of four hubs, of h4 and of o0


def test_documents_are_dealt_before_they_are_parsed(spark):
    """A file with one row group is parsed by more than one task."""
    one = written(spark.range(400).select(F.concat(F.lit("d"), "id", F.lit(".md")).alias("uri"), F.lit("# T\n\ntext").alias("text")).coalesce(1), "one")
    kb = collectors.KnowledgeBase.of(one)
    assert len(one.inputFiles()) == 1 and len(kb.artifacts.inputFiles()) > 4


def test_terms_are_those_of_the_pattern(spark):
    """Terms that are looked for where a text contains them are those that the pattern of all terms finds."""
    rng = random.Random(5)
    parts = [p for t in collectors.TERMS for p in (t, t.upper(), t + "s")] + ["rest", "open", "fast", "web", "ci", "java", "2.0", "x"]
    texts = [(f"u{i}", "".join(rng.choice(parts) + rng.choice([" ", "-", ".", "/", "_", ""]) for _ in range(6))) for i in range(300)]
    want = set()
    for uri, text in texts:
        forms = re.findall(collectors._any_term(), text, re.A)
        want |= {(uri, t) for t in collectors.TERMS if any(re.search(rf"\b{re.escape(t)}\b", f, (re.I if t.islower() else 0) | re.A) for f in forms)}
    found = collectors.term_uses(spark.createDataFrame(texts, "uri string, all_text string"))
    assert set(rows(found, "uri", "variant")) == want


def test_views_of_runs_need_no_findings(spark, monkeypatch):
    """The assessment history reads events alone."""

    def never(*_):
        raise AssertionError("findings were computed")

    monkeypatch.setattr(runs, "interpreted", never)
    events = spark.createDataFrame([("2024-01-01 10:00:00", 40.0), ("2024-01-02 10:00:00", 60.0)], "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    monkeypatch.setattr(runs, "table", lambda *_: events)
    assert rows(runs.QUERIES["view_assessment_history"](spark, ""), "assessment_id", "score") == [("run-001", 100), ("run-002", 0)]


def test_one_pass_over_texts(spark):
    """All checks that look for words read the artifacts' texts in one stage; their findings start from its narrow table. The gates pass all that the exact patterns match."""
    phrases = ["as mentioned above", "as mentioned below", "as discussed above", "as discussed earlier", "see above", "see below", "previous example", "previous section", "following section", "the above", "the below", "the previous", "the following", "in the previous step", "in the next step", "the aforementioned", "the latter", "the former"]
    texts = [f"# T\n\nSo it goes, {p}." for p in phrases] + ["# T\n\nOne.\n\n  it is so.\n\nthose  option too.", "# T\n\nWord, the thing is\nenabled  by default; x is off by default.", "# T\n\nneeds Python 3.9.1 and OAuth 2.0", "# T\n\nplain"]
    kb = collectors.KnowledgeBase.of(spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "uri string, text string"))
    found = {r.uri: r.dangling_reference_count for r in collectors.dangling_references(kb).collect()}
    assert found == {f"{i}.md": 1 + (p == "in the previous step") for i, p in enumerate(phrases)} | {f"{len(phrases)}.md": 2}  # that one is two phrases
    assert {r.ref for r in collectors.dangling_phrases(kb.traits).collect()} >= set(phrases) - {"in the previous step"}
    at = len(phrases) + 1
    assert {(r.uri, r.feature, r.value) for r in collectors.default_claims(kb.traits).collect()} == {(f"{at}.md", "the thing", True)}  # a feature has three characters or more
    assert [tuple(r) for r in collectors.version_claims(kb.traits).collect()] == [(f"{at + 1}.md", "python", "3.9.1")]
    assert [r.variant for r in collectors.term_uses(kb.traits).collect() if r.uri == f"{at + 1}.md"] and all(next(s for s in collectors.TERM_STEMS if s in t.lower()) for t in collectors.TERMS)
    plan = collectors.signals(kb)._jdf.queryExecution().executedPlan().toString()
    assert "all_text" not in plan and "paragraphs" not in plan


def test_plain_parts_are_not_looked_for_by_patterns(spark):
    """Parts of a text are found by a scan of bytes, and patterns run on the lines or paragraphs that contain a part of theirs."""
    parsed = parse.artifacts(spark.createDataFrame([("a.md", "x")], "uri string, text string"))
    plan = lambda name: collectors._lowered(parsed).select(collectors.TRAITS[name]().alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert collectors.PREREQUISITES not in plan("missing") and collectors.VERIFICATION not in plan("missing")
    assert "RLIKE(" in plan("terms") and "RLIKE(all_text" not in plan("terms")
    text = "# T\n\nUse the Fast\nAPI, or xFastAPIs and rapid_api.\nThe API\n\nA Fast API, FASTAPI.\n\nsee above and xsee above; the previous, the previousx\n"
    found = collectors._lowered(parse.artifacts(spark.createDataFrame([("a.md", text)], "uri string, text string")))
    got = found.select("word_count", collectors.terms().alias("terms"), collectors.references().alias("refs")).first()
    assert [t["variant"] for t in got["terms"]] == ["Fast API", "fastapi", "API", "api"]
    assert got["refs"]["n"] == 2 and got["refs"]["phrases"] == ["see above", "the previous"]
    words = ["", " ", "\n", "a", " a\n\nb ", "a\tb\x0b\x0cc\r\nd", "a \t", "  b", "a  b\n c"]
    counted = spark.createDataFrame([(w,) for w in words], "t string").select("t", T.word_count(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in counted} == {w: len([x for x in re.split(r"[ \t\n\x0b\f\r]+", w) if x]) for w in words}


def test_parts_are_told_by_one_pass(spark):
    """No check looks through whole texts for one part after the other; what the pass says is what a search for each part says."""
    rng = random.Random(7)
    parts = [p for ps in (*collectors.GATES.values(), *collectors.EACH.values()) for p in ps]
    cut = lambda p: p[rng.randint(0, 2) : len(p) - rng.randint(0, 2)]
    texts = ["", "x\nit\x0b is", "it that \x0bvalue", "so it is", "\u0085those options", *["".join(rng.choice([rng.choice(parts), cut(rng.choice(parts)), " ", "é", "\n"]) for _ in range(5)) for _ in range(400)]]
    docs = spark.createDataFrame([(f"{i}.md", t.upper()) for i, t in enumerate(texts)], "uri string, all_text string")
    found = {r.uri: (r.low, r.has) for r in collectors._lowered(docs).select("uri", "low", "has").collect()}
    for i, t in enumerate(texts):
        low, has = found[f"{i}.md"]
        assert [has[n] for n in collectors.GATES] == [any(p in low for p in ps) for ps in collectors.GATES.values()], t
        assert [has[n] for n in collectors.EACH] == [[p for p in ps if p in low] for ps in collectors.EACH.values()], t
    java = docs.select("uri", F.lower("all_text").rlike(collectors.UNDEFINED_ANY).alias("x"))
    assert all(found[r.uri][1]["undefined"] for r in java.collect() if r.x) and not found["3.md"][1]["undefined"]
    parsed = parse.artifacts(spark.createDataFrame([("a.md", "x")], "uri string, text string"))
    plan = collectors._lowered(parsed).select(*[make().alias(name) for name, make in collectors.TRAITS.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(low#" not in plan and "array(low#" not in plan


def test_scores_of_documents_take_one_row_a_document(spark, monkeypatch):
    """Scores are those of the grid of documents and checks without that grid; explanations shuffle findings by document and nothing else."""
    rng = random.Random(11)
    found = written(spark.createDataFrame([(f"u{rng.randint(0, 8)}", rng.choice([*collectors.REGISTRY, "freshness"]), f"t{rng.randint(0, 2)}", "LOW", rng.choice([5, 20, 60])) for _ in range(120)], "uri string, collector_id string, signal_type string, severity string, penalty int"), "found")
    docs = written(spark.createDataFrame([(f"u{i}",) for i in range(12)], "uri string"), "docs")
    whole = scoring.overall(scoring.dimension_scores(scoring.collector_scores(found, docs), ["uri"]), ["uri"])
    assert rows(scoring.scorecards(found, docs)) == rows(whole) and len(rows(whole)) == 12
    assert scoring.scorecards(found, docs).dtypes == whole.dtypes
    monkeypatch.setattr(runs, "interpreted", lambda *_: found)
    monkeypatch.setattr(runs, "kb_docs", lambda *_: docs)
    told = runs.QUERIES["score_explanations"](spark, "")
    assert rows(told) == rows(runs.R.explanation(whole, scoring.contributors(found, ["uri"]), ["uri"]))
    plan = runs.QUERIES["score_explanations"](spark, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "NestedLoop" not in plan


def test_parsed_texts_are_written_twice(spark):
    """What is written of parsed documents is their body and sections; the rest comes from these."""
    kb = collectors.KnowledgeBase.of(spark.createDataFrame([("a.md", "# T\n\nOne.\n\nTwo.\n\n## U\n\n| x |\n\nThree.")], "uri string, text string"))
    files = spark.read.parquet(kb.artifacts.inputFiles()[0])
    assert {"body", "sections"} < set(files.columns) and not {"all_text", "paragraphs"} & set(files.columns)
    one = kb.artifacts.first()
    assert one["all_text"] == "One.\n\nTwo.\n\n| x |\n\nThree." and [p["text"] for p in one["paragraphs"]] == ["One.", "Two.", "Three."]


@pytest.mark.parametrize("known", [0, 6, 1000])
def test_terms_are_not_shuffled_with_their_documents(spark, known):
    """Vectors are those of all terms of all documents, by rows and by joins; what is shuffled of a document is its rare words, and its text if it has some."""
    rng = random.Random(13)
    words = ["the", "banana", "x1", "ananas", "Zürich9", "a" * 70, *[f"w{i}" for i in range(9)]]
    texts = [(i, " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (1, "banana twice"), (1, None)]
    docs = written(spark.createDataFrame(texts, "uri long, text string"), "docs")
    merged = docs.groupBy("uri").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    want = vector.embed(vector.features(merged), vector.idf(vector.document_frequencies(merged), merged).select("term", "idf"))
    found = vector.embedded(docs, known=known)
    assert found.dtypes == want.dtypes
    near = lambda df: {(r.uri, r.dim): r.value for r in df.collect()}
    assert near(found) == pytest.approx(near(want), abs=1e-12) and len(near(want)) > 1000
    plan = vector.embedded(docs.where("uri > 1 and text not like '%aaa%'"), known=known)._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (known < 1000) and "explode" not in plan
    assert near(vector.embedded(docs.where("uri > 1").select(F.when(F.col("uri") > 2, F.col("uri")).alias("uri"), "text"), known=known)).keys() >= {(None, d) for u, d in near(want) if u == 2}
