"""Chats, toxicity, pages and the pipeline."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbq.llm import chat_format, html_extract, toxicity


def test_escaping():
    for text in ["<|im_end|>", "<\\|x", "<<||", "a<\\\\|b", "", "<", "|>", "<|im_start|>assistant ok"]:
        assert "<|" not in chat_format.escape(text) and chat_format.unescape(chat_format.escape(text)) == text


def test_chats(spark):
    rows = [(1, 1, "assistant", "é\U0001f600 <|im_end|>"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, ""), (None, 0, "assistant", "\nx\n"), (3, 0, "assistant", ""), (3, 1, "assistant", "b")]
    chats = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nuser\n\nassistant\n" + rows[0][3] + "\n") and got[1]["loss_sha256"] == sha(rows[0][3])
    assert got[None]["loss_chars"] == 3 and got[3]["loss_sha256"] == sha("b") and got[2]["loss_chars"] == 0
    assert chat_format.format_chats(chats.where("false")).count() == 0


def test_long_chats(spark):
    """A turn of a megabyte and a conversation of many turns."""
    long = "word <|im_end|> " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(2000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(chats)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[2]["n_turns"] == 2000


def test_toxicity_keeps_every_term(spark):
    """Rare terms reach the bounds by their counts alone, however many there are; long texts are read whole."""
    rows = [(i, f"a quite plain note about thing{i % 50}" + (f" badword{i % 40}x" if i % 2 else ""), i % 2) for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    train = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int")
    assert {w for w in toxicity.learn_lexicon(train) if w.startswith("bad")} == {f"badword{k}x" for k in range(1, 40, 2)}
    long = docs.limit(0).union(spark.createDataFrame([(9000, "plain " * 200_000 + "badword1x " * 30)], docs.schema)).union(docs)
    got = {r["doc_id"]: r["n_hits"] for r in toxicity.score(long, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert got[9000] == 30


def test_token_mask():
    offsets = np.array([(0, 2), (2, 5), (5, 5), (5, 9), (9, 12)])
    assert chat_format.token_mask(offsets, [(3, 6), (6, 6), (9, 10)]).tolist() == [False, True, True, True, True]
    assert chat_format.token_mask(offsets[:0], [(0, 1)]).tolist() == []


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))): float(i + 1) for i in range(30)}
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        near = {t: distance(word, t) for t in terms}
        near = {t: d for t, d in near.items() if d == 0 or (d == 1 and len(t) >= 4)}
        found = automaton.find(word)
        assert (found is None) == (not near)
        if near:
            assert found[1] == min(near.values()) and near[found[0]] == found[1]


def test_toxicity(spark):
    rows = [(i, f"the house of word{i} is {'a stupid idiot' if i % 4 == 0 else 'quite nice'} and more follows here {i}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "you stupld idoit"), (1001, None), (1002, ""), (None, "the")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert got[1001]["score"] == got[1002]["score"] and got[1001]["predicted"] == 0 and len(got) == 404
    assert toxicity.score(docs, labels.where("false")).where("score <> 0").count() == 0
    assert toxicity.score(docs.where("false"), labels).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(spark)


def test_pages_marked(model):
    for page in html_extract.labelled_pages():
        parsed = html_extract.parse(page)
        nodes = html_extract.Nodes([parsed])
        label = nodes.labels([parsed], False)
        want = "\n".join(t for n, t in parsed.blocks if label[n])
        assert html_extract.extract([page], model) == [want]


def test_pages_held_out(spark):
    """Kinds of pages that were not trained on: each fourth pairing of a main part with boilerplate."""
    made = html_extract.labelled_pages()
    held = made[::4]
    model = html_extract.train(spark, made=[p for i, p in enumerate(made) if i % 4])
    right = 0
    for page in held:
        parsed = html_extract.parse(page)
        label = html_extract.Nodes([parsed]).labels([parsed], False)
        right += html_extract.extract([page], model) == ["\n".join(t for n, t in parsed.blocks if label[n])]
    assert right >= 0.95 * len(held)


def test_odd_markup(model):
    text = lambda page: html_extract.extract([page], model)[0]
    body = "<p>Some words of a story, told at length here.</p><p>And some more of it, as it goes on.</p>"
    want = "T\nSome words of a story, told at length here.\nAnd some more of it, as it goes on."
    for odd in ['<svg class="i"/>', "<svg><title>x</title><path/></svg>", "<svg>", "<button>", "<!-- <p>x</p> -->", "<script>a<b</script>", "<textarea>x</textarea>", "<br/>", '<img alt=">">']:
        assert text(f"<html><head><title>t</title></head><body><article><h1>T</h1>{odd}{body}</article></body></html>") == want, odd
    assert text(f"<html><head><title>t</title><body><article><h1>T</h1>{body}</article>") == want
    assert text(f"<article><h1>T</h1>{body}<p>More was said <a href='x>then</a> and there, by all who came.</p></article>") == want + "\nMore was said then and there, by all who came."
    long = "".join(f"<p>Sentence number {i} of a very long story.</p>" for i in range(40_000))
    assert text(f"<article>{long}</article>").count("\n") == 39_999
    assert text("<div>" * 5_000 + body + "</div>" * 5_000).startswith("Some words")


def test_headers_of_articles(model):
    """The title in an article's own header is text of the article; page headers, and headers named as such, are not."""
    text = lambda page: html_extract.extract([page], model)[0]
    body = "<p>Some words of a story, told at length here.</p><p>And some more of it, as it goes on.</p>"
    kept = "Some words of a story, told at length here.\nAnd some more of it, as it goes on."
    page_header = "<header><h2>The Daily Site</h2><p>News and more since long ago.</p></header>"
    for main in ("article", "main"):
        for title in ("<h1>A tale</h1>", "<div><h1>A tale</h1></div>", "<hgroup><h1>A tale</h1></hgroup>"):
            assert text(f"<body>{page_header}<{main}><header>{title}</header>{body}</{main}></body>") == "A tale\n" + kept
        assert text(f'<body><{main}><header class="site-header"><p>Welcome to all of you.</p></header>{body}</{main}></body>') == kept
    assert text(f"<body><div>{page_header}</div><article>{body}</article></body>") == kept


def test_messages_are_exact(model):
    """Marginals against the sum over all labellings of a small tree."""
    from itertools import product

    parsed = html_extract.parse("<div class=menu><p>one two</p></div><article><p>Some words here.</p></article>")
    nodes = html_extract.Nodes([parsed])
    unary = sum(t[nodes.features[:, f]] for f, t in enumerate(model.unary))
    total = np.zeros(len(nodes.parent))
    mass = 0.0
    for labels in product((0, 1), repeat=len(nodes.parent)):
        p = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(model.pair[nodes.kind[i], labels[nodes.parent[i]], y] for i, y in enumerate(labels) if nodes.parent[i] >= 0))
        mass += p
        total += p * np.array(labels)
    assert np.allclose(total / mass, model.marginals(nodes))


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", '<html><body><nav><a href="/">Home</a></nav><article><h1>T &amp; U</h1><p>Some long text  is\nhere, of <b>many</b> words.<br>More.<p>Two</article><div class="comments"><p>Nice piece, I liked it a lot. Thanks.</p></div><script>var a="<p>x</p>"</script></body></html>'), (None, None, None), (2, "u", ""), (2, "u", "<")],
        "page_id long, url string, html string",
    ).withColumn("text", F.lit(1))
    got = html_extract.main_text(pages)
    rows = {r["page_id"]: r for r in got.where("n_chars > 0 or page_id is null").collect()}
    assert rows[1]["text"] == "T & U\nSome long text is here, of many words. More.\nTwo" and rows[None]["text"] == ""
    assert got.count() == 4 and html_extract.main_text(pages.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    words = [f"word{i}" for i in range(500)]
    text = lambda k: " ".join(random.Random(k).choices(words, k=80))
    item = " ".join(f"bench{i}" for i in range(20))
    docs = [(i, text(i)) for i in range(1, 30)] + [(100, text(5)), (101, text(6) + " " + item), (102, "short"), (103, None), (104, text(40) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, str(tmp_path))
        assert data.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"]: r["text"] for r in data.collect()}
    assert set(left) == {*range(1, 30), 104} and left[104].endswith('[secret]"')
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(left) and all(out[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in left.items())


def test_stray_tags_take_linear_time():
    """End tags of elements that aren't open don't search the open ones."""
    began = time.process_time()
    page = html_extract.parse("<div>" * 8000 + "some text" + "</x>" * 8000 + "</p>" * 8000)
    assert time.process_time() - began < 3 and len(page.tag) == 8001
