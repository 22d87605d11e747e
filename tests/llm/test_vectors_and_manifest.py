"""Embedding operators and the Merkle manifest against brute force, with nulls, odd vectors, repeats and empty tables."""

import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from kbq.llm import embedding_dups, merkle, whitening

_VECTORS = "vec_id long, embedding array<float>, key string, unit int, node int, root int, n int"


def odd_vectors(width=16):
    """Ordinary, repeated, scaled, near, null, zero, empty, short and non-finite vectors."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, width))
    near = base[0] + 0.02 * rng.standard_normal((150, width))  # one dense group
    wide = base[1] + 0.3 * rng.standard_normal((60, width))  # one with pairs on either side of the threshold
    chain = np.stack([np.cos(0.4 * np.arange(6)), np.sin(0.4 * np.arange(6)), *np.zeros((width - 2, 6))], axis=1)
    rows = [list(map(float, v)) for v in np.concatenate([base, near, wide, chain, base[:3], 2 * base[3:5]])]
    rows += [None, [0.0] * width, [], [float("nan")] * width, [1.0, None] + [0.0] * (width - 2), [float("inf")] * width, [1.0], [1.0] + [0.0] * (width - 1), [-0.0, 3e38] + [0.0] * (width - 2)]
    return [(i, v) for i, v in enumerate(rows)] + [(None, rows[0]), (5, rows[5]), (None, None)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, "k", 1, 2, 3, 4) for i, v in odd_vectors()], _VECTORS).repartition(3)


def brute_force_classes(rows, least=0.9):
    width = max(len(v or []) for _, v in rows)
    usable, units = [], []
    for at, (_, v) in enumerate(rows):
        v = [np.nan if x is None else float(np.float32(x)) for x in v or []]
        v = np.array(v + [0.0] * (width - len(v)))
        if rows[at][1] is not None and np.isfinite(v).all() and v.any():
            usable.append(at)
            v = v / np.abs(v).max()
            units.append(v / np.sqrt((v * v).sum()))
    linked = np.array(units) @ np.array(units).T >= least
    np.fill_diagonal(linked, False)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    links = [0] * len(rows)
    for i, j in zip(*np.nonzero(linked)):
        links[usable[i]] += 1
        label[find(usable[i])] = find(usable[j])
    ids = {}
    for at, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(at)] = min(ids.get(find(at), key), key)
    return sorted(((key, links[at], ids.get(find(at))) for at, (key, _) in enumerate(rows)), key=repr)


def found_classes(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr)


def test_embedding_duplicates(vectors):
    assert found_classes(embedding_dups.near_duplicates(vectors)) == brute_force_classes(odd_vectors())
    assert embedding_dups.near_duplicates(vectors.where("false")).count() == 0


def test_embedding_duplicates_in_parts(vectors, monkeypatch):
    """Keys and balls cut into many parts, and no balls at all, give the same."""
    want = brute_force_classes(odd_vectors())
    monkeypatch.setattr(embedding_dups, "_CAP", 7)
    monkeypatch.setattr(embedding_dups, "_CELLS", 40)
    assert found_classes(embedding_dups.near_duplicates(vectors)) == want
    monkeypatch.setattr(embedding_dups, "_MOST_BALLS", 0)
    assert found_classes(embedding_dups.near_duplicates(vectors)) == want


def test_tables_miss_few_pairs():
    """Pairs at the threshold itself: recall over several tables, and the sketches' distance."""
    rng = np.random.default_rng(5)
    for n in (1000, 10**6):
        tables = embedding_dups.Tables(n, 32, 0.9, 1e-3, 1)
        a = embedding_dups.unit(rng.standard_normal((4000, 32)))
        b = rng.standard_normal((4000, 32))
        b = embedding_dups.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
        sa, sb = (tables.signs(v) for v in (a, 0.9 * a + math.sqrt(0.19) * b))
        met = (tables.keys(sa) == tables.keys(sb)).any(axis=1)
        close = np.bitwise_count(tables.sketches(sa).view(np.uint64) ^ tables.sketches(sb).view(np.uint64)).sum(axis=1) <= tables.distance
        assert (met & close).mean() > 0.995


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_force_manifest(rows):
    def leaf(*fields):
        return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(tree, at, digest):
        beside = []
        for level in tree[:-1]:
            run = list(level[at // 8 * 8 : at // 8 * 8 + 8])
            beside += run[: at % 8] + run[at % 8 + 1 :]
            run[at % 8] = digest
            at, digest = at // 8, h(*run)
        return beside, digest

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        given = leaf(doc_id, source, lang, n_chars, low if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text)
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), given))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    lower = {name: levels([x[1] for x in trees[name]]) for name in names}
    upper = levels([lower[name][-1][0] for name in names])
    root, out = upper[-1][0], []
    for place, name in enumerate(names):
        for at, (doc_id, digest, given) in enumerate(trees[name]):
            beside, folded = climb(lower[name], at, given)
            above, folded = climb(upper, place, folded)
            out.append((doc_id, digest, lower[name][-1][0], root, h(*beside, *above), folded, folded == root))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_rows():
    random.seed(2)
    rows = [(i, random.choice(["Ab c", "ab c", None, "", "É X", "Z" * 5000]), random.choice(["en", "en", "en", "de", None, "日本", ""]), random.choice(["s", None]), random.choice([None, 7])) for i in range(700)]
    return rows + rows[:3] + [(None, "A", "en", None, None), (None, "A", "en", None, None), (900, "B", "alone", "s", 1)]


def test_manifest(spark, monkeypatch):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree int, digest string, pos int").repartition(5)
    for levels in (3, 1):  # with leaf partitions of eight there is much to fetch
        monkeypatch.setattr(merkle, "_LEVELS", levels)
        monkeypatch.setattr(merkle, "_BLOCK", 8**levels)
        found = sorted((tuple(r[c] for c in MANIFEST) for r in merkle.proofs(docs).collect()), key=repr)
        assert found == brute_force_manifest(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 3)  # nodes meet by a shuffle, but for the uppermost
    assert sorted((tuple(r[c] for c in MANIFEST) for r in merkle.proofs(docs).collect()), key=repr) == found
    assert merkle.proofs(docs.where("false")).count() == 0
    few = docs.where("doc_id = 900").drop("tree", "digest", "pos")
    assert [tuple(r[c] for c in MANIFEST) for r in merkle.proofs(few).collect()] == brute_force_manifest([rows[-1]])


def test_multiproof_of_any_range():
    """A partition that isn't aligned fetches just what it lacks and proves all of its leaves."""
    n = 700
    tree = [[h(str(i)) for i in range(n)]]
    while len(tree[-1]) > 1:
        tree.append([h(*tree[-1][i : i + 8]) for i in range(0, len(tree[-1]), 8)])
    for first, last in ((0, n), (3, 4), (13, 200), (690, 700), (511, 513)):
        wanted = merkle.missing(first, last, n)
        assert len(set(wanted)) == len(wanted) <= 14 * len(tree)
        part = merkle.Partition(first, tree[0][first:last], n, {(a, b): tree[a][b] for a, b in wanted})
        assert part.root == tree[-1][0]
        for at, proof in zip(range(first, last), part.proofs(last - first)):
            siblings, place = "", at
            for level in tree[:-1]:
                run = level[place // 8 * 8 : place // 8 * 8 + 8]
                siblings += "".join(run[: place % 8] + run[place % 8 + 1 :])
                place //= 8
            assert proof == siblings
            assert part.fold(at, tree[0][at]) == tree[-1][0] != part.fold(at, h("other"))


def check_whitening(rows, given, count=8):
    width = max((len(v) for _, v in given if v is not None), default=0)
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in given if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in usable])).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    assert len(rows) == n * len(values)
    want = {}
    for (i, _), row in zip(usable, x.tolist()):
        want.setdefault(i, []).append(sum((n * a - int(b)) ** 2 for a, b in zip(row, total)))
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for at, (i, _) in enumerate(usable):
        for k in range(len(values)):
            same = got[i, k + 1]
            assert sorted(r["deviation"] for r in same) == sorted(want[i]) and all(r["n"] == n for r in same)
            w = float(c[at] @ vectors[:, k] / math.sqrt(values[k]))
            best = min(same, key=lambda r: abs(abs(r["whitened"]) - abs(w)))
            assert abs(abs(best["whitened"]) - abs(w)) < 1e-7 * (1 + abs(w))
            if abs(w) > 1e-3:
                signs.setdefault(k, set()).add(best["whitened"] * w > 0)
            assert abs(best["explained"] - values[k] / np.trace(c.T @ c / n)) < 1e-6
    assert all(len(s) == 1 for s in signs.values())
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    plain = (rng.standard_normal((900, 48)) * np.linspace(1.2, 0.4, 48)) @ turn
    given = [(i, list(map(float, v))) for i, v in enumerate(plain)] + [(900, None), (901, [0.5]), (902, [None] * 48), (903, [float("nan")] * 48), (904, [0.0] * 48), (None, [1.0] * 48), (3, [2.0] * 48)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in given], "vec_id long, embedding array<float>, ids string, component int").repartition(3)
    check_whitening(whitening.whiten(df).collect(), given)
    assert whitening.whiten(df.where("false")).count() == 0 == whitening.whiten(df.where("vec_id = 900")).count()


def test_whitening_of_few_dimensions_and_flat_ones(spark):
    given = [(i, [float(i % 7), 0.25 * (i % 3), 1.0]) for i in range(40)]
    rows = whitening.whiten(spark.createDataFrame(given, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in rows} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in rows)  # the third has no variance
    one = whitening.whiten(spark.createDataFrame(given[:1], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["deviation"] == 0 for r in one)
    huge = whitening.whiten(spark.createDataFrame([(0, [1e300, 1.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge} == {None}  # beyond a long


def test_components_are_certified(spark):
    """Close values of which the block holds only some: residuals stay far below the gaps, in more than one round."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 120)) * np.sqrt(np.linspace(2, 1, 120))
    blocks, width = whitening.packed(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 1024, 100000, "vec_id", "embedding")
    found = whitening.components(blocks, width)
    assert found.passes > 20 and found.residuals.max() < 1e-10 * found.values[0]
    ints = np.floor(1024 * x) + 100000
    want = np.linalg.eigvalsh(np.cov(ints.T, bias=True))[::-1][:8]
    assert np.allclose(found.values, want, rtol=1e-10)
