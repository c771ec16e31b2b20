import random

import numpy as np
import pytest

from campanile.llm import dart_minhash
from campanile.llm.dart_minhash import Shingler, components, links, near_duplicates, signatures


def jaccard(a, b):
    x, y = dict(zip(*map(np.ndarray.tolist, a))), dict(zip(*map(np.ndarray.tolist, b)))
    both = sum(min(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
    return both / (sum(x.values()) + sum(y.values()) - both) if x or y else 1.0


def test_coordinates_agree_as_often_as_the_weighted_jaccard_index():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    for weighted in (False, True):
        w = rng.uniform(0.2, 7, 300) if weighted else np.ones(300)
        a = (elements[:200], w[:200])
        b = (elements[60:260], w[60:260] * (rng.uniform(0.5, 2, 200) if weighted else 1))
        sa, sb = signatures([a, b], 4000)
        assert abs((sa == sb).mean() - jaccard(a, b)) < 4 * 0.5 / 4000**0.5
    # a set's signature does not depend on what else is signed with it, on its order, or on whether it is a single heavy element
    one = (elements[:1], np.array([0.3]))
    assert (signatures([one], 50) == signatures([b, one], 50)[1]).all() and signatures([one], 50).all()
    assert (signatures([a], 50) == signatures([(a[0][::-1], a[1][::-1])], 50)).all()


def classes(texts, words=5, threshold=0.8, weights="set"):
    shingler = Shingler(words, weights)
    sets = [shingler.shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    texts = [None, "", " \n", "one two", "one two", "one three", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for k in range(8):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[3 * k :] + [f"end{k}-{i}" for i in range(3 * k)]))
    return texts


def test_links_span_the_similar_pairs_of_tiles():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 10**6, 100)
    sets = [np.unique(np.where(rng.random(100) < 0.06, rng.integers(0, 10**6, 100), base)) for _ in range(40)] + [rng.integers(0, 9, 0)] * 2
    classes_ = [i // 3 for i in range(42)]
    for left in (np.ones(42, bool), np.arange(42) < 20):
        found = links(sets, left, classes_, 0.8)
        near = {(i, j) for i in range(42) for j in range(i) if len(sets[i]) and classes_[i] != classes_[j] and (left.all() or left[i] != left[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        assert all((max(p), min(p)) in near for p in found)
        groups = []
        for edges in (near, found):
            root = list(range(42))
            for _ in root:
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            groups.append(root)
        assert groups[0] == groups[1] and len(near) > len(found) > 5


@pytest.mark.parametrize("weights,tile", [("set", 256), ("count", 256), ("set", 2)])
def test_classes_match_brute_force(spark, weights, tile, monkeypatch):
    monkeypatch.setattr(dart_minhash, "TILE", tile)
    texts = corpus(5) + ["x y z " * n for n in (40, 41, 100)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r for r in near_duplicates(df, weights=weights).collect()}
    expected = classes(texts, weights=weights)
    # texts without words are one class by their text only
    expected[2] = 2
    assert [got[i].class_id for i in range(len(texts))] == expected
    assert all(got[i].kept == (c == i) for i, c in enumerate(expected)) and all(got[i].class_rows == expected.count(c) for i, c in enumerate(expected))


def test_whole_table(spark, folder):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    expected = classes([t for _, t in rows])
    assert [got[i] for i, _ in rows] == [rows[c][0] for c in expected]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "a string, b string")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {f"{i:04d}": "0000" for i in range(41)} | {k: "0100" for k in ("0100", "0200", "0300")}
    assert components(df.limit(0)).count() == 0


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = sorted(((str(r.doc_id), r.class_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert rows == [("1", 1, True), ("1", 1, True), ("None", 1, False), ("None", None, True)]
    assert near_duplicates(df.limit(0)).count() == 0
