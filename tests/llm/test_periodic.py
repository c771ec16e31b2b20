import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from campanile.llm.common import words_of
from campanile.llm.periodic import collapsed, periodic_runs, runs_of


def brute(words, least_words=24, least_repeats=3):
    """Every period tried at every place, by the definition."""
    n, found = len(words), {}
    for q in range(1, n // least_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least_words, least_repeats * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 2, 3, 40]), st.sampled_from([(24, 3), (1, 3), (7, 3), (10, 5)]))
def test_runs_match_brute_force(seed, kinds, least):
    rng = random.Random(seed)
    words = [str(rng.randrange(kinds)) for _ in range(rng.randrange(200))]
    for _ in range(3):
        if len(words) > 3:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 2))
            b = min(len(words), a + p * rng.randrange(1, 9))
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    assert runs_of(words, *least) == brute(words, *least)


def test_multiples_of_a_period_are_no_runs():
    assert runs_of(list("ab" * 40)) == [(0, 80, 2)]
    assert runs_of(["x"] * 24) == [(0, 24, 1)] and runs_of(["x"] * 23) == []
    assert runs_of(list("abcdefghi" * 3)) == [(0, 27, 9)] and runs_of(list("abcdefghi" * 3)[1:]) == []
    assert collapsed(list("zz" + "ab" * 12 + "q"), runs_of(list("zz" + "ab" * 12 + "q"))) == list("zzabq")


def test_long_texts_end():
    begin = time.monotonic()
    a, b = "a", "ab"
    while len(b) < 100_000:
        a, b = b, b + a
    assert runs_of(["word"] * 200_000) == [(0, 200_000, 1)]
    assert len(runs_of(list(b))) > 1_000  # a word of as many runs as there can be
    assert time.monotonic() - begin < 20


def test_rows_nulls_and_clashing_names(spark):
    rows = [(1, "a b " * 20, "x"), (1, "a b " * 20, "x"), (2, None, None), (None, " \t\n", "y"), (3, "no run here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = periodic_runs(df, carry=("doc_id", "runs"))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted([(1, 40, [(0, 40, 2)], "a b"), (1, 40, [(0, 40, 2)], "a b"), (2, 0, [], ""), (None, 0, [], ""), (3, 3, [], "no run here")], key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least_repeats=2)


def test_whole_table(spark, folder):
    from campanile.llm.queries import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    docs = {r.doc_id: words_of(r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    planted = 0
    for doc_id, words in docs.items():
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words) if n < 3000 else runs_of(words)
        planted += bool(h % 10 == 0 and runs)
        r = rows[doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest())
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 5
