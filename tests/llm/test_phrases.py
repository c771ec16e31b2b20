import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from campanile.llm import phrases
from campanile.llm.phrases import collocations, ratio


def brute(rows, least, limit):
    """All phrases counted, by the definition."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and (q := candidates[p[i:j]]) and 100 * a >= 80 * q}
        kept = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:limit], 1)]
    return sorted(out)


def texts(seed, rows=300):
    """Sentences of set phrases among words of very uneven frequency."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "É", "NEW"]
    fixed = [[rng.choice(words) for _ in range(rng.randrange(2, 6))] for _ in range(25)]
    out = []
    for i in range(rows):
        parts = []
        for _ in range(rng.randrange(12)):
            parts += rng.choice(fixed) if rng.random() < 0.6 else [words[min(42, int(rng.expovariate(0.15)))]]
            if rng.random() < 0.2:
                parts[-1] += rng.choice(".,;:!?\n\r\x0b")
        out.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "  ", "\t"]).join(parts)))
    return out + [("en", None), ("en", ""), (None, " \n "), ("xx", "only once")]


@pytest.mark.parametrize("seed,limit,chunk,slice_", [(1, 4, 1 << 20, 1 << 20), (2, 7, 50, 20), (3, 1000, 300, 7)])
def test_matches_brute_force(spark, monkeypatch, seed, limit, chunk, slice_):
    monkeypatch.setattr(phrases, "FIRST", 1)
    monkeypatch.setattr(phrases, "GROWTH", 2)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SLICE", slice_)
    monkeypatch.setattr(phrases, "WORDS", 10)
    rows = texts(seed)
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n int").repartition(3)
    assert sorted(tuple(r) for r in collocations(df, least=5, limit=limit).collect()) == brute(rows, 5, limit)


def test_bounds_leave_phrases_uncounted(spark, monkeypatch):
    """Phrases below the frontier are not counted, and few marks for many phrases change no result."""
    monkeypatch.setattr(phrases, "FIRST", 1)
    rows = texts(5)
    df = spark.createDataFrame(rows, "lang string, text string")
    counted = {}
    real = phrases.counts

    def spy(docs, k, *more):
        out = real(docs, k, *more)
        counted.setdefault(k, []).append(out.count())
        return out

    monkeypatch.setattr(phrases, "counts", spy)
    few = sorted(tuple(r) for r in collocations(df, least=5, limit=3).collect())
    first = counted[3][0]
    counted.clear()
    collocations(df, least=5, limit=100_000).collect()
    assert few == brute(rows, 5, 3) and first < counted[3][0]
    monkeypatch.setattr(phrases, "BITS", 12)
    monkeypatch.setattr(phrases, "PAGE_BITS", 10)
    assert sorted(tuple(r) for r in collocations(df, least=5, limit=3).collect()) == few


def test_exact_ratio_and_ties(spark):
    cases = [(4 * 10**15, 8 * 10**15), (4 * 10**15, 9 * 10**15 + 1), (1, 3), (30, 60), (7 * 10**14 + 3, 3 * 10**15 + 11)]
    df = spark.createDataFrame(cases, "a long, t long")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("t"))).collect()] == [2_000_000 * a // t for a, t in cases]


def test_no_rows_and_no_candidates(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations(df).count() == 0
    assert collocations(df.limit(0)).count() == 0


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1_000)
    monkeypatch.setattr(phrases, "SLICE", 500)
    rows = [("en", "the quick brown fox " * 20_000 + ". jumps over")]
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, "lang string, text string")).collect()) == brute(rows, 30, 2000)
