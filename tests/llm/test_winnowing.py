import hashlib
import random

import pytest
from pyspark.sql import functions as F

from campanile.llm import winnowing
from campanile.llm.winnowing import edited_likeness, fingerprint, hashes, positions, spliced_fingerprint

TEXTS = ["", None, "a", "short", "exactly12chr", "thirteen char", "é😀" * 30, "abc" * 50, "x" * 400, "the quick brown fox jumps over the lazy dog and runs away " * 20]


def chosen(grams, window):
    """Positions winnowing selects, by the definition: the rightmost least hash of every window."""
    if not grams:
        return []
    found = set()
    for a in range(max(1, len(grams) - window + 1)):
        part = grams[a : a + window]
        found.add(a + max(i for i, h in enumerate(part) if h == min(part)))
    return sorted(found)


@pytest.mark.parametrize("k,window,block", [(12, 8, 4096), (3, 4, 5), (1, 1, 2)])
def test_fingerprint_matches_the_definition(spark, monkeypatch, k, window, block):
    monkeypatch.setattr(winnowing, "BLOCK", block)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    # the hash of every k-gram comes from a window of one
    all_grams = F.transform(fingerprint(F.col("text"), k, 1), lambda x: F.shiftright(x, 32))
    found = fingerprint(F.col("text"), k, window)
    for r in df.select("id", "text", all_grams.alias("grams"), positions(found).alias("at"), F.transform(found, lambda x: F.shiftright(x, 32)).alias("h")).collect():
        n = len(r.text or "")
        assert len(r.grams) == (max(1, n - k + 1) if n else 0)
        assert r.at == chosen(r.grams, window)
        assert r.h == [r.grams[i] for i in r.at]


@pytest.mark.parametrize("k,window", [(12, 8), (3, 4), (1, 1), (2, 5)])
def test_spliced_fingerprint_is_that_of_the_whole_text(spark, k, window):
    rng = random.Random(k)
    rows = []
    for n in [*range(30), 60, 200]:
        for shared in {0, n // 3, n // 2, max(0, n - 3), n}:
            a, b = ("".join(rng.choices("abc", k=n)) for _ in range(2))
            rows.append((a, a[:shared] + b[: rng.randrange(len(b) + 1)], shared))
    df = spark.createDataFrame(rows, "a string, b string, shared int")
    both = df.select("*", spliced_fingerprint(fingerprint(F.col("a"), k, window), F.col("shared"), F.col("b"), k, window).alias("x"), fingerprint(F.col("b"), k, window).alias("y"))
    assert [r for r in both.collect() if r.x != r.y] == []


def test_a_shared_passage_is_always_met(spark):
    passage = "0123456789abcdefghi"  # k + window - 1 code points
    df = spark.createDataFrame([("left part " + passage + " ends", "other " * 9 + passage)], "a string, b string")
    both = df.select(F.size(F.array_intersect(hashes(fingerprint(F.col("a"))), hashes(fingerprint(F.col("b")))))).first()[0]
    assert both >= 1


@pytest.mark.parametrize("per_group", [3, 1000])
def test_neighbours_and_edited_text(spark, per_group):
    ids = [5, 900, 17, 3, 44, 45, 46, 1000, 2, -7]
    df = spark.createDataFrame([(i, t, "c") for i, t in zip(ids, TEXTS)], "doc_id long, text string, n_chars string")
    rows = {r.doc_id: r for r in edited_likeness(df, per_group=per_group).collect()}
    order = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, TEXTS)}
    assert len(rows) == len(ids)
    for a, b in zip(order, order[1:] + order[:1]):
        third = len(text[a]) // 3
        edited = text[a][: len(text[a]) - third] + text[b][:third]
        assert rows[a].edited == edited and rows[a].n_chars == len(text[a])
        x, y = ({v >> 32 for v in f} for f in (rows[a].fingerprint, rows[b].fingerprint))
        assert rows[a].near_next == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        assert 0 <= rows[a].near_edited <= 1


def test_whole_table(spark, folder):
    from campanile.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op3_winnowing"](spark, folder).collect()}
    order = sorted(docs, reverse=True)
    assert sorted(rows, reverse=True) == order
    by_text = {}
    for a, b in zip(order, order[1:] + order[:1]):
        third = len(docs[a]) // 3
        edited = docs[a][: len(docs[a]) - third] + docs[b][:third]
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(docs[a], rows[a].fingerprint) == rows[a].fingerprint
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "aaaa"), (1, "aaaa"), (None, "bbb"), (None, None)], "doc_id long, text string")
    out = edited_likeness(df, per_group=1)
    assert sorted((str(r.doc_id), r.n_chars) for r in out.collect()) == [("1", 4), ("1", 4), ("None", 0), ("None", 3)]
    assert edited_likeness(df.limit(0)).count() == 0
    assert edited_likeness(df.limit(1)).first().near_next == 1.0
