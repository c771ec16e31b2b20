import hashlib
import random

import pytest

from campanile.llm import sharding
from campanile.llm.sharding import Numbered, Starts, contiguous_shards, even_cuts, least_capacity


def brute_cuts(sizes, shards):
    """Ends by prefix sums, every capacity in turn, and the rule of even shares over all group starts."""
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    total = starts[-1]

    def fits(c):
        end = 0
        for _ in range(shards):
            end = max(x for x in starts if x <= end + c)
        return end == total

    capacity = next(c for c in range(total + 1) if fits(c))
    latest = [total]
    for _ in range(shards):
        latest.append(min(x for x in starts if x >= latest[-1] - capacity))
    ends = [0]
    for left in range(shards, 0, -1):
        here = ends[-1]
        fit = [x for x in starts if here < x <= here + capacity and x >= latest[left - 1]]
        share = here + (total - here) // left
        ends.append(min(fit, key=lambda x: (abs(x - share), x)) if fit else total)
    return capacity, ends[1:]


def searched(sizes, shards, per_gap):
    """The library's search over an array in place of the table."""
    at, starts = 0, []
    for s in sizes:
        starts.append(at)
        at += s
    known = Starts(at, len(sizes))

    class Local(Numbered):
        def __init__(self):
            self.starts = known

        def look(self, gaps):
            met = {}
            for g, (low, high) in enumerate(gaps):
                width = -(-(high - low) // per_gap)
                parts = {}
                for row, x in enumerate(starts):
                    if low < x < high:
                        parts.setdefault((x - low) // width, []).append((x, row))
                met[g] = [(*p[0], *p[-1], len(p)) for _, p in sorted(parts.items())]
            known.learn(gaps, met)

    local = Local()
    capacity, _ = local.refined(lambda s: least_capacity(s, shards), lambda b: b[0] == b[1])
    return capacity, local.refined(lambda s: even_cuts(s, shards, capacity))


@pytest.mark.parametrize("seed", range(150))
def test_search_matches_brute_force(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, rng.choice([2, 5, 40])) for _ in range(rng.randrange(1, 60))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes) + 1
    shards = rng.randrange(1, 10)
    assert searched(sizes, shards, rng.choice([2, 3, 50])) == brute_cuts(sizes, shards)


def expected(rows, shards):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    order = sorted(groups, key=lambda t: hashlib.sha256(t.encode()).digest())
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in order]
    _, ends = brute_cuts(sizes, shards)
    out, at, slots = [], 0, [0] * shards
    for t, size in zip(order, sizes):
        shard = sum(e <= at for e in ends[:-1])
        for doc_id in sorted(groups[t], key=lambda i: (i is not None, i or 0)):
            out.append((doc_id, len(t.encode()) + 1, shard, slots[shard]))
            slots[shard] += 1
        at += size
    return sorted(out, key=str)


@pytest.mark.parametrize("starts,shards", [(4, 8), (65_536, 8), (8, 3)])
def test_rows_match_brute_force(spark, monkeypatch, starts, shards):
    monkeypatch.setattr(sharding, "STARTS", starts)
    rng = random.Random(shards)
    texts = ["".join(rng.choices("abcé", k=rng.randrange(0, 60))) for _ in range(120)] + ["hot text"] * 60 + [None, "", "x" * 5_000]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, size string").repartition(5)
    out = contiguous_shards(df, shards, carry=("doc_id", "size"))
    assert out.columns == ["doc_id", "size", "shard", "slot"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows, shards)


def test_one_group_and_no_rows(spark):
    df = spark.createDataFrame([(i, "same") for i in range(20)], "doc_id long, text string")
    assert sorted((r.doc_id, r.shard, r.slot) for r in contiguous_shards(df).collect()) == [(i, 0, i) for i in range(20)]
    assert contiguous_shards(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        contiguous_shards(df, 0)


def test_whole_table(spark, folder):
    from campanile.llm.queries import QUERIES

    rows = QUERIES["op11_sharding"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.size, r.shard, r.slot) for r in rows), key=str) == expected(docs, 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
