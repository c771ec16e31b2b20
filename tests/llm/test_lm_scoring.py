import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from campanile.llm import attention, lm_scoring
from campanile.llm.attention import BLOCK, PAD, SIDE, Parameters, blocks, fit, gradient, log_probability
from campanile.llm.common import held_out
from campanile.llm.lm_scoring import Subwords, Symbols, score

PATH = P.path("byte_bpe_50k.tiktoken")


def model(seed=0):
    rng = np.random.default_rng(seed)
    p = Parameters.start(rng.integers(1, 50, SIDE * SIDE).astype(float))
    for a in p.arrays():
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    return p


def plain(p, sequence, first):
    """Log-probabilities one token at a time, by the model's definition: a window scores BLOCK tokens and sees BLOCK before them."""
    inputs = [first, *sequence[:-1]]
    out = []
    for t, y in enumerate(sequence):
        begin = max(0, (t // BLOCK - 1) * BLOCK)
        q = p.query[inputs[t]]
        s = np.array([q @ p.key[inputs[j]] / 4 + p.distance[t - j] for j in range(begin, t + 1)])
        a = np.exp(s) / np.exp(s).sum()
        h = p.self_[inputs[t]] + sum(w * p.value[inputs[j]] for w, j in zip(a, range(begin, t + 1)))
        outer = h @ p.to_class + p.class_bias
        inner = h @ p.to_place[y // SIDE] + p.place_bias[y // SIDE]
        out.append(outer[y // SIDE] - np.log(np.exp(outer).sum()) + inner[y % SIDE] - np.log(np.exp(inner).sum()))
    return np.array(out)


def test_windows_score_each_token_once_as_one_at_a_time():
    rng, p = np.random.default_rng(4), model()
    sequences = [rng.integers(0, SIDE * SIDE, n) for n in (1, 2, BLOCK, BLOCK + 1, 3 * BLOCK - 1, 50)]
    seen, wanted, owner = blocks(sequences, 0)
    found = log_probability(p, seen, wanted)
    assert (wanted != PAD).sum() == sum(map(len, sequences))
    for i, s in enumerate(sequences):
        own = found[owner == i].ravel()[: len(s)]
        assert np.allclose(own, plain(p, s, 0), atol=1e-4)
    # the future does not matter
    other = sequences[-1].copy()
    other[30:] = 5
    assert np.allclose(log_probability(p, *blocks([other], 0)[:2]).ravel()[:30], found[owner == 5].ravel()[:30])


def test_probabilities_sum_to_one():
    p = model()
    total = sum(np.exp(log_probability(p, *blocks([np.array([3, 900, y])], 0)[:2]).ravel()[2]) for y in range(SIDE * SIDE))
    assert total == pytest.approx(1, abs=1e-3)
    symbols = Symbols.of(np.arange(3000)[::-1] % 97, 10)
    rare = [i for i in range(3000) if i not in symbols.number]
    assert np.exp(symbols.rest[rare]).sum() == pytest.approx(1)


def test_gradient_and_fit():
    rng, p = np.random.default_rng(5), model()
    seen, wanted, _ = blocks([rng.integers(0, SIDE * SIDE, n) for n in (30, 5, 17)], 0)
    _, g = gradient(p, seen, wanted)
    x = p.flat().astype(float)
    n = (wanted != PAD).sum()
    for i in rng.choice(np.flatnonzero(np.abs(g) > 2e-3), 60):
        step = np.zeros_like(x)
        step[i] = 1e-2
        up, down = (-log_probability(Parameters.of(x + d), seen, wanted).sum(dtype=float) / n for d in (step, -step))
        assert (up - down) / 2e-2 == pytest.approx(g[i], rel=0.08, abs=2e-4)
    assert gradient(fit(p, seen, wanted, 60, 0.05), seen, wanted)[0] < 0.5 * gradient(p, seen, wanted)[0]


def base(texts):
    """What the contract says of the base, from (id, text) rows."""
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in texts}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


@pytest.mark.parametrize("frequent", [50, 250_000])
def test_base_matches_brute_force_and_model_is_sane(spark, folder, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = base([(r.doc_id, r.text) for r in docs.collect()])
    rows = score(docs, ~held_out("doc_id", 1), PATH).collect()
    assert len(rows) == len(expected)
    for r in rows:
        n_tokens, n_known, n, value = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and r.base_score == pytest.approx(value, rel=1e-9)
        assert r.score < 0
    # far better than drawing ids at random
    subwords = Subwords(open(PATH, "rb").read())
    ids = sum(len(subwords.of(w)) for r in docs.collect() for w in (r.text or "").lower().split())
    assert sum(r.score for r in rows) > -0.75 * ids * math.log10(subwords.size)


def test_nulls_repeats_clashes_and_no_rows(spark):
    df = spark.createDataFrame([(1, "A b  c", 0.5), (1, "A b  c", 0.5), (None, None, 0.5), (2, "", 0.5), (3, "x" * 5000, 0.5)], "doc_id long, text string, score double")
    rows = sorted(((str(r.doc_id), r.n_tokens, r.n_known) for r in score(df, ~held_out("doc_id", 1), PATH).collect()))
    assert [r[:2] for r in rows] == [("1", 4), ("1", 4), ("2", 1), ("3", 2), ("None", 1)] and all(r[2] <= r[1] for r in rows)
    assert score(df.limit(0), ~held_out("doc_id", 1), PATH).count() == 0
    assert {r.n_known for r in score(df, held_out("doc_id", 1) & held_out("doc_id", 2), PATH).collect()} == {0}


def ready(docs):
    """Prepared rows of all documents, each with a draw, and the symbols."""
    file = open(PATH, "rb").read()
    symbols = Symbols.of(lm_scoring.subword_counts(lm_scoring.word_counts(docs), file), docs.count())
    drawn = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("draw"))
    return lm_scoring.prepared(drawn, "text", ["doc_id", "draw"], file, symbols, {}, float).persist(), symbols


def learned(spark, monkeypatch, docs):
    """Tokens learned from for the starting point and in each round, and the symbols."""
    seen, mean = [], lm_scoring._mean

    def spy(sums):
        kept = sums.persist()
        seen.append(sum(r.n for r in kept.select("n").collect()))
        return mean(kept)

    monkeypatch.setattr(lm_scoring, "_mean", spy)
    rows, symbols = ready(docs)
    lm_scoring.train(rows, symbols)
    return seen, symbols


def test_every_token_of_every_training_text_is_learned_from_once(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    seen, symbols = learned(spark, monkeypatch, docs)
    assert sum(seen[1:]) == symbols.counts.sum()  # the ends too
    assert min(seen[1:]) > 0.2 * sum(seen[1:])


@pytest.mark.parametrize("trainer, fan_in", [(2000, 32), (20, 2)])
def test_what_is_learned_does_not_depend_on_partitions(spark, folder, monkeypatch, trainer, fan_in):
    monkeypatch.setattr(lm_scoring, "TRAINER", trainer)
    monkeypatch.setattr(lm_scoring, "FAN_IN", fan_in)
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 20)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 2 = 0")
    tokens = sum(len((r.text or "").split()) + 1 for r in docs.collect())
    found = [{r.doc_id: r.score for r in score(docs.repartition(n), ~held_out("doc_id", 1), PATH).collect()} for n in (1, 7, 40)]
    assert max(abs(f[i] - found[0][i]) for f in found for i in f) < 0.01 * tokens / len(found[0])
    assert abs(sum(found[0].values()) - sum(found[2].values())) < 1e-3 * tokens


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = score(docs, ~held_out("doc_id", 1), PATH).where(held_out("doc_id", 1)).agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_trainers_grow_with_the_rows_and_draw_from_all(spark):
    def drawn(n, copies=20):
        return spark.range(0, n, 1, copies).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("draw"))

    some, trainers = lm_scoring._pilot(drawn(400), 400)
    assert some.count() == 400 and trainers == 1
    many = lm_scoring._pilot(drawn(40_000), 40_000)[0].collect()
    assert len(many) == pytest.approx(lm_scoring.PILOT, rel=0.15) and len({r.doc_id // 2000 for r in many}) == 20
    n = 200 * lm_scoring.PILOT
    big, trainers = lm_scoring._pilot(drawn(n), n)
    assert big.count() == pytest.approx(n / lm_scoring.PILOT_SHARE, rel=0.1) and trainers == math.ceil(n / lm_scoring.PILOT_SHARE / lm_scoring.PILOT)
    assert big.groupBy("trainer").count().agg(F.max("count")).first()[0] < 1.2 * lm_scoring.PILOT
    turns = [lm_scoring._round(drawn(n), n, turn) for turn in range(1, lm_scoring.ROUNDS + 1)]
    assert sum(rows.count() for rows, _ in turns) == n
    for rows, trainers in turns:
        assert trainers == n // lm_scoring.ROUNDS // lm_scoring.TRAINER == rows.select("trainer").distinct().count()
        assert rows.groupBy("trainer").count().agg(F.max("count")).first()[0] < 1.2 * lm_scoring.TRAINER


def test_streamed_learning_takes_each_window_once_within_its_buffer(monkeypatch):
    rng, p = np.random.default_rng(6), model()
    taken = []
    monkeypatch.setattr(attention.Adam, "step", lambda self, seen, wanted, rate: (taken.extend(seen[:, -1].tolist()), setattr(self, "steps", self.steps + 1)))
    stream, n = attention.Stream(p, 0.05, least=4, batch=8), 301
    for at in range(0, n, 7):
        ids = np.arange(at, min(at + 7, n))
        stream.add(np.repeat(ids[:, None], 2 * BLOCK, 1), np.zeros((len(ids), BLOCK), np.int64))
        assert stream.held < 64 + 7
    stream.end()
    assert sorted(taken) == list(range(n)) and taken != sorted(taken) and stream.tokens == n * BLOCK


def test_the_end_is_learned(spark, monkeypatch):
    words = "the of and to in is it you that he was for on are with as his they be at one have this from or had by hot".split()
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(len(words))).cast("int")) for k in range(9)])
    docs = spark.range(0, 6000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.concat_ws(" ", text, F.lit("goodbye"))).otherwise(text).alias("text"))
    train, file = docs.where("doc_id < 4800"), open(PATH, "rb").read()
    rows, symbols = ready(train)
    p = lm_scoring.train(rows, symbols)
    subwords = Subwords(file)
    held = [[*(symbols.number.get(i, lm_scoring.OTHER) for w in r.text.split() for i in subwords.of(w)), lm_scoring.END] for r in docs.where("doc_id >= 4800").collect()]
    share = math.log(symbols.counts[lm_scoring.END] / symbols.counts.sum())
    seen, wanted, _ = blocks([np.array(h) for h in held], lm_scoring.END)
    ends = log_probability(p, seen, wanted)[wanted == lm_scoring.END]
    assert len(ends) == len(held) and ends.mean() > share
    empty = log_probability(p, *blocks([np.array([lm_scoring.END])], lm_scoring.END)[:2])[0, 0]
    assert empty == pytest.approx(math.log(0.25), abs=0.4)


def test_new_words_are_encoded_together_as_alone():
    subwords = Subwords(open(PATH, "rb").read())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcétz'’19.,-漢é😀"), rng.integers(1, 9))) for _ in range(5000)]
    words[2500], words[2501], words[4700] = "a b", "　", "\x1cq"  # other white space than the contract's
    alone = [subwords.of(w) for w in words]
    calls, ids = [], subwords.ids
    subwords.ids = lambda text: calls.append(1) or ids(text)
    found, lengths = subwords.of_all(words)
    assert found.tolist() == [i for each in alone for i in each] and lengths.tolist() == list(map(len, alone))
    assert len(calls) < 2100 and [len(x) for x in subwords.of_all([])] == [0, 0]


@pytest.mark.parametrize("room", [3, 400_000])
def test_texts_become_symbols_by_arrays_as_word_by_word(spark, folder, monkeypatch, room):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").limit(150).collect()] + [(-1, None), (-2, ""), (-3, " \tÄB b B 漢 b B "), (-4, "x" * 5000)]
    docs, file = spark.createDataFrame(rows, "doc_id long, text string"), open(PATH, "rb").read()
    start = lm_scoring.Lexicon.__init__
    monkeypatch.setattr(lm_scoring.Lexicon, "__init__", lambda self, *args: start(self, *args, room=room))
    counts = lm_scoring.subword_counts(lm_scoring.word_counts(docs), file)
    symbols, subwords, frequent = Symbols.of(counts, len(rows)), Subwords(file), {"b": 5, "the": 9, "la": 4}
    sent = {"broadcast": lambda value: type("Sent", (), {"value": value})}
    got = {}
    monkeypatch.setattr(lm_scoring, "map_texts", lambda df, carry, text, fields, start, rows: got.update(start=start))
    frame = type("Frame", (), {"sparkSession": type("S", (), {"sparkContext": type("C", (), {k: staticmethod(f) for k, f in sent.items()})})})
    lm_scoring.prepared(frame, "text", [], file, symbols, frequent, float)
    work = got["start"]()
    columns = []
    for at in range(0, len(rows), 40):
        made = [list(c.to_pylist() if hasattr(c, "to_pylist") else c) for c in work([t or "" for _, t in rows[at : at + 40]])]
        columns = [a + b for a, b in zip(columns, made)] if columns else made
    for (_, text), n_words, n_frequent, total, raw, rest, names, times in zip(rows, *columns):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        ids = [i for w in words for i in subwords.of(w)]
        assert (n_words, n_frequent, total) == (len(words), sum(w in frequent for w in words), sum(frequent.get(w, 0) for w in words))
        assert lm_scoring.symbols_of(raw).tolist() == [*(symbols.number.get(i, lm_scoring.OTHER) for i in ids), lm_scoring.END]
        assert rest == pytest.approx(sum(symbols.rest[i] for i in ids if i not in symbols.number), abs=1e-9)
        assert dict(zip(names, times)) == Counter(w for w in words if w not in frequent) and len(names) == len(set(names))


def test_words_are_split_by_arrays_as_the_contract_says():
    texts = ["A\tb  C\x0b", None, "", " \n ", "Ä\x1cÉ b\x85c d\xa0e　F", "\x0cx\x0d\x0ay"]
    counts, words = lm_scoring.split_words(pa.array(["left out", *texts]).slice(1))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert counts.tolist() == list(map(len, expected)) and words.to_pylist() == [w for ws in expected for w in ws]


def test_tasks_do_not_encode_frequent_words_again(monkeypatch):
    subwords, asked = Subwords(open(PATH, "rb").read()), []
    symbols = Symbols.of(np.arange(subwords.size), 3)
    frequent = {"the": 9, "b": 5}
    entries = lm_scoring.Entries.end().with_words(list(frequent), np.array([9.0, 5.0]), subwords, symbols)
    lexicon = lm_scoring.Lexicon(subwords, symbols, {"": 0, "the": 1, "b": 2}, entries, room=4)
    monkeypatch.setattr(subwords, "of_all", lambda words, f=subwords.of_all: asked.append(words) or f(words))
    assert lexicon.numbers(["b", "zz", "the", "b", "yy"]).tolist() == [2, 3, 1, 2, 4] and asked == [["zz", "yy"]]
    assert np.isnan(lexicon.entries.bases[3:]).all() and lexicon.entries.bases[1:3].tolist() == [9, 5] and lexicon.names == ["zz", "yy"]
    assert lexicon.numbers(["xx", "b"]).tolist() == [3, 2] and lexicon.names == ["xx"]  # emptied down to the frequent words


def test_a_step_keeps_the_parameters_within_those_of_the_plain_rule():
    rng, p = np.random.default_rng(8), model()
    adam, x = attention.Adam(p), p.flat().astype(float)
    m, s = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, 6):
        seen, wanted, _ = blocks([rng.integers(0, SIDE * SIDE, 40)], 0)
        _, g = gradient(Parameters.of(x), seen, wanted)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g.astype(float) ** 2
        x -= 0.01 * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        adam.step(seen, wanted, 0.01)
    assert np.quantile(np.abs(adam.x - x), 0.99) < 1e-4
