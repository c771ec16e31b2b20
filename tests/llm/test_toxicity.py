import itertools
import random
import time
import zlib

import numpy as np
import pytest

from campanile.llm import toxicity
from campanile.llm.common import held_out
from campanile.llm.toxicity import DECAY, Machine, apply_tables, cover, norms, score, spelled, stretches, table_of, train


def kernel(a, b):
    """The gap-weighted subsequence kernel by its definition."""
    features = []
    for w in (a, b):
        own = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            u = (w[i], w[j], w[k])
            own[u] = own.get(u, 0) + DECAY ** (k - i + 1)
        features.append(own)
    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    return dot(*features) / (dot(features[0], features[0]) * dot(features[1], features[1])) ** 0.5


def test_kernel_and_norm_match_the_definition():
    words = [stretches(w)[0] for w in ("idiot", "id-iot", "idxiot", "banana", "aaaa", "ab")]
    tables = np.array([table_of([w], np.ones(1)) for w in words])
    found = apply_tables(words, tables)
    for i, a in enumerate(words):
        assert norms(np.array([a]))[0] > 0
        for j, b in enumerate(words):
            assert found[i, j] == pytest.approx(kernel(a, b))
    assert words[0] == words[1] and found[0, 2] > 0.4 > found[0, 3]


def test_folded_table_is_the_sum_over_landmarks():
    marks = [stretches(w)[0] for w in ("moron", "stupid", "kind")]
    weights = np.array([1.5, -0.5, 0.25])
    machine = Machine(table_of(marks, weights), 0.1)
    word = "stuxpid"
    assert machine.margins([word])[0] == pytest.approx(0.1 + sum(w * kernel(stretches(word)[0], m) for w, m in zip(weights, marks)))
    assert machine.margins(["", "?!", "x"]).tolist() == [-2.0] * 3
    assert machine.margins(["a" * 100 + "stupid" + "b" * 100]).shape == (1,)


def test_spelled_and_cover():
    assert spelled("you i d i o t and i.d.i.o.t, a b") == ["idiot"]
    assert cover([{"a", "b"}, {"a"}, {"c"}, {"b", "c"}, {"d"}]) == {"c": 2, "a": 2}


@pytest.fixture(scope="module")
def synthetic(spark):
    rng = random.Random(3)
    syllables = ["the", "on", "er", "an", "ing", "tion", "ha", "re", "st", "ea"]
    docs, labels = [], []
    for i in range(900):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            bad = rng.choice(["idiot", "moron", "stupid"])
            if i % 5 == 0:
                bad = bad[:3] + rng.choice("xyz") + bad[3:]
            words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_with_inserted_letters(spark, synthetic):
    docs, labels, truth = synthetic
    model = train(docs, labels, usable=~held_out("doc_id", 0))
    rows = [r for r in score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    wrong = sum(r.predicted != truth[r.doc_id] for r in rows)
    assert wrong <= 0.05 * len(rows)
    extra = spark.createDataFrame([(1, "the hation i d i o t reer", 9), (2, "the hation s.t.u.p.i.d reer", 9), (3, None, 9), (4, "", 9), (None, "the hation reer", 9)], "doc_id long, text string, score int")
    got = {r.doc_id: r.predicted for r in score(extra, model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, None: 0}


def test_held_out_labels_change_nothing(spark, synthetic):
    from pyspark.sql import functions as F

    docs, labels, _ = synthetic
    turned = labels.withColumn("toxic", F.when(held_out("doc_id", 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    models = [train(docs, x, usable=~held_out("doc_id", 0)) for x in (labels, turned)]
    assert np.allclose(models[0].machine.table, models[1].machine.table) and models[0].slope == models[1].slope


def test_no_labels_and_no_rows(spark, synthetic):
    docs, labels, _ = synthetic
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        model = train(docs, some, usable=~held_out("doc_id", 0))
        assert {r.predicted for r in score(docs.limit(20), model).collect()} <= {0, 1}
    assert score(docs.limit(0), model).count() == 0


def test_sample_bound(spark, synthetic, monkeypatch):
    docs, labels, _ = synthetic
    seen = []
    monkeypatch.setattr(toxicity, "platt", lambda m, y: (seen.append(len(y)) or 1.0, 0.0))
    train(docs, labels, usable=~held_out("doc_id", 0), most=50)
    assert seen == [50]


@pytest.mark.parametrize("sign", ["_", " ", ".", "-", "*", "a ", "a.", "a_", "_a"])
def test_long_runs_of_signs_are_read_in_time(sign):
    begin = time.monotonic()
    toxicity.spelled("x " + sign * 100_000 + "!")
    assert time.monotonic() - begin < 2


def test_letters_spelled_out_make_a_word():
    assert toxicity.spelled("such an i d-i_o.t here") == ["idiot"]
    assert toxicity.spelled("Signature ____________________________________________________________!") == []
