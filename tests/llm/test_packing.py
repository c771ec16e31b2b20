import itertools
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from campanile.llm import packing
from campanile.llm.packing import Encoder, fullest, pack, pack_documents, plan

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(open(PATH).read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="aB'st \n\t\x1c\x85\xa0éİſŉ1²¼!.<|endoftext|>é", max_size=60))
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 25))
def test_fullest_is_optimal(counts, capacity):
    chosen = fullest(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in chosen.items())
    sums = [sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))]
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 10**12), max_size=12))
def test_plan_uses_every_piece_once(counts):
    made = plan(counts, 40)
    used = {}
    for filling, times in made:
        assert sum(k * n for k, n in filling.items()) <= 40
        for k, n in filling.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    assert len(made) <= sum(40 // k for k in range(1, 41))


def verify(rows, texts):
    """Sequences have no gap and no overlap, and every document's ids lie in exactly one piece."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert documents.keys() == texts.keys()
    for i, own in documents.items():
        ids = np.array([*LIBRARY.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    return len(sequences) * 2048 - total, total


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    padding, total = verify(pack_documents(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding <= 0.02 * total  # 88 sequences only; the slack is in the last few


def test_hot_lengths_are_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_SHARE", 3)
    df = spark.createDataFrame([(i // 2, 0, 1000 if i % 3 else i + 1, 0) for i in range(200)], "doc_id long, start long, length long, ids_crc32 long")
    rows = pack(df).collect()
    assert len(rows) == 200 and len({(r.sequence_id, r.offset) for r in rows}) == 200


def test_nulls_repeats_clashes_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "a b", "x"), (1, "a b", "x"), (2, "", "x")], "doc_id long, text string, length string")
    rows = pack_documents(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 3), ("1", 3), ("2", 1), ("None", 1)]
    assert sorted(r.offset for r in rows) == [0, 3, 6, 7] and {r.sequence_id for r in rows} == {0}
    assert pack_documents(df.limit(0), PATH).count() == 0
