import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from campanile.llm.token_counts import Counter, count_tokens

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = Counter(open(PATH).read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="ab  \n\t'sßé<|endoftext|>1", max_size=80))
def test_any_text_counts_as_in_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", "a" * 5000, "the" * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", " " * 999, "<|endoftext", "你好" * 400])
def test_edge_texts(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in texts:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        assert (rows[r.doc_id].n_tokens, rows[r.doc_id].n_bytes, rows[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 512)


def test_nulls_repeats_clashes_and_no_rows(spark):
    rows = [(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens) for r in count_tokens(df, PATH).collect()), key=str)
    assert got == [(1, 2), (1, 2), (2, 0), (None, 0)]
    assert count_tokens(df.limit(0), PATH).count() == 0
    assert count_tokens(df, PATH, carry=("doc_id", "n_tokens")).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
