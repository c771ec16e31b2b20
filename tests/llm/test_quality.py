import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campanile.llm.quality import BASE, RULES, Document, Rule, cascade, ordered_rules

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #\n\t\x1c\x85 <é", max_size=80))
def test_features_match_the_plain_definitions(text):
    assert tuple(getattr(Document(text), m) for m in METRICS) == plain(text)


def test_whole_table_and_kept_share(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in cascade(docs, metrics=METRICS).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][m] for m in METRICS) == plain(r.text or "")
        assert got[r.doc_id].kept == (not any(rule.fails(Document(r.text or "")) for rule in RULES))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in got and got[i].failed_rule not in {x.name for x in BASE}]
    assert all(got[i].kept for i in good) and not any(got[i].kept for i, q in labels.items() if q == 0 and i in got)


def test_order_is_rejection_per_cost_and_leaves_the_verdict(spark):
    def slow(d):
        return sum(range(20_000)) < 0 or "x" in d.text

    rules = [Rule("slow", slow), Rule("never", lambda d: False), Rule("quick", lambda d: "x" in d.text)]
    df = spark.range(200).withColumn("text", F.when(F.col("id") % 2 == 0, F.lit("x")).otherwise(F.lit("y")))
    assert [r.name for r in ordered_rules(df, rules)] == ["quick", "slow", "never"]
    out = cascade(df, rules, carry=["id"])
    assert {(r.kept, r.failed_rule, r.rules_tried) for r in out.collect()} == {(False, "quick", 1), (True, None, 3)}


def test_nulls_repeats_clashes_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "", "b")], "doc_id long, text string, kept string")
    out = cascade(df, metrics=["n_words"]).collect()
    assert [(r.n_words, r.kept, r.failed_rule) for r in out] == [(0, False, "few_words")] * 3
    assert cascade(df.limit(0)).count() == 0
