import pytest
from test_dart_minhash import classes
from test_line_frequency import brute
from test_packing import verify

import corpus_pipeline
from campanile.llm.quality import RULES, Document


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Rows before and after each stage."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        found.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return found


def test_stages_and_columns(steps):
    assert [s[0] for s in steps] == ["toxicity", "quality_rules", "line_dedup", "near_duplicates", "packing"]
    assert all(s[3] == corpus_pipeline.COLUMNS for s in steps[:-1])


def test_toxicity_keeps_clean_documents(spark, steps, folder):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    _, before, after, _ = steps[0]
    kept = {r.doc_id for r in after}
    assert set(after) <= set(before)
    clean = [r.doc_id for r in before if truth.get(r.doc_id) == 0]
    toxic = [r.doc_id for r in before if truth.get(r.doc_id) == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i not in kept for i in toxic) >= 0.8 * len(toxic)


def test_quality_matches_the_rules(steps):
    _, before, after, _ = steps[1]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not any(rule.fails(Document(r.text or "")) for rule in RULES))


def test_lines_match_brute_force(steps):
    _, before, after, _ = steps[2]
    assert sorted((r.source, r.text) for r in after) == brute([(r.source, r.text) for r in before])
    assert all(r.n_chars == len(r.text) for r in after) and len(after) == len(before)


def test_near_copies_match_brute_force(steps):
    _, before, after, _ = steps[3]
    before = sorted(before, key=lambda r: r.doc_id)
    found = classes([r.text for r in before])
    assert sorted(r.doc_id for r in after) == sorted(before[i].doc_id for i in set(found))
    assert set(after) <= set(before)


def test_packing_is_complete(steps):
    _, before, after, _ = steps[4]
    padding, total = verify(after, {r.doc_id: r.text for r in before})
    assert padding <= 0.03 * total


def test_nulls_repeats_extra_columns_and_no_rows(spark, folder):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "s", 5, "x"), (1, words, "en", "s", 5, "x"), (None, words, None, None, None, None), (2, None, "en", None, 3, "y"), (3, "", None, "s", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    counts = []
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, folder)
            counts.append(some.count())
    assert counts == [5, 3, 3, 1, 1, 0, 0, 0, 0, 0]


def test_run_and_registration(spark, folder):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, folder).count() > 0
