"""Steps whose cost must follow the input: shared stream state, few blocks for vectors without structure, folded joins, bounded tasks, rows read once."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campanile.operators import neighbours as B
from campanile.operators.groups import held_out_groups, leave_group_out, split_sizes
from campanile.plans import tokens
from campanile.plans.registry import Tables
from campanile.sources import files
from campanile.streaming import region


def machine(scores, length=0.8, s=0, f=0, best=float("-inf")):
    for x in scores:
        s, f, best = (s + 1, 0, x) if x > best + 1e-6 else (0, f + 1, best)
        if s >= 3:
            length, s = min(length * 2, 1.6), 0
        if f >= 3:
            length, f = (length / 2 if length / 2 >= 0.1 else 0.8), 0
    return length, s, f, best, len(scores)


def test_campaigns_of_neighbouring_numbers_share_a_state_row(spark, tmp_path):
    rng = np.random.default_rng(5)
    scores = {c: rng.integers(0, 9, 12).astype(float).tolist() for c in [-3, *range(250), 10**12]}
    schema = "campaign long, step long, score double"
    for k in range(2):
        rows = [(c, i, x) for c, xs in scores.items() for i, x in enumerate(xs) if (i >= 7) == (k == 1) and (k == 0 or c % 2 == 0)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        stream = region.region_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.filter("batch = 1").count() == len([c for c in scores if c % 2 == 0])
    last = out.groupBy("campaign").agg(F.max_by(F.struct("length", "successes", "failures", "best", "n_updates"), "batch").alias("s")).collect()
    assert {r.campaign: tuple(r.s) for r in last} == {c: machine(xs if c % 2 == 0 else xs[:7]) for c, xs in scores.items()}
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 4


def test_vectors_without_structure_meet_a_bounded_number_of_blocks(spark, monkeypatch):
    """Whatever the rows and groups, an eighth of a group's rows fill a block of four cells, and no neighbour is lost."""
    monkeypatch.setattr(B, "LEAST_ROWS", 16)
    asked = []
    real = B._asks
    monkeypatch.setattr(B, "_asks", lambda *a: asked.append(real(*a)) or asked[-1])
    points = np.random.default_rng(1).normal(0, 1, (2000, 16))
    group = np.arange(2000) % 5
    df = spark.createDataFrame([(i, p.tolist(), int(g)) for i, (p, g) in enumerate(zip(points, group))], "id long, v array<double>, g int")
    got: dict = {}
    for r in B.nearest_neighbours(df, "id", "v", 3, within="g", groups=range(5)).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    d[group[:, None] != group[None, :]] = np.inf
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert all([got[i][k] for k in (1, 2, 3)] == want[i].tolist() for i in range(2000))
    assert asked[0].agg(F.max(F.size("blocks"))).first()[0] <= 48


def test_sizes_of_splits_from_folded_rows(spark):
    rows = spark.createDataFrame([("a",)] * 30 + [("b",)] * 25 + [("c",)] * 5 + [(None,)] * 2, "g string")
    folded = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    told = split_sizes(leave_group_out(folded, "g", held_out_groups(rows, "g").filter("g is not null")), "g", "m")
    assert {(r.held, r.role): r.n for r in told.collect()} == {("a", "pool"): 30, ("a", "init"): 32, ("b", "pool"): 25, ("b", "init"): 37}


def test_parts_of_token_counts_follow_the_texts(spark, folder, monkeypatch):
    t = Tables(spark, folder)
    chars = t.documents.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(tokens, "CHARS_PER_TASK", chars // 20)
    assert tokens.doc_tokens(t).rdd.getNumPartitions() >= 20


def test_the_template_reads_the_documents_no_more(spark, folder):
    out = entry.queries()["c6_neighbourhood_template"](spark, folder)
    assert "documents" not in out._jdf.queryExecution().toString()


def test_profile_files_are_few_and_read_as_single_ones(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda spark, name: str(tmp_path / "s3"))
    rows = entry.queries()["s3_profile_files"](spark, folder)
    assert rows.count() == 500 and len(list((tmp_path / "s3").rglob("*.txt"))) < 50
    # padded names win, also with other content; a file of another length or with a bad line counts for nothing
    made = {"p_07": ["0 1", " 1\t 2 "], "p_7": ["0 8", "1 9"], "p_8": ["0 3"], "p_9": ["0 1", "1 x"], "p_10": ["1 5", "0 4"], "p_11": ["0 1", "1 1", "2 1"], "p_012": ["0 1"], "p_12": ["0 6", "1 7"], "q": ["0 1", "1 2"]}
    (tmp_path / "single").mkdir()
    for name, lines in made.items():
        (tmp_path / "single" / f"{name}.txt").write_text("\n".join(lines) + "\n")
    files.write_profiles(spark.createDataFrame([(f"{n}.txt", x) for n, xs in made.items() for x in xs], "name string, value string").repartition(3), str(tmp_path / "bundled"))
    single, bundled = (sorted(map(tuple, files.read_profiles(spark, str(tmp_path / kind), r"p_(\d+)\.txt", 2, kind == "bundled").collect())) for kind in ("single", "bundled"))
    assert single == bundled == [(7, [0.0, 1.0], [1.0, 2.0]), (10, [0.0, 1.0], [4.0, 5.0]), (12, [0.0, 1.0], [6.0, 7.0])]
