"""Properties of random, model-based and file-backed operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from campanile.operators import groups as G
from campanile.operators import models as M
from campanile.operators import neighbours as B
from campanile.plans import models as bound
from campanile.plans.registry import Tables
from campanile.sources import files as S
from campanile.sources import snapshots as E


@pytest.fixture()
def t(spark, folder):
    return Tables(spark, folder)


def test_latin_hypercube_hits_each_stratum_once(spark, blocks, t):
    n = t.part.count()
    points = G.latin_hypercube(t.part, "p_partkey", {"a": (0.0, 1.0), "b": (5.0, 7.0)}, seed=3).toPandas()
    for col, low, high in (("a", 0, 1), ("b", 5, 7)):
        strata = np.floor((points[col] - low) / (high - low) * n).astype(int)
        assert sorted(strata) == list(range(n))


def test_group_folds_keep_groups_whole(spark, blocks, t):
    rows = t.lineitem.select("l_suppkey", "l_returnflag", "l_orderkey")
    folds = G.group_folds(rows, "l_suppkey", "l_returnflag", 3)
    assert folds.groupBy("l_suppkey").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert folds.count() == rows.count()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) < 2.5 * min(sizes)


def test_group_folds_of_small_groups(spark, blocks, t):
    rows = t.orders.select("o_custkey", "o_orderstatus").withColumn("o_custkey", F.monotonically_increasing_id())
    sizes = [r["count"] for r in G.group_folds(rows, "o_custkey", "o_orderstatus", 4).groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2


def test_group_folds_balance_classes_and_large_groups(spark, blocks):
    """Groups from one row to a third of the table, one rule for all."""
    sizes = [4000, 1500, 1400, 1300, *[60 + i % 40 for i in range(60)], *[1 + i % 5 for i in range(600)]]
    groups = spark.createDataFrame([(g, n) for g, n in enumerate(sizes)], "g long, n int")
    rows = groups.select("g", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("c", (F.xxhash64("g", "i") % 3 == 0).cast("int"))
    folds = G.group_folds(rows, "g", "c", 4, seed=2)
    assert folds.count() == sum(sizes) and folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    counts = {(r.fold, r.c): r.n for r in folds.groupBy("fold", "c").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the largest group fills a fold nearly alone, the others share the rest
    for c in (0, 1):
        by_fold = sorted(counts.get((f, c), 0) for f in range(4))
        assert by_fold[2] <= 1.1 * by_fold[0]


def test_stratified_folds_are_even(spark, blocks, t):
    folds = G.stratified_folds(t.orders, "o_orderstatus", "o_orderkey", 5)
    for r in folds.groupBy("o_orderstatus").pivot("fold", list(range(5))).count().collect():
        assert max(r[1:]) - min(r[1:]) <= 1


def test_bootstrap_mean_is_near_one(t):
    row = G.bootstrap_weights(t.lineitem.select(F.xxhash64(*t.lineitem.columns).alias("k")), "k", 3).agg(*[F.avg(f"boot_{m}") for m in range(3)]).first()
    assert all(abs(v - 1) < 0.05 for v in row)


def brute(vectors, k):
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [list(np.argsort(row, kind="stable")[:k]) for row in d], d


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    # a third of the rows are copies of one point; the rest lie in far clusters
    points = np.concatenate([np.zeros((60, 3)), *[rng.normal(c, 1, (30, 3)) for c in (0, 20, 50, 90)]])
    y = rng.integers(0, 10, len(points)).astype(float)
    return points, y, spark.createDataFrame([(i, p.tolist(), float(v)) for i, (p, v) in enumerate(zip(points, y))], "id long, v array<double>, y double")


@pytest.mark.parametrize("rows", [16, 4096])
def test_neighbours_by_tiles_equal_brute_force(cloud, rows):
    points, _, df = cloud
    want, _ = brute(points, 4)
    got: dict = {}
    for r in B.nearest_neighbours(df, "id", "v", 4, rows_per_block=rows, pivots=8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert [got[i] for i in range(len(points))] == want


def test_rows_meet_few_other_blocks(spark, monkeypatch):
    """On rows in clusters, a row is sent to few blocks, and to no more of them in a table eight times as large."""
    copies = {}
    real = B._asks

    def spy(inside, centres, rings, kind):
        out = real(inside, centres, rings, kind)
        copies[inside.count()] = out.agg(F.avg(F.size("blocks"))).first()[0]
        return out

    monkeypatch.setattr(B, "_asks", spy)
    rng = np.random.default_rng(3)
    for n in (500, 4000):
        centres = rng.normal(0, 50, (n // 50, 3))
        points = np.concatenate([rng.normal(c, 1, (50, 3)) for c in centres])
        df = spark.createDataFrame([(f"r{i:05d}", p.tolist()) for i, p in enumerate(points)], "id string, v array<double>")
        got: dict = {}
        for r in B.nearest_neighbours(df, "id", "v", 3, rows_per_block=64).collect():
            got.setdefault(int(r["id"][1:]), []).append((r["rank"], int(r["neighbour"][1:])))
        sample = rng.choice(n, 60, replace=False)
        d = np.sqrt(((points[sample][:, None] - points[None]) ** 2).sum(2))
        d[np.arange(60), sample] = np.inf
        assert [[j for _, j in sorted(got[i])] for i in sample] == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()
    small, large = copies[500], copies[4000]
    assert large < 3 * max(1.0, small) and large < 8


@pytest.mark.parametrize("rows", [50, 4096])
def test_semivariogram_by_tiles_equals_brute_force(cloud, blocks, rows):
    points, y, df = cloud
    i, j = np.triu_indices(len(points), 1)
    d, dy = np.sqrt(((points[i] - points[j]) ** 2).sum(1)), np.abs(y[i] - y[j])
    at = np.digitize(d, np.percentile(d, np.linspace(0, 100, 6)))
    want = {b: ((at == b).sum(), np.median(d[at == b]), (dy[at == b] ** 2).mean() / 2) for b in range(1, 6) if (at == b).sum() >= 3}
    got = {r["bin"]: (r["n"], r["median_distance"], r["semivariance"]) for r in B.semivariogram(df, "id", "v", "y", 5, rows_per_block=rows).collect()}
    assert set(got) == set(want)
    for b in want:
        assert got[b] == pytest.approx(want[b])


@pytest.mark.parametrize("kind", ["labels", "few copies", "any y", "far off", "one point"])
@pytest.mark.parametrize("same", [True, False])
def test_tiles_of_pairs_equal_brute_force(kind, same):
    """Slots from products and values of the second pass are those of plain differences, with copies and near copies too."""
    rng = np.random.default_rng(9)
    x, z = rng.normal(0, 1, (700, 8)), rng.normal(0, 1, (1100, 8))
    x[200:400], z[100:300] = x[0], x[0] + rng.normal(0, 1e-7, (200, 8))
    if kind == "far off":
        x, z = x + 1e6, z + 1e6
    if kind == "one point":
        x[:], z[:] = x[0], x[0]
    z = x if same else z
    y = lambda n: np.sort(rng.normal(0, 2, n) if kind == "any y" else rng.integers(0, 700 if kind == "few copies" else 3, n).astype(float))
    yp = y(len(x))
    yz = yp if same else y(len(z))
    i, j = np.triu_indices(len(x), 1) if same else np.divmod(np.arange(len(x) * len(z)), len(z))
    d = B._between(x, z, i, j)
    width = max(2 * np.sqrt(((np.concatenate([x, z]) - x[0]) ** 2).sum(1)).max(), 1e-12) * (1 + 1e-9) / B.HISTOGRAM
    slot, s2 = (d / width).astype(int), (yp[i] - yz[j]) ** 2
    got = B._count_slots(x, yp, z, yz, same, x[0], width)
    assert (got[0] == np.bincount(slot, minlength=len(got[0]))).all()
    assert got[1] == pytest.approx(np.bincount(slot, weights=s2, minlength=len(got[1])))
    wanted = np.zeros(B.HISTOGRAM + 2, dtype=bool)
    wanted[np.unique(slot)[::7]] = True
    told = B._slot_values(x, yp, z, yz, same, x[0], width, wanted)
    values, n = np.unique(d[wanted[slot]], return_counts=True)
    assert (told["value"].to_numpy() == values).all() and (told["n"].to_numpy() == n).all()
    assert told["s2"].sum() == pytest.approx(s2[wanted[slot]].sum())


def test_verdict_of_pairs_looks_at_edges_only_and_deals_tiles_out(spark, cloud, monkeypatch):
    points, y, df = cloud
    looked, parts = [], []
    real, over = B.PairDistances.refine, B._over_pairs

    def refine(self, spans):
        real(self, spans)
        looked.append(int(self.looked_at.sum()))

    def spy(*args):
        out = over(*args)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(B.PairDistances, "refine", refine)
    monkeypatch.setattr(B, "_over_pairs", spy)
    with_medians = B.sill_verdict(B.semivariogram(df, "id", "v", "y", 5, rows_per_block=25)).collect()
    without = B.sill_verdict(B.semivariogram(df, "id", "v", "y", 5, rows_per_block=25, medians=False)).collect()
    assert with_medians == without and looked[1] < looked[0]
    blocks = -(-len(points) // 25)
    # one part a tile, however few shuffle partitions there are
    assert set(parts) == {blocks * (blocks + 1) // 2} and parts[0] > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_oversampling_reaches_targets_between_neighbours(cloud, blocks):
    _, _, df = cloud
    rows = df.withColumn("cls", (F.col("id") % 5 == 0).cast("int"))
    n = {r[0]: r[1] for r in rows.groupBy("cls").count().collect()}
    out = M.oversample(rows, "id", "v", "cls", {1: n[0]})
    assert {r[0]: r[1] for r in out.groupBy("cls").count().collect()} == {0: n[0], 1: n[0]}
    assert out.select("row").distinct().count() == 2 * n[0]


def test_ordinal_probabilities_sum_to_one(t):
    out = bound.small_forest(bound.rows(t)).transform(bound.rows(t)).select("class_probability", "prediction").collect()
    assert all(sum(r[0]) == pytest.approx(1) and r[1] in (0, 1, 2) for r in out)


def test_out_of_fold_covers_every_row_once(t):
    out = M.out_of_fold(bound.rows(t), "fold", 3, bound.small_forest)
    assert out.count() == out.select("vec_id").distinct().count() == t.embeddings.count()


def test_stream_equals_batch(spark, folder):
    queries = entry.queries()
    by = lambda rows, key: sorted((r[key], r["length"], r["successes"], r["failures"], r["best"], r["n_updates"]) for r in rows)
    stream = queries["x2_streaming_region"](spark, folder).collect()
    batch = queries["c7_trust_region"](spark, folder).collect()
    assert by(stream, "campaign") == by(batch, "o_custkey")


def test_row_order_does_not_matter(spark, blocks, t):
    from campanile.operators import campaigns as C
    from campanile.plans import campaigns as P

    base = P.scored(t)
    shuffled = base.repartition(7, F.rand(3))
    assert C.curves(base, ["method", "seed"], 7).exceptAll(C.curves(shuffled, ["method", "seed"], 7)).count() == 0


def test_concurrent_commit_fails(spark, t):
    table = E.SnapshotTable(spark, S.scratch(spark, "race"))
    table.commit(t.nation)
    stale = table.version()
    table.commit(t.nation, expected=stale)
    with pytest.raises(E.ConcurrentEdit):
        table.commit(t.nation, expected=stale)
    assert table.versions() == [1, 2] and table.backups() == [1]


def test_refused_writer_leaves_the_published_version(spark, t):
    """Both writers pass the version check before either publishes."""
    folder = S.scratch(spark, "race")
    first = E.SnapshotTable(spark, folder)
    first.commit(t.nation)

    class Late(E.SnapshotTable):
        def version(self):
            return 1

    late = Late(spark, folder)
    first.commit(t.nation.limit(5), expected=1)
    with pytest.raises(E.ConcurrentEdit):
        late.commit(t.nation.limit(9), expected=1)
    assert first.read(2).count() == 5 and first.version() == 2


def test_a_writer_that_stops_half_way_loses_nothing(spark, t):
    """It stops before, while and after its pointer is written, but before it is published."""
    table = E.SnapshotTable(spark, S.scratch(spark, "crash"))
    table.commit(t.nation)

    class Stopped(E.SnapshotTable):
        def _publish(self, pending, final):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Stopped(spark, table.folder).commit(t.nation.limit(1), append=True)
    table._fs.create(table._path(f"{table.folder}/commits/pending-half"), False).close()
    assert table.versions() == [1] and table.read().count() == 25
    table.commit(t.nation.limit(2), append=True)
    assert table.version() == 2 and table.read().count() == 27
    # an empty pointer under a number, as writers of another kind may leave it, is refused and never built upon
    table._fs.create(table._path(f"{table.folder}/commits/3"), False).close()
    for act in (table.read, lambda: table.commit(t.nation, append=True)):
        with pytest.raises(ValueError):
            act()
    assert table.read(2).count() == 27


def test_append_keeps_the_folders_before(spark, t):
    table = E.SnapshotTable(spark, S.scratch(spark, "append"))
    table.commit(t.nation)
    table.commit(t.nation.limit(3).withColumn("more", F.lit(1)), append=True)
    assert table.folders(2)[:1] == table.folders(1) and len(table.folders(2)) == 2
    assert table.read().count() == t.nation.count() + 3 and table.read().filter("more = 1").count() == 3


def test_identity_guard(spark, t):
    with pytest.raises(E.ConcurrentEdit):
        E.check_identity(t.nation, "n_nationkey", t.nation.select((F.col("n_nationkey") + 1).alias("n_nationkey")))


def test_cache_rebuilds_on_new_version_only(spark, t, folder):
    place, calls = S.scratch(spark, "cache"), []

    def build():
        calls.append(1)
        return t.nation

    for version in ("v1", "v1", "v2"):
        S.DerivedCache(spark, place, version).get(f"{folder}/nation.parquet", build)
    assert len(calls) == 2


def test_memo_computes_new_keys_only(spark, t):
    place, seen = S.scratch(spark, "memo"), []

    def compute(keys):
        seen.append(sorted(r[0] for r in keys.collect()))
        return keys.withColumn("value", F.length("key").cast("bigint"))

    rows = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "k string")
    more = rows.unionByName(spark.createDataFrame([("ccc",)], "k string"))
    E.Memo(spark, place, "n_v1", "bigint").attach(rows, "k", compute).count()
    out = E.Memo(spark, place, "n_v1", "bigint").attach(more, "k", compute)
    assert seen == [["a", "bb"], ["ccc"]]
    assert sorted((r["k"] or "", r["value"]) for r in out.collect()) == [("", None), ("a", 1), ("a", 1), ("bb", 2), ("ccc", 3)]
