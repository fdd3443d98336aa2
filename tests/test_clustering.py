import hashlib
import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statweave.operators.clustering import blocks, canopy, common, dirichlet, kmeans, proclus, validation
from statweave.plans import queries
from statweave.plans.jobs import run_job

SIX = [(0.1, 0.1), (0.2, 0.2), (0.3, 0.3), (50.1, 50.1), (50.2, 50.2), (50.3, 50.3)]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, "x double, y double").coalesce(1)


def blobs(spark, centers, n=60, scale=0.5, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, (c + scale * rng.standard_normal(len(c))).tolist()) for k, c in enumerate(np.array(centers, float)) for _ in range(n)]
    return spark.createDataFrame(rows, "blob int, point array<double>")


def sizes(df):
    return sorted(r["count"] for r in df.groupBy("cluster").count().collect())


def test_canopy_then_kmeans(spark, six):
    c = run_job(spark, "canopy", table=six, t1=0.6, t2=0.4)
    assert c.output("clusters").count() == 2 and sizes(c.output("clustered-points")) == [3, 3]
    k = run_job(spark, "kmeans", table=six, input_clusters=c, convergence_delta=0.1, num_iterations=10)
    assert sizes(k.output("clustered-points")) == [3, 3]
    centers = sorted(r["center"][0] for r in k.output("clusters").collect())
    assert centers == pytest.approx([0.2, 50.2])
    assert sorted(r["radius"][0] for r in k.output("clusters").collect()) == pytest.approx([np.std([0.1, 0.2, 0.3])] * 2)
    db = run_job(spark, "davies-bouldin-index", clustering_job=k).output().first()[0]
    s, m = np.sqrt(np.mean([0.04, 0, 0.04])), np.sqrt(2) * 50
    assert db == pytest.approx(2 * s / m)
    assert sorted(k.visualize(columns=["x", "y"])) == [("x", "y")]


def test_kmeans_query_starts_from_all_canopies(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(16) * 5, 8, 0) + rng.normal(0, 0.01, (128, 16))  # 16 groups far apart
    rows = [(i, i // 8, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    made, seeds = [], []
    all_canopies, from_seeds = queries.canopy.canopy, queries.kmeans.kmeans
    monkeypatch.setattr(queries.canopy, "canopy", lambda *a, **k: made.append(all_canopies(*a, **k)) or made[-1])
    monkeypatch.setattr(queries.kmeans, "kmeans", lambda points, initial, *a: seeds.append(initial) or from_seeds(points, initial, *a))
    out = queries.kmeans_clusters(spark, str(tmp_path)).collect()
    assert len(made[0][0]) == len(seeds[0]) == 16
    assert len({r["cluster"] for r in out}) == 16 == len({(r["label"], r["cluster"]) for r in out})


def test_canopies_visit_points_in_order():
    x = np.array([[0.0], [1.0], [2.0], [9.0]])
    centers, counts = canopy.canopies(x, 1.5, 1.5)
    assert counts.tolist() == [2, 1, 1] and centers.ravel().tolist() == [0.5, 2.0, 9.0]
    centers, counts = canopy.canopies(x, 2.5, 1.5)
    assert counts.tolist() == [3, 1, 1]


def many(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(0, 30, (n, 2)), 3)
    x[100:400] = x[7]  # copies
    return x, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, point array<double>")


def plain_canopies(x, t1, t2):
    """One point after another, in the order by md5 of the components in units of 2**-20."""
    key = lambda p: (hashlib.md5(",".join(str(math.floor(v * 1048576)) for v in p).encode()).hexdigest(), tuple(p))
    found = []
    for p in sorted(x.tolist(), key=key):
        near = [math.dist(p, f) for f, _ in found]
        for d, (_, members) in zip(near, found, strict=True):
            if d < t1:
                members.append(p)
        if all(d >= t2 for d in near):
            found.append((p, [p]))
    return [np.mean(m, 0) for _, m in found]


@pytest.mark.parametrize("batch", [16, 8192])
def test_canopies_are_those_of_the_data(spark, batch):
    x, df = many(spark)
    expected = plain_canopies(x, 3.0, 2.0)
    for parts in (1, 2, 211):
        found, clustered = canopy.canopy(df.repartition(parts), 3.0, 2.0, batch=batch)
        assert np.allclose([c.center for c in found], expected, atol=1e-9)
        own = ((x[:, None] - np.array(expected)[None]) ** 2).sum(2).argmin(1)
        assert {r.id: r.cluster for r in clustered.collect()} == dict(enumerate(own.tolist()))
        assert [c.n for c in found] == np.bincount(own, minlength=len(expected)).tolist()
        if batch == 16:
            break


def test_more_canopies_than_a_model_may_have(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_CLUSTERS", 50)
    x, df = many(spark, 900)
    made, clustered = canopy.canopy_frames(df, 0.03, 0.02, batch=128)
    rows = made.collect()
    assert len(rows) == len(plain_canopies(x, 0.03, 0.02)) > 500 and sum(r.n for r in rows) == 900 == clustered.count()
    with pytest.raises(ValueError):
        canopy.canopy(df, 0.03, 0.02)
    bad = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1.0, 2.0])], "id long, point array<double>")
    assert [r.center for r in canopy.canopy_frames(bad, 3, 2, False)[0].collect()] == [[1.0, 2.0]]
    assert canopy.canopy_frames(bad.where("false"), 3, 2)[0].collect() == []


def test_memory_of_a_round_does_not_grow_with_its_founders():
    rng = np.random.default_rng(7)
    x, founders = rng.uniform(0, 1, (2000, 3)), rng.uniform(0, 1, (8192, 3))
    place, places, n = np.arange(2000), np.arange(8192) // 8, np.ones(2000)
    tracemalloc.start()
    met, total = canopy._members(founders, places, 0.2)(blocks.Dense(x), place, n)
    free = canopy._free(blocks.Dense(x), founders, 0.03)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 8 * blocks.CELLS  # a few matrices of so many distances
    for k in (0, 4000, 8191):
        inside = (((x - founders[k]) ** 2).sum(1) < 0.04) & (place >= places[k])
        assert np.allclose(total[met.tolist().index(k)], [inside.sum(), *x[inside].sum(0)])
    assert free[:50].tolist() == [bool((((p - founders) ** 2).sum(1) >= 0.0009).all()) for p in x[:50]]


def test_sparse_products_with_and_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(6)
    x, c, w = rng.normal(0, 1, (30, 9)) * (rng.random((30, 9)) < 0.3), rng.normal(0, 1, (4, 9)), rng.random((30, 4))
    i, j = np.nonzero(x)
    b = blocks.Sparse(9, np.append(0, np.cumsum((x != 0).sum(1))), j, x[i, j])
    for cells in (blocks.CELLS, 0):
        monkeypatch.setattr(blocks, "CELLS", cells)
        assert np.allclose(b.products(c), x @ c.T) and np.allclose(b.mixed(w), w.T @ x)


def sparse(df):
    return common.as_points(df, kind="sparse")


def test_sparse_points_agree_with_dense_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 12)) * (rng.random((400, 12)) < 0.3) + np.repeat(np.eye(12)[:4] * 6, 100, 0)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, point array<double>")
    thin = sparse(df)
    assert thin.columns == ["id", "size", "entries"] and thin.agg(F.max(F.size("entries"))).first()[0] < 12
    assert [r.point for r in common.as_points(thin, kind="dense").orderBy("id").collect()] == x.tolist()
    one, two = (canopy.canopy(d, 5.0, 4.0)[0] for d in (df, thin))
    assert np.allclose([c.center for c in one], [c.center for c in two]) and [c.n for c in one] == [c.n for c in two]
    one, two = (kmeans.kmeans(d, x[::100], 0.0, 8) for d in (df, thin))
    assert np.allclose([c.center for c in one[0]], [c.center for c in two[0]]) and np.allclose([c.radius for c in one[0]], [c.radius for c in two[0]])
    assert {(r.id, r.cluster) for r in one[1].collect()} == {(r.id, r.cluster) for r in two[1].collect()}
    one, two = (dirichlet.dirichlet(d, 5, 4, seed=2) for d in (df, thin))
    assert [c.n for c in one[0]] == [c.n for c in two[0]] and np.allclose(one[1], two[1])
    assert {(r.id, r.cluster) for r in one[2].collect()} == {(r.id, r.cluster) for r in two[2].collect()}
    nulls = spark.createDataFrame([(3, {0: 1.0}), (3, {1: None}), (None, {0: 1.0}), (3, {})], "size int, entries map<int,double>")
    assert common.as_points(nulls).count() == 2
    with pytest.raises(ValueError):
        common.as_points(df, kind="thin")


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 5), st.integers(1, 12), st.sampled_from([1.0, 1e-9, 1e6]))
def test_decisions_are_those_of_differences(seed, n, d, k, scale):
    """Ties and near ties included."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-2, 3, (n, d)) * scale + 1e3, rng.integers(-2, 3, (k, d)) * scale + 1e3
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    which, near, other = blocks.nearest(blocks.Dense(x), c)
    assert np.allclose(exact[np.arange(n), which], exact.min(1), rtol=1e-12) and np.allclose(near, exact.min(1))
    if scale == 1.0:
        assert which.tolist() == exact.argmin(1).tolist()
        radius = 2.0
        assert (blocks.within(blocks.Dense(x), c, radius) == (np.sqrt(exact) < radius)).all()
    rest = exact.copy()
    rest[np.arange(n), which] = np.inf
    assert (other <= rest.min(1) * (1 + 1e-9) + 1e-9).all()


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c * 8, 1, (100, 4)) for c in rng.normal(0, 1, (20, 4))])
    df, work = spark.createDataFrame([(p.tolist(),) for p in x], "point array<double>"), kmeans.Work()
    start = x[::100] + 0.5
    found, _ = kmeans.kmeans(df, start, 0.0, 12, work=work)
    c = start.copy()
    for _ in range(12):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(20)])
        done, c = np.abs(new - c).max() == 0, new
        if done:
            break
    assert np.allclose([f.center for f in found], c, atol=1e-9) and work.taken < work.all / 2


def test_equal_points_go_through_kmeans_as_one(spark):
    rng = np.random.default_rng(4)
    some = rng.normal(0, 3, (20, 4)) * (rng.random((20, 4)) < 0.6)
    x = some[rng.integers(0, 20, 2000)]
    df, start = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "n long, point array<double>"), some[:3] + 0.1
    c = start.copy()
    for _ in range(4):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(3)])
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for points in (df, sparse(df)):
        work = kmeans.Work()
        found, clustered = kmeans.kmeans(points, start, 0.0, 4, work=work)
        assert work.taken <= 4 * 20 * (3 + 1)  # not 2,000 points
        assert np.allclose([f.center for f in found], c) and [f.n for f in found] == np.bincount(own, minlength=3).tolist()
        assert np.allclose([f.radius for f in found], [x[own == k].std(0) if (own == k).any() else 0 * c[k] for k in range(3)], atol=1e-7)
        assert {r.n: r.cluster for r in clustered.collect()} == dict(enumerate(own.tolist()))
    assert kmeans.kmeans(df, start, 0.0, 0)[0][0].n == (((x[:, None] - start[None]) ** 2).sum(2).argmin(1) == 0).sum()


def test_kmeans_is_lloyd(spark):
    df = blobs(spark, [[0, 0], [5, 5], [0, 9]])
    x = np.array([r[0] for r in df.select("point").collect()])
    start = x[[0, 70, 150]]
    found, clustered = kmeans.kmeans(df, start, 0.0, 25)
    c = start.copy()
    for _ in range(25):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[own == k].mean(0) for k in range(3)])
    assert np.allclose([f.center for f in found], c) and sum(f.n for f in found) == len(x)
    assert clustered.groupBy("blob").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    far, _ = kmeans.kmeans(df, np.array([[0.0, 0.0], [999.0, 999.0]]), 0.0, 3)
    assert far[1].n == 0 and far[1].center.tolist() == [999.0, 999.0]  # an empty cluster stays


def test_dirichlet_finds_blobs(spark):
    df = blobs(spark, [[0, 0], [20, 20], [-20, 20]])
    clusters, mixture, clustered = dirichlet.dirichlet(df, 8, 15, seed=4)
    again = dirichlet.dirichlet(df, 8, 15, seed=4)[0]
    assert [c.n for c in clusters] == [c.n for c in again] and mixture.sum() == pytest.approx(1)
    pure = clustered.groupBy("cluster").agg(F.countDistinct("blob").alias("n"), F.count("*").alias("rows"))
    assert pure.where("n > 1").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] <= 60 + 60
    parts = [dirichlet.dirichlet(df.repartition(p), 8, 15, seed=4)[0] for p in (1, 7)]
    assert all([c.n for c in p] == [c.n for c in clusters] for p in parts)
    draws = np.array([dirichlet.gamma(a, "t", i) for a in (0.3, 1.0, 4.0) for i in range(3000)]).reshape(3, -1)
    assert np.allclose(draws.mean(1), [0.3, 1, 4], rtol=0.1) and np.allclose(draws.var(1), [0.3, 1, 4], rtol=0.2)
    soft = dirichlet.dirichlet(df, 4, 3, emit_most_likely=False, threshold=0.2, seed=1)[2]
    assert soft.agg(F.min("probability")).first()[0] >= 0.2 and soft.count() >= df.count()


def test_proclus_finds_subspaces(spark):
    rng, rows = np.random.default_rng(3), []
    for k, dims in enumerate(([0, 1], [2, 3])):
        for _ in range(150):
            p = rng.uniform(0, 100, 6)
            p[dims] = 20 + 60 * k + rng.standard_normal(2)
            rows.append((k, p.tolist()))
    df = spark.createDataFrame(rows, "blob int, point array<double>")
    medoids, objective, clustered = proclus.proclus(df, k=2, l=2, iterations=12, split_size=1.0, seed=5)
    assert len(medoids) == 2 and all(len(m.dims) >= 2 for m in medoids) and objective > 0
    assert set(clustered.columns) == {"blob", "point", "cluster"} and clustered.count() <= 300
    x = np.array([r[1] for r in rows])
    d = proclus.segmental(x, np.array([m.vector for m in medoids]), [m.dims for m in medoids])
    own = d.argmin(1)
    inside = d[np.arange(len(x)), own] < np.array([m.delta for m in medoids])[own]
    assert clustered.count() == inside.sum()
    with pytest.raises(ValueError):
        proclus.proclus(df, k=1000, l=2)


def test_an_iteration_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(0, 9, (500, 5)), 2)
    df = spark.createDataFrame([(p.tolist(),) for p in x], "point array<double>")
    _, near = proclus.one_pass(df, x[:3], None, np.unique(x[:9], axis=0), 0.1)
    for some in ([0, 1, 2], [3, 8], [5, 1, 7, 2], [4]):
        assert np.allclose(near.means(x[some]), proclus.locality_means(df, x[some], proclus.radii(x[some])))
    dims = [np.array([0, 1]), np.array([2, 3]), np.array([1, 4])]
    both, _ = proclus.one_pass(df, x[:3], dims, x[:4], 0.1)
    plain = proclus.evaluate(df, x[:3], dims, 0.1)
    assert both[0] == pytest.approx(plain[0]) and both[1].tolist() == plain[1].tolist() and both[3].tolist() == plain[3].tolist()
    passes, fold = [], proclus.fold
    monkeypatch.setattr(proclus, "fold", lambda *a, **k: passes.append(1) or fold(*a, **k))
    runs = [proclus.proclus(df.repartition(p), 3, 2, iterations=6, split_size=0.5, seed=2) for p in (1, 5)]
    assert len(passes) == 2 * (1 + 6 + 2)
    assert runs[0][1] == pytest.approx(runs[1][1]) and [m.vector.tolist() for m in runs[0][0]] == [m.vector.tolist() for m in runs[1][0]]


def test_proclus_steps(spark):
    for seed in range(4):  # whatever comes first, the farthest point follows
        line = spark.createDataFrame([([x],) for x in (0.0, 1.0, 9.0, 5.0)], "point array<double>")
        got = proclus.greedy(line, 3, seed).ravel().tolist()
        assert len(set(got)) == 3 and got[1] == max((0.0, 1.0, 9.0, 5.0), key=lambda x: (abs(x - got[0]), x))
    assert proclus.greedy(line, 9).shape == (4, 1) and not len(proclus.greedy(line.where("false"), 2))
    assert proclus.radii(np.array([[0.0, 0], [3, 4], [30, 40]])).tolist() == [5.0, 5.0, 45.0]
    means = np.array([[1.0, 9, 9, 1, 9], [9.0, 9, 1, 1, 1]])
    assert [d.tolist() for d in proclus.select_dimensions(means, 2)] == [[0, 3], [2, 3]]
    assert sum(map(len, proclus.select_dimensions(means, 3))) == 6
    assert len(proclus.select_dimensions(np.ones((1, 3)), 9)[0]) == 3


def test_index_passes_over_empty_clusters(spark):
    points = spark.createDataFrame([(0, [0.0]), (0, [2.0]), (1, [10.0])], "cluster int, point array<double>")
    centers = spark.createDataFrame([(0, [1.0]), (1, [10.0]), (2, [50.0])], "cluster int, center array<double>")
    assert validation.davies_bouldin(points, centers).first()[0] == pytest.approx((1 / 9 + 1 / 9 + 0) / 3)


def test_points_of_tables(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", None, 3.0)], "s string, n int, x double")
    assert [r.point for r in common.as_points(df).collect()] == [[1.0, 2.0]]


def test_index_compares_all_centers(spark):
    rng = np.random.default_rng(2)
    centers, points = rng.normal(0, 5, (150, 3)), rng.integers(0, 150, 1000)
    x = centers[points] + rng.normal(0, 1, (1000, 3))
    got = validation.davies_bouldin(
        spark.createDataFrame([(int(k), p.tolist()) for k, p in zip(points, x, strict=True)], "cluster int, point array<double>"),
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cluster int, center array<double>"),
    ).first()[0]
    s = np.array([np.sqrt((np.abs(x[points == k] - c).sum(1) ** 2).mean()) if (points == k).any() else np.nan for k, c in enumerate(centers)])
    with np.errstate(divide="ignore"):
        ratio = (s[:, None] + s) / np.sqrt(((centers[:, None] - centers) ** 2).sum(2))
    np.fill_diagonal(ratio, np.nan)
    assert got == pytest.approx(np.mean([0 if np.isnan(r).all() else np.nanmax(r) for r in ratio]))


def test_models_beyond_their_bound_are_errors(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_CLUSTERS", 1)
    two = common.cluster_frame(spark, [common.Cluster(k, np.zeros(1), np.zeros(1), 1) for k in range(2)])
    with pytest.raises(ValueError):
        common.read_clusters(two)


def test_command_line(spark, tmp_path):
    from statweave import proclus as command

    rng = np.random.default_rng(3)
    rows = [(float(c + rng.normal(0, 0.1)), float(rng.normal()), float(c + rng.normal(0, 0.1))) for c in (0, 9) for _ in range(60)]
    spark.createDataFrame(rows, "a double, b double, c double").write.parquet(str(tmp_path / "in"))
    command.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--k", "2", "--l", "2", "--splitSize", "1.0"])
    assert spark.read.parquet(str(tmp_path / "out" / "clusters")).count() == 2
