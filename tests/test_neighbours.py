import numpy as np
import pytest
from pyspark.sql import functions as F

from precinct import runtime
from precinct.operators import blocks, cluster, neighbours, tiles
from precinct.operators.components import connected_components
from precinct.runtime import attach


def _frame(spark, points, flags=None):
    rows = [(f"p{i:05d}", *map(float, p), bool(flags[i]) if flags is not None else False) for i, p in enumerate(points)]
    dims = [f"d{j}" for j in range(points.shape[1])]
    return spark.createDataFrame(rows, f"id string, {', '.join(d + ' double' for d in dims)}, flag boolean"), dims


def _skewed(seed, n=900, dims=2):
    """A third on one spot, a third in a dense blob, the rest spread and some far away."""
    random = np.random.default_rng(seed)
    spot = np.tile(random.uniform(0, 1, dims), (n // 3, 1))
    blob = 0.5 + random.normal(0, 0.002, (n // 3, dims))
    rest = random.uniform(0, 1, (n // 3 - 5, dims))
    far = random.uniform(50, 60, (5, dims))
    return np.concatenate([spot, blob, rest, far])


@pytest.fixture(params=["broadcast", "shuffled"])
def size_limits(request, monkeypatch):
    """Run with the usual limits, and with limits so low that the large-data ways are taken."""
    if request.param == "shuffled":
        for module in (runtime, tiles, neighbours):
            for name, value in (("BROADCAST_ROWS", 3), ("HOT_ROWS", 50)):
                if hasattr(module, name):
                    monkeypatch.setattr(module, name, value)
    return request.param


@pytest.mark.parametrize("k", [1, 5, 700])
def test_knn_equals_brute_force(spark, size_limits, k):
    points = _skewed(1)
    flags = np.arange(len(points)) % 4 == 0
    df, dims = _frame(spark, points, flags)
    right = df.where("flag")
    got = neighbours.knn_distance(df, right, k, "id", "id", tuple(dims), tuple(dims)).toPandas()
    others = points[flags]
    used = min(k, len(others))
    gaps = np.sqrt(((points[:, None, :] - others[None, :, :]) ** 2).sum(axis=2))
    want = np.sort(gaps, axis=1)[:, :used].mean(axis=1)
    assert len(got) == len(points)
    got = got.sort_values("id")["mean_distance"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_knn_without_right_rows_and_with_missing_places(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0)], "id string, x double, y double")
    none = neighbours.knn_distance(df, df.where("false"), 5, "id", "id", ("x", "y"), ("x", "y"))
    assert {r.id: r.mean_distance for r in none.collect()} == {"a": None, "b": None}
    own = neighbours.nearest_distance(df, df, "id", "id", ("x", "y"), ("x", "y"))
    assert {r.id: r.min_distance for r in own.collect()} == {"a": 0.0, "b": None}


@pytest.mark.parametrize("dims,eps", [(2, 0.05), (2, 0.003), (3, 0.2), (5, 0.4)])
def test_radius_counts_equal_brute_force(spark, size_limits, dims, eps):
    points = _skewed(2, 600, dims)
    df, names = _frame(spark, points)
    got = neighbours.eps_neighbours(df, "id", names, eps).toPandas().sort_values("id")
    want = ((((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) <= eps * eps).sum(axis=1)
    np.testing.assert_array_equal(got["n_neighbours"].to_numpy(), want)


def _dbscan(points, eps, min_samples):
    near = [np.flatnonzero(((points - p) ** 2).sum(axis=1) <= eps * eps) for p in points]
    core = np.array([len(n) >= min_samples for n in near])
    labels = np.full(len(points), -1)
    current = 0
    for i in range(len(points)):
        if not core[i] or labels[i] != -1:
            continue
        waiting = [i]
        labels[i] = current
        while waiting:
            for j in near[waiting.pop()]:
                if labels[j] == -1:
                    labels[j] = current
                    if core[j]:
                        waiting.append(j)
        current += 1
    return labels


@pytest.mark.parametrize("dims,eps,min_samples", [(2, 0.05, 5), (2, 0.002, 8), (4, 0.3, 4)])
def test_dbscan_equals_brute_force(spark, size_limits, dims, eps, min_samples):
    points = np.random.default_rng(9).permutation(_skewed(3, 600, dims))
    df, names = _frame(spark, points)
    got = cluster.dbscan(df, "id", names, eps, min_samples).toPandas().sort_values("id")
    np.testing.assert_array_equal(got["dbscan_label"].to_numpy(), _dbscan(points, eps, min_samples))


def test_dbscan_border_points_and_corner_cases(spark):
    # two clusters, and a border point within reach of both
    line = np.array([[0.0, 0], [0.1, 0], [0.2, 0], [1.0, 0], [1.1, 0], [1.2, 0], [0.6, 0], [9, 9]])
    df, names = _frame(spark, line)
    got = cluster.dbscan(df, "id", names, 0.41, 4).orderBy("id").toPandas()["dbscan_label"].to_numpy()
    np.testing.assert_array_equal(got, _dbscan(line, 0.41, 4))
    everything = cluster.dbscan(df, "id", names, 0.01, 3).toPandas()["dbscan_label"]
    assert set(everything) == {-1}
    missing = df.withColumn("d0", F.when(F.col("id") != "p00000", F.col("d0")))
    assert cluster.dbscan(missing, "id", names, 0.41, 2).count() == len(line)
    assert cluster.dbscan(df.where("false"), "id", names, 0.1, 2).count() == 0


@pytest.mark.parametrize("ids", ["some null", "twice"])
def test_row_ids_may_be_null_or_repeat(spark, size_limits, ids):
    """Locations have keys of their own, so row ids only order labels."""
    points = _skewed(11, 420)
    df, names = _frame(spark, points)
    n = F.substring("id", 2, 5).cast("int")
    df = df.withColumn("n", n).withColumn("id", F.when(n % 4 != 0, F.col("id")) if ids == "some null" else (n / 2).cast("int").cast("string"))
    gaps2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    counted = neighbours.eps_neighbours(df, "id", names, 0.05).toPandas().sort_values("n")
    np.testing.assert_array_equal(counted["n_neighbours"].to_numpy(), (gaps2 <= 0.05 * 0.05).sum(axis=1))
    near = neighbours.knn_distance(df, df, 5, "id", "id", tuple(names), tuple(names)).toPandas().sort_values("n")
    want = np.sqrt(np.sort(gaps2, axis=1)[:, :5]).mean(axis=1)
    np.testing.assert_allclose(near["mean_distance"].to_numpy(), want, rtol=1e-9, atol=1e-12)
    got = cluster.dbscan(df, "id", names, 0.05, 5).toPandas().sort_values("n")["dbscan_label"].to_numpy()
    want = _dbscan(points, 0.05, 5)
    # the labels' order depends on the ids, the groups do not
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))
    np.testing.assert_array_equal(got == -1, want == -1)


def test_components_of_a_star_and_a_chain(spark):
    star = spark.range(1, 100_001).selectExpr("0L AS u", "id AS v")
    chain = spark.range(200_000, 200_300).selectExpr("id AS u", "id + 1 AS v")
    odd = spark.createDataFrame([(7, 7), (None, 5), (900_000, None)], "u bigint, v bigint")
    found = connected_components(star.unionByName(chain).unionByName(odd))
    sizes = {r.component: r.n for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 100_001, 200_000: 301}
    assert connected_components(odd).count() == 0


def test_tiles_stay_small_and_complete(spark):
    points = _skewed(4)
    df, names = _frame(spark, points)
    tree = tiles.build(tiles.locations(df, "id", names), names, capacity=16)
    sizes = tree.tiles.select(F.size("pts").alias("n")).toPandas()["n"]
    assert sizes.max() <= 16 and sizes.sum() == len(np.unique(points, axis=0))
    assert tree.tiles.agg(F.sum("w")).first()[0] == len(points)


def test_components(spark):
    random = np.random.default_rng(7)
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("s0000", f"s{i:04d}") for i in range(1, 200)]
    loose = [(f"r{a:04d}", f"r{b:04d}") for a, b in random.integers(0, 300, (250, 2))]
    edges = chain + star + loose
    parent: dict[str, str] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_attach_splits_hot_keys(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2)
    got = attach(rows, keyed, ["k"], "w", hot_rows=100)
    assert got.count() == 1000 and got.where("v <> k * 2").count() == 0


class _Session:
    """Stands in for a session with a given setting and master."""

    def __init__(self, named, master):
        self.conf = self
        self.sparkContext = self
        self.named, self.master = named, master

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_scratch_folder_is_the_named_one(spark):
    assert runtime.checkpoint_dir(_Session("hdfs://shared/scratch", "yarn")) == "hdfs://shared/scratch"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(_Session(None, "yarn"))
    df = runtime.cut(spark.range(5))
    assert df.count() == 5 and all(runtime.checkpoint_dir(spark).split(":")[-1] in f for f in df.inputFiles())


def test_tiles_meet_in_bounded_steps(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MET_TILES", 2)
    monkeypatch.setattr(neighbours, "DISTANCES", 500)
    points = _skewed(8, 600)
    df, dims = _frame(spark, points)
    got = neighbours.eps_neighbours(df, "id", dims, 0.02).toPandas().sort_values("id")["n_neighbours"].to_numpy()
    want = ((((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) <= 0.02 * 0.02).sum(axis=1)
    np.testing.assert_array_equal(got, want)


def test_bounds_of_single_points_need_no_shuffle(spark):
    df, dims = _frame(spark, _skewed(9, 300))
    places = tiles.locations(df, "id", dims)
    best, _ = neighbours.nearest_sets(places, places, dims, 5)
    assert "windowspecdefinition(pid" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_dimensions_may_have_any_name(spark):
    df, _ = _frame(spark, _skewed(3, 90))
    named = df.withColumnsRenamed({"d0": "value", "d1": "block"})
    got = neighbours.eps_neighbours(named, "id", ["value", "block"], 0.05).toPandas().sort_values("id")["n_neighbours"]
    want = neighbours.eps_neighbours(df, "id", ["d0", "d1"], 0.05).toPandas().sort_values("id")["n_neighbours"]
    assert list(got) == list(want)


@pytest.mark.parametrize("dims,eps,min_samples,met", [(2, 0.05, 5, 1_000), (2, 0.002, 8, 4), (2, 0.9, 20, 3), (3, 0.2, 6, 1_000), (5, 0.4, 4, 5)])
def test_many_blocks_equal_brute_force(spark, monkeypatch, dims, eps, min_samples, met):
    """Links, border points and counts go across blocks and parts of blocks, and no tree of tiles is walked."""
    for name, value in (("LEAST", 20), ("MOST", 20), ("CAPACITY", 6), ("OFTEN", 2)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(neighbours, "MET_TILES", met)
    monkeypatch.setattr(tiles, "build", None)
    points = np.random.default_rng(12).permutation(_skewed(5, 600, dims))
    df, names = _frame(spark, points)
    counted = neighbours.eps_neighbours(df, "id", names, eps).toPandas().sort_values("id")
    want = ((((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)) <= eps * eps).sum(axis=1)
    np.testing.assert_array_equal(counted["n_neighbours"].to_numpy(), want)
    got = cluster.dbscan(df, "id", names, eps, min_samples).toPandas().sort_values("id")
    np.testing.assert_array_equal(got["dbscan_label"].to_numpy(), _dbscan(points, eps, min_samples))
    locs, root, plain = neighbours.places(df, "id", names)
    table = blocks.lay(locs, root, plain, eps, met).table
    assert len(table.ids) > 10 and (table.parts > 1).any() == (met < 1_000)
